"""List plan features of every catalog query that would hurt at scale.

usage: python tools/plans.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline import catalog  # noqa: E402
from plumbline.session import local_session  # noqa: E402

PATTERNS = {
    "cross join": r"CartesianProduct|BroadcastNestedLoopJoin",
    "window in one task": r"Window \[.*\n(?:[^\n]*(?:Sort|WindowGroupLimit|Project|AQEShuffleRead)[^\n]*\n)*[^\n]*Exchange SinglePartition",
    "row-at-a-time python": r"BatchEvalPython",
}


def findings(plan: str) -> list[str]:
    return [name for name, p in PATTERNS.items() if re.search(p, plan)]


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("--show", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    catalog.load()
    spark = local_session(8)
    for name in args.names or list(catalog.QUERIES):
        df = catalog.QUERIES[name](spark, args.sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = findings(plan)
        shuffles = len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan))
        print(f"{name}: shuffles {shuffles} {'; '.join(found)}")
        if args.show:
            print(plan)


if __name__ == "__main__":
    main()
