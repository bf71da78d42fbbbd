"""Run catalog queries against their SQL in DuckDB and compare whole results.

usage: python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from plumbline import catalog  # noqa: E402
from plumbline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--modules", default="")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.modules:
        for m in args.modules.split(","):
            importlib.import_module(f"plumbline.catalog.{m}")
    else:
        catalog.load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{args.sf}/{t}.parquet')")
    spark = local_session(8)
    bad = 0
    wanted = args.names or [
        n for n, f in catalog.QUERIES.items() if not args.modules or f.__module__.split(".")[-1] in args.modules.split(",")
    ]
    for name in wanted:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(exc)[:1500]}")
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
            continue
        took = time.time() - start
        if name not in catalog.SQL:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s  {df.columns} {got[:2] if len(str(got[:2])) < 600 else ''}")
            continue
        try:
            t0 = time.time()
            cur = con.execute(catalog.SQL[name])
            want_cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - t0
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(exc)[:1500]}")
            continue
        if sorted(df.columns) != sorted(want_cols):
            bad += 1
            print(f"COLUMNS {name}: {sorted(df.columns)} vs {sorted(want_cols)}")
            continue
        a, b = rows_of(df.columns, got), rows_of(want_cols, want)
        if a == b:
            print(f"ok    {name}: {len(a)} rows {took:.1f}s (sql {sql_took:.1f}s)")
            if not a:
                print(f"      EMPTY {name}")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows; columns {sorted(df.columns)}")
            for x in sorted(sa - sb)[:4]:
                print("   spark ", x[:700])
            for x in sorted(sb - sa)[:4]:
                print("   sql   ", x[:700])
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
