"""Time headline catalog queries on local[$BENCH_CPUS]; prints one JSON line.

Every query is computed whole (all rows, all columns) and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline import catalog  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINES = [
    "schema_report",
    "numeric_profile",
    "numeric_statistics",
    "duplicate_rows",
    "outlier_report",
    "quality_score",
    "impute_median",
    "forward_fill_by_user",
    "label_encode",
    "robust_scale",
    "correlations",
    "mutual_information",
    "drift_report",
    "chi_square",
    "clean_documents",
    "fixed_chunks_trimmed",
    "recursive_chunks",
    "safety_check_documents",
    "redact_documents",
    "top_k",
    "citations",
    "history_window",
    "visible_projects",
    "latest_reports",
    "ranking_metrics",
    "regression_metrics",
    "event_rates",
    "user_sessions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    catalog.load()
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
