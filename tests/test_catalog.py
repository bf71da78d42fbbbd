"""Every catalog query with SQL against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from plumbline import catalog
from tools.check import TABLES, rows_of

catalog.load()
# Searches over many model fits, and thousands of files, run in tools/check.py instead.
SLOW = {"classifier_search", "regressor_search", "discover_documents", "preprocess_report"}
# The quick modules run whole; of the others these stand for their kind, unless
# PLUMBLINE_ALL_QUERIES is set. tools/check.py always runs everything.
QUICK_MODULES = {"tables", "dialogue", "documents", "sources"}
STANDING_FOR = {
    "schema_report", "table_summary", "numeric_statistics_skewed", "identical_columns", "dtype_report", "date_report",
    "quality_score", "validation_summary", "impute_mode", "forward_fill", "label_encode", "robust_scale", "log_transform",
    "correlations", "anova_scores", "preprocess_run", "drift_report_mixed", "baseline_snapshot", "chi_square",
    "stratified_split", "binary_metrics", "multiclass_metrics", "ranking_metrics", "regression_metrics_by",
    "cluster_scores", "linear_explanations", "event_rates", "latency_histogram", "user_sessions", "run_states",
    "stream_event_rates", "stream_safety",
}


def chosen():
    every = os.environ.get("PLUMBLINE_ALL_QUERIES")
    for name, fn in catalog.QUERIES.items():
        if name not in SLOW and (every or name in STANDING_FOR or fn.__module__.rsplit(".", 1)[1] in QUICK_MODULES):
            yield name


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(small, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(chosen()))
def test_query(spark, duck, small, name):
    df = catalog.QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalog.SQL:
        assert got
        return
    cursor = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() == 5


def test_entry_point_without_a_library_of_one_package():
    """A library that only some queries need does not take the others with it."""
    block = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", block], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))]
