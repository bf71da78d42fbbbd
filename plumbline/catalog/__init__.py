"""Named queries over the test tables, each next to the SQL that states its result.

Every entry is a function ``(spark, tables_dir) -> DataFrame``; ``sql`` is the same
result in ANSI SQL where SQL can express it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = ("profiling", "features", "drift", "sources", "documents", "dialogue", "tables", "models", "streams")


def query(sql: str | None = None):
    def register(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return register


# Tables whose rows take long to process are spread over the cores if a file is one split.
HEAVY = ("documents", "pages")


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if heavy or name in HEAVY else df


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"plumbline.catalog.{module}")
