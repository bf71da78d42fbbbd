"""Tabular files: format by suffix, forgiving CSV, JSON in two layouts, Parquet."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import per_column, ref

# Fixed values of the CSV reader.
MISSING_TOKENS = ("?", "NA", "N/A", "", " ", "nan", "NaN", "null")
DELIMITERS = (",", ";", "\t", "|")
SAMPLE_CHARS = 4096
BROKEN = "_broken_record"
INTEGER = r"^[+-]?\d+$"
WHOLE_DIGITS = 38  # the widest decimal
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
TRUTH = r"^(True|False|TRUE|FALSE|true|false)$"


def extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file or folder by its suffix: csv, data, json or parquet."""
    readers = {"csv": read_csv, "data": read_csv, "json": read_json, "parquet": read_parquet}
    kind = extension(path)
    if kind not in readers:
        raise ValueError(f"Unsupported file format: .{kind}")
    return readers[kind](spark, path, **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def guess_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter found in every line of a small sample, most often per line."""
    sample, size = [], 0
    for r in spark.read.text(path).limit(50).collect():
        if r[0].strip() and size < SAMPLE_CHARS:
            sample.append(r[0])
            size += len(r[0])
    scores = {d: min((line.count(d) for line in sample), default=0) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: scores[d])
    return best if scores[best] else ","


def read_csv(
    spark: SparkSession,
    path: str,
    names: Sequence[str] | None = None,
    delimiter: str | None = None,
    typed: bool = True,
    multiline: bool = True,
) -> DataFrame:
    """CSV with a header (or given ``names``): records with too many fields are skipped,
    texts are trimmed, missing-value tokens become NULL and types follow the values.

    Everything is read as text; one aggregate over the columns decides the types, which
    are then casts in the same scan. Quoted fields may hold line breaks; files known to
    have none can be read in splits with ``multiline=False``.
    """
    sep = delimiter or guess_delimiter(spark, path)
    if names is None:
        names = [c.strip() for c in spark.read.csv(path, sep=sep, header=True, multiLine=multiline, escape='"').columns]
        header = True
    else:
        header = False
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BROKEN]])
    reader = spark.read.option("columnPruning", False)  # a record is only known to be broken if parsed whole
    raw = reader.csv(
        path, sep=sep, header=header, schema=schema, mode="PERMISSIVE", enforceSchema=True, multiLine=multiline,
        columnNameOfCorruptRecord=BROKEN, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    # a record of the wrong length keeps its raw text; short ones are filled with NULL
    quoteless = F.regexp_replace(ref(BROKEN), r'"(""|[^"])*"', "q")
    fields = F.size(F.split(quoteless, re.escape(sep), -1))
    # Spark wants a data column read beside a record's text, also where rows are only counted
    counted = F.length(F.coalesce(ref(names[0]), F.lit(""))) >= 0
    raw = raw.where(counted & (ref(BROKEN).isNull() | (fields <= len(names))))
    texts = raw.select(*[F.when(~F.trim(ref(c)).isin(*MISSING_TOKENS), F.trim(ref(c))).alias(c) for c in names])
    return cast_by_value(texts) if typed else texts


def cast_by_value(texts: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest of long, decimal(38,0), double and boolean that holds
    every value; whole numbers of more than 38 digits stay text."""
    found = per_column(
        texts,
        texts.columns,
        {
            "n": lambda c: F.count(ref(c)),
            "longs": lambda c: F.count_if(ref(c).rlike(INTEGER) & ref(c).try_cast("bigint").isNotNull()),
            "integers": lambda c: F.count_if(ref(c).rlike(INTEGER) & (F.length(F.regexp_replace(ref(c), r"^[+-]?0*", "")) <= WHOLE_DIGITS)),
            "wholes": lambda c: F.count_if(ref(c).rlike(INTEGER)),
            "numbers": lambda c: F.count_if(ref(c).rlike(NUMBER)),
            "truths": lambda c: F.count_if(ref(c).rlike(TRUTH)),
        },
        block=len(texts.columns),  # text formats parse whole lines, so one pass
    ).collect()
    types = {}
    for r in found:
        if r["n"]:
            hits = (("bigint", r["longs"]), ("decimal(38,0)", r["integers"]), ("string", r["wholes"]), ("double", r["numbers"]), ("boolean", r["truths"]))
            types[r["column_name"]] = next((t for t, k in hits if k == r["n"]), "string")
    return texts.select(*[ref(c).cast(types.get(c, "string")).alias(c) for c in texts.columns])


def guess_json_layout(spark: SparkSession, path: str) -> dict:
    """Arguments for ``read_json`` from the first line of one file: an array of records, an
    object of columns (of objects by row label), or one record per line."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    head = first[0][0].lstrip() if first else ""
    if head.startswith("["):
        return {"orient": "records", "lines": False}
    try:
        record = json.loads(head)
    except ValueError:  # an object over several lines
        return {"orient": "columns", "lines": False} if head.startswith("{") else {"orient": "records", "lines": True}
    nested = isinstance(record, dict) and record and all(isinstance(v, dict) for v in record.values())
    return {"orient": "columns", "lines": False} if nested else {"orient": "records", "lines": True}


def read_json(spark: SparkSession, path: str, orient: str | None = None, lines: bool | None = None) -> DataFrame:
    """JSON as records (``lines``: one per line, which splits; else an array per file) or as
    one object of columns per file, ``{"column": {"row": value}}``.

    What is not said is guessed from the first line.
    """
    if orient is None or (orient == "records" and lines is None):
        guess = guess_json_layout(spark, path)
        orient = orient or (guess["orient"] if lines is None else "records")
        lines = guess["lines"] if lines is None else lines
    if orient == "columns":
        return _json_columns(spark, path)
    if orient != "records":
        raise ValueError(f"Unsupported orient: {orient}")
    return spark.read.json(path, multiLine=not lines)


def _json_columns(spark: SparkSession, path: str) -> DataFrame:
    """``{"column": {"row": value}}``: exploded to cells, gathered again by row label."""
    whole = spark.read.text(path, wholetext=True)
    maps = whole.select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    cells = maps.select(F.explode("m").alias("name", "cells")).select("name", F.explode("cells").alias("row", "cell"))
    names = [r[0] for r in maps.select(F.explode(F.map_keys("m"))).collect()]
    wide = cells.groupBy("row").agg(*[F.max(F.when(F.col("name") == c, F.col("cell"))).alias(c) for c in names])
    return cast_by_value(wide.select(*[ref(c) for c in names]))
