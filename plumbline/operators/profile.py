"""Dataset profiles: schema, summary, numeric, datetime and categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    categorical_columns,
    columns_of,
    missing,
    no_rows,
    numeric_columns,
    pct,
    per_column,
    present,
    ref,
    row_hashes,
    short_key,
)
from plumbline.operators.ordered import exact_quantiles, quantiles_of_counts

# Bytes of one value of each fixed-width type, for the size estimate.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
# Columns of about this many distinct values at most have their quantiles from counts per value.
FEW_VALUES = 10_000


def numeric_rows(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(keep, column_name, value DOUBLE)`` of numeric columns, NaN as NULL."""
    wide = df.select(*[ref(k) for k in keep], *[present(df, c).cast("double").alias(c) for c in names])
    return wide.unpivot(list(keep), list(names), "column_name", "value").where(F.col("value").isNotNull())


def value_counts(df: DataFrame, names: Sequence[str], whole: bool = True) -> DataFrame:
    """``(column_name, value, cnt)`` of the non-missing values of several columns.

    One shuffle serves every column, with a partial count per task, so a hot value is
    one row per task. ``whole=False`` groups long texts by their hash (counts only).
    """
    def text(name: str) -> Column:
        column = present(df, name) if whole else short_key(df, name)
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            column = column + F.lit(0.0)  # -0.0 and 0.0 are one value
        return column.cast("string").alias(name)

    wide = df.select(*[text(c) for c in names])
    rows = wide.unpivot([], list(names), "column_name", "value").where(F.col("value").isNotNull())
    return rows.groupBy("column_name", "value").agg(F.count("*").alias("cnt"))


def distinct_counts(df: DataFrame, names: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column_name, unique_count)``; exact by grouping, or by sketch on request."""
    if approx:
        return per_column(df, names, {"unique_count": lambda c: F.approx_count_distinct(present(df, c))})
    found = value_counts(df, names, whole=False).groupBy("column_name").agg(F.count("*").alias("unique_count"))
    known = per_column(df.limit(0), names, {"unused": lambda c: F.lit(0)}).select("column_name")
    return known.join(F.broadcast(found), "column_name", "left").fillna(0, ["unique_count"])


def null_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return per_column(
        df,
        names or df.columns,
        {
            "total_rows": lambda c: F.count(F.lit(1)),
            "missing_count": lambda c: F.coalesce(F.sum(missing(df, c).cast("long")), F.lit(0)),
        },
    )


def schema_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, missing count and share, distinct non-missing values."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    nulls = null_counts(df).select(
        "column_name",
        types[F.col("column_name")].alias("dtype"),
        F.col("missing_count").alias("null_count"),
        pct(F.col("missing_count"), F.col("total_rows")).alias("null_pct"),
    )
    return nulls.join(F.broadcast(distinct_counts(df, df.columns, approx)), "column_name")


def row_copies(df: DataFrame) -> DataFrame:
    """One row per distinct row of ``df``: its number of copies, counted map-side first."""
    halves = [h.alias(f"digest{i}") for i, h in enumerate(row_hashes(df, df.columns))]
    return df.select(*halves).groupBy("digest0", "digest1").agg(F.count("*").alias("copies"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (NULL equals NULL)."""
    total = row_copies(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return total.select(
        "total_rows", "duplicate_rows", pct(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_pct")
    )


def estimated_bytes(df: DataFrame) -> Column:
    """Aggregate: bytes of the stored values (fixed widths, plus text lengths)."""
    fixed = 0
    texts = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            texts = texts + F.coalesce(F.octet_length(ref(f.name)), F.lit(0))
        else:
            fixed += WIDTHS.get(f.dataType.simpleString(), 8)
    return F.coalesce(F.sum(texts + F.lit(fixed)), F.lit(0))


def table_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells, duplicate rows, size."""
    width = len(df.columns)
    cells = df.agg(
        F.count(F.lit(1)).alias("rows_"),
        F.coalesce(F.sum(sum((missing(df, c).cast("long") for c in df.columns), F.lit(0))), F.lit(0)).alias("missing_"),
        estimated_bytes(df).alias("bytes_"),
    ).select("rows_", "missing_", "bytes_", F.lit(None).cast("long").alias("dups_"))
    copies = duplicate_summary(df).select(
        *[F.lit(None).cast("long").alias(c) for c in ("rows_", "missing_", "bytes_")], F.col("duplicate_rows").alias("dups_")
    )
    one = cells.unionByName(copies).agg(*[F.max(c).alias(c) for c in ("rows_", "missing_", "bytes_", "dups_")])
    return one.select(
        F.col("rows_").alias("total_rows"),
        F.lit(width).cast("long").alias("total_columns"),
        (F.col("rows_") * width).alias("total_cells"),
        F.col("missing_").alias("missing_cells"),
        pct(F.col("missing_"), F.col("rows_") * width).alias("missing_pct"),
        F.col("dups_").alias("duplicate_rows"),
        pct(F.col("dups_"), F.col("rows_")).alias("duplicate_pct"),
        F.col("bytes_").alias("data_bytes"),
    )


def quantile_columns(df: DataFrame, names: Sequence[str], shares: dict[str, float], approx: bool = False) -> DataFrame:
    """``(column_name, <one column per share>)`` of linear quantiles.

    Columns of few distinct values (flags, codes, date parts) are answered from the counts of
    their values; only the others need the brackets of ``exact_quantiles``, and only their values
    are turned into rows for them. The estimate that parts the columns is a scalar subquery,
    and decides the cost alone: both ways are exact.
    """
    asked = list(shares.values())
    if approx:
        marks = numeric_rows(df, names).groupBy("column_name").agg(F.percentile_approx("value", asked, 10_000).alias("quantiles"))
    else:
        kinds = df.agg(*[F.approx_count_distinct(present(df, c).cast("double")).alias(f"n{i}") for i, c in enumerate(names)])
        few = F.array(*[F.col(f"n{i}") <= FEW_VALUES for i in range(len(names))])
        parted = df.select(*[ref(c).alias(f"c{i}") for i, c in enumerate(names)], kinds.select(few).scalar().alias("few"))

        def rows(few: bool) -> DataFrame:
            return numeric_rows(parted.select(*[F.when(F.col("few")[i] == few, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]), names)

        counted = quantiles_of_counts(rows(True), ["column_name"], asked)
        marks = counted.unionByName(exact_quantiles(rows(False), ["column_name"], asked))
    return marks.select("column_name", *[F.element_at("quantiles", i + 1).alias(s) for i, s in enumerate(shares)])


def numeric_profile(df: DataFrame, digits: int = 6, approx: bool = False) -> DataFrame:
    """Mean, sample deviation, minimum, quartiles and maximum of each numeric column."""
    names = numeric_columns(df)
    if not names:
        return no_rows(df, "column_name string, value_count long, mean double, std double, min double, max double, p25 double, p50 double, p75 double")
    basics = per_column(
        df,
        names,
        {
            "value_count": lambda c: F.count(present(df, c)),
            "mean": lambda c: F.round(F.avg(present(df, c)), digits),
            "std": lambda c: F.round(F.stddev_samp(present(df, c)), digits),
            "min": lambda c: F.round(F.min(present(df, c)).cast("double"), digits),
            "max": lambda c: F.round(F.max(present(df, c)).cast("double"), digits),
        },
    )
    marks = quantile_columns(df, names, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, approx)
    marks = marks.select("column_name", *[F.round(p, digits).alias(p) for p in ("p25", "p50", "p75")])
    return basics.join(F.broadcast(marks), "column_name", "left")


def datetime_profile(df: DataFrame) -> DataFrame:
    names = columns_of(df, "datetime")
    if not names:
        return no_rows(df, "column_name string, min_value timestamp_ntz, max_value timestamp_ntz")
    return per_column(
        df,
        names,
        {
            "min_value": lambda c: F.min(ref(c)).cast("timestamp_ntz"),
            "max_value": lambda c: F.max(ref(c)).cast("timestamp_ntz"),
        },
    )


def top_values(df: DataFrame, names: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each categorical column (ties by value)."""
    counts = value_counts(df, names or categorical_columns(df))
    order = Window.partitionBy("column_name").orderBy(F.desc("cnt"), "value")
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select("column_name", F.col("place").cast("long").alias("place"), "value", "cnt")


def value_distribution(df: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """Values of one column with counts, most frequent first."""
    counts = df.groupBy(ref(name).alias("value")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "value")
    return counts.limit(k) if k else counts
