"""Column families, the missing-value rule and small expression helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(dtype: T.DataType) -> str:
    """integer, float, boolean, datetime, string or other. Booleans are not numeric."""
    if isinstance(dtype, INTEGER_TYPES):
        return "integer"
    if isinstance(dtype, FLOAT_TYPES):
        return "float"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATE_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    return "other"


def columns_of(df: DataFrame, *families: str, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) in families and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return columns_of(df, "integer", "float", exclude=exclude)


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return columns_of(df, "string", "boolean", exclude=exclude)


def ref(name: str) -> Column:
    """Reference to a top-level column whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that both count as missing."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(ref(name)), ref(name))
    return ref(name)


def missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def without_nan(df: DataFrame) -> DataFrame:
    """Projection that maps every NaN to NULL."""
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 for an empty whole."""
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, digits)).otherwise(F.lit(0.0))


def per_column(
    df: DataFrame, names: Sequence[str], metrics: dict[str, Callable[[str], Column]], block: int | None = None
) -> DataFrame:
    """Aggregates of many columns, turned into one row per column.

    ``metrics`` maps an output name to a function from column name to aggregate. Up to
    ``block`` columns share a scan; each block reads only its own columns, so smaller
    blocks keep heavy aggregates inside compiled code without reading more.
    """
    parts = []
    block = block or max(1, 40 // len(metrics))
    for start in range(0, len(names), block):
        some = names[start:start + block]
        aggregates = [fn(c).alias(f"{m}#{i}") for i, c in enumerate(some) for m, fn in metrics.items()]
        rows = [
            F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{m}#{i}`").alias(m) for m in metrics])
            for i, c in enumerate(some)
        ]
        parts.append(df.agg(*aggregates).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def no_rows(df: DataFrame, ddl: str) -> DataFrame:
    """Empty report, for a table without columns of the wanted kind."""
    return df.sparkSession.createDataFrame([], ddl)


def row_hashes(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The two 64-bit halves of ``row_digest``."""
    parts: list[Column] = []
    for c in names:
        column = present(df, c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            column = column + F.lit(0.0)
        parts += [column, column.isNull()]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def row_digest(df: DataFrame, names: Sequence[str]) -> Column:
    """128-bit digest of typed values: NaN counts as NULL, -0.0 as 0.0, and NULL is told apart
    from any value and from its neighbours; texts and timestamps count in full."""
    return F.concat(*[F.lpad(F.hex(half), 16, "0") for half in row_hashes(df, names)])


def short_key(df: DataFrame, name: str) -> Column:
    """Stand-in for a value in grouping keys: long texts shrink to their SHA-256, so a
    shuffle on them moves 64 characters instead of whole documents."""
    column = present(df, name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.length(column) > 64, F.sha2(column, 256)).otherwise(column)
    return column
