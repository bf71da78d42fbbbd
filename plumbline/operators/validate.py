"""Validation: missing values, duplicates, types, statistics, dates and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    categorical_columns,
    columns_of,
    family,
    no_rows,
    numeric_columns,
    pct,
    per_column,
    present,
    ref,
    row_digest,
)
from plumbline.functions.joins import lookup_join
from plumbline.operators.profile import (
    distinct_counts,
    null_counts,
    numeric_rows,
    quantile_columns,
    row_copies,
    value_counts,
)
from plumbline.session import materialize

# Fixed values of the checks.
RARE_SHARE = 0.01
Z_LIMIT = 3.0
FENCE = 1.5
MIN_OUTLIER_VALUES = 10
CATEGORY_SHARE = 0.05

# Type names that count as one family in an expected schema.
TYPE_NAMES = {
    "integer": {"int", "int32", "int64", "uint8", "uint16", "uint32", "uint64"},
    "float": {"float", "float32", "float64"},
    "string": {"str", "object", "string", "category"},
    "boolean": {"bool", "boolean"},
    "datetime": {"datetime", "datetime64", "datetime64[ns]", "datetime64[ns, utc]"},
}
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}"
STATISTICS = ("mean", "median", "mode", "std", "variance", "min", "max", "skewness", "kurtosis", "q1", "q3", "iqr", "p5", "p95")
TRUTH = r"^(?i)\s*(true|false)\s*$"


def one_column(*frames: DataFrame) -> DataFrame:
    """Join reports that hold one row per column (as many rows as the schema is wide)."""
    return reduce(lambda a, b: a.join(F.broadcast(b), "column_name", "left"), frames)


# ---------------------------------------------------------------- missing values

def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and share per column, with a suggested treatment and a rank
    (worst first) among columns that miss anything."""
    families = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, family(f.dataType))])
    places = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    kind = families[F.col("column_name")]
    report = null_counts(df).select(
        "column_name", "missing_count", pct(F.col("missing_count"), F.col("total_rows")).alias("missing_pct")
    )
    suggestion = (
        F.when(F.col("missing_pct") == 0, "none")
        .when(F.col("missing_pct") > 50, "consider_dropping_column")
        .when(kind.isin("integer", "float", "boolean"), "mean_or_median_imputation")
        .when(kind == "datetime", "forward_fill_or_interpolation")
        .otherwise("mode_or_constant_imputation")
    )
    order = Window.partitionBy(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), places[F.col("column_name")])
    return report.select(
        "*",
        suggestion.alias("suggestion"),
        F.when(F.col("missing_count") > 0, F.row_number().over(order)).cast("long").alias("rank"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(
        F.sum("missing_count").alias("total_missing_cells"),
        pct(F.sum("missing_count"), F.sum("total_rows")).alias("total_missing_pct"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
    )


# ---------------------------------------------------------------- duplicates

def duplicate_rows(df: DataFrame, order_by: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Every row that repeats an earlier one, ``order_by`` (unique) saying which is first.

    Columns in ``ignore`` (a surrogate key) do not count. The groups are counted
    map-side and written once; only groups with copies are joined back, the heaviest by
    broadcast.
    """
    names = [c for c in df.columns if c not in ignore]
    digest = row_digest(df, names)
    keyed = df.withColumn("_digest", digest).withColumn("_order", F.struct(*[ref(c) for c in order_by]))
    groups = (
        keyed.groupBy("_digest")
        .agg(F.count("*").alias("_copies"), F.min("_order").alias("_first"))
        .where(F.col("_copies") > 1)
    )
    groups = materialize(groups, "copies")
    matched = lookup_join(keyed, groups, ["_digest"], "inner", weight="_copies")
    return matched.where(F.col("_order") > F.col("_first")).select(*df.columns)


def identical_columns(df: DataFrame) -> DataFrame:
    """Pairs of columns with the same type and the same value in every row.

    One aggregate of order-free hashes prunes the pairs; the survivors are confirmed
    value by value in one more.
    """
    fields = [f for f in df.schema.fields]
    row = df.agg(*[F.bit_xor(F.xxhash64(present(df, f.name))).alias(f"h{i}") for i, f in enumerate(fields)]
                 + [F.sum(F.xxhash64(present(df, f.name)) % 1_000_003).alias(f"s{i}") for i, f in enumerate(fields)]).first()
    pairs = [
        (a.name, b.name)
        for i, a in enumerate(fields)
        for j, b in enumerate(fields)
        if i < j and a.dataType == b.dataType and row[f"h{i}"] == row[f"h{j}"] and row[f"s{i}"] == row[f"s{j}"]
    ]
    empty = df.sparkSession.createDataFrame([], "col_a string, col_b string")
    if not pairs:
        return empty
    differs = [
        F.coalesce(F.sum((~present(df, a).eqNullSafe(present(df, b))).cast("long")), F.lit(0)).alias(f"d{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"d{i}").alias("d")) for i, (a, b) in enumerate(pairs)]
    return df.agg(*differs).select(F.inline(F.array(*rows))).where("d = 0").select("col_a", "col_b")


# ---------------------------------------------------------------- types

def iso_timestamp(column: Column, formats: Sequence[str] = ()) -> Column:
    """Timestamp of an ISO text, or of one of ``formats``; NULL if it is neither."""
    parsed = F.when(column.rlike(ISO_DATE), column.try_cast("timestamp_ntz"))
    for f in formats:
        parsed = F.coalesce(parsed, F.try_to_timestamp(column, F.lit(f)).cast("timestamp_ntz"))
    return parsed


def dtype_report(df: DataFrame) -> DataFrame:
    """Type category per column and a conversion suggestion for text columns.

    A text column is "mixed" if its values are of more than one kind (number, date,
    truth value, other text). All values are read, not a leading sample.
    """
    texts = columns_of(df, "string")
    kinds = F.create_map(
        *[
            F.lit(x)
            for f in df.schema.fields
            for x in (f.name, {"other": "unknown"}.get(family(f.dataType), family(f.dataType)))
        ]
    )
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    base = null_counts(df).select("column_name", "total_rows")
    base = base.select("*", types[F.col("column_name")].alias("raw_dtype"), kinds[F.col("column_name")].alias("kind"))
    if not texts:
        return base.select(
            "column_name", "raw_dtype", F.col("kind").alias("category"), F.lit(None).cast("string").alias("suggestion")
        )

    def number(c):
        return ref(c).rlike(NUMBER)

    def date(c):
        return ~number(c) & iso_timestamp(ref(c)).isNotNull()

    def truth(c):
        return ref(c).rlike(TRUTH)

    parsed = per_column(
        df,
        texts,
        {
            "n": lambda c: F.count(ref(c)),
            "numbers": lambda c: F.count_if(number(c)),
            "dates": lambda c: F.count_if(date(c)),
            "truths": lambda c: F.count_if(truth(c)),
        },
    )
    full = one_column(base, parsed, distinct_counts(df, texts))
    others = F.col("n") - F.col("numbers") - F.col("dates") - F.col("truths")
    several = sum(((c > 0).cast("int") for c in (F.col("numbers"), F.col("dates"), F.col("truths"), others)), F.lit(0)) > 1
    category = F.when((F.col("kind") == "string") & several, "mixed").otherwise(F.col("kind"))
    suggestion = F.when(
        category == "string",
        F.when(F.col("numbers") == F.col("n"), "convert_to_numeric")
        .when(F.col("dates") == F.col("n"), "convert_to_datetime")
        .when(F.col("unique_count") / F.greatest("total_rows", F.lit(1)) < CATEGORY_SHARE, "convert_to_category"),
    )
    return full.select("column_name", "raw_dtype", category.alias("category"), suggestion.alias("suggestion"))


def type_summary(df: DataFrame) -> DataFrame:
    return dtype_report(df).groupBy("category").agg(F.count("*").alias("column_count"))


def compatible(expected: str, actual: T.DataType) -> bool:
    expected = expected.lower()
    kind = family(actual)
    return expected in TYPE_NAMES.get(kind, ()) or expected in (actual.simpleString(), actual.typeName())


def schema_issues(df: DataFrame, expected: dict[str, str] | None) -> dict:
    """Compare field names and types with an expected schema; reads no rows."""
    if expected is None:
        return {"status": "inferred", "missing": [], "unexpected": [], "mismatched": []}
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = sorted(set(expected) - set(actual))
    mismatched = sorted(c for c in set(expected) & set(actual) if not compatible(expected[c], actual[c]))
    return {
        "status": "failed" if missing or mismatched else "passed",
        "missing": missing,
        "unexpected": sorted(set(actual) - set(expected)),
        "mismatched": mismatched,
    }


def schema_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row per expected or present column: ok, missing, unexpected or type_mismatch."""
    found = schema_issues(df, expected)
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for c in sorted(set(expected) | set(actual)):
        state = next(
            (s for s, k in (("missing", "missing"), ("unexpected", "unexpected"), ("type_mismatch", "mismatched")) if c in found[k]),
            "ok",
        )
        rows.append((c, expected.get(c), actual.get(c), state, found["status"]))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, expected_type string, actual_type string, state string, status string"
    )


# ---------------------------------------------------------------- statistics

def corrected_skewness(skew: Column, n: Column, spread: Column) -> Column:
    """Bias-corrected skewness from the population skewness (0 for a constant)."""
    n = n.cast("double")
    return F.when(n < 3, F.lit(None)).when(spread == 0, 0.0).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * skew)


def corrected_kurtosis(kurt: Column, n: Column, spread: Column) -> Column:
    n = n.cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)
    return F.when(n < 4, F.lit(None)).when(spread == 0, 0.0).otherwise(value)


def moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    def x(c):
        return present(df, c).cast("double")

    return per_column(
        df,
        names,
        {
            "n": lambda c: F.count(x(c)),
            "mean": lambda c: F.avg(x(c)),
            "variance": lambda c: F.var_samp(x(c)),
            "min": lambda c: F.min(x(c)),
            "max": lambda c: F.max(x(c)),
            "skew": lambda c: F.skewness(x(c)),
            "kurt": lambda c: F.kurtosis(x(c)),
        },
        block=2,
    ).withColumn("std", F.sqrt("variance"))


def numeric_modes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Most frequent value per numeric column, the smallest of ties."""
    counts = numeric_rows(df, names).groupBy("column_name", "value").agg(F.count("*").alias("cnt"))
    return counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))


def numeric_statistics(df: DataFrame, digits: int = 6, names: Sequence[str] | None = None) -> DataFrame:
    """Descriptive statistics of every numeric column that has a value."""
    names = list(names or numeric_columns(df))
    if not names:
        return no_rows(df, "column_name string, value_count long, " + ", ".join(f"{s} double" for s in STATISTICS))
    shares = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    full = one_column(moments(df, names), quantile_columns(df, names, shares), numeric_modes(df, names))
    out = {
        "mean": F.col("mean"),
        "median": F.col("median"),
        "mode": F.col("mode"),
        "std": F.col("std"),
        "variance": F.col("variance"),
        "min": F.col("min"),
        "max": F.col("max"),
        "skewness": corrected_skewness(F.col("skew"), F.col("n"), F.col("variance")),
        "kurtosis": corrected_kurtosis(F.col("kurt"), F.col("n"), F.col("variance")),
        "q1": F.col("q1"),
        "q3": F.col("q3"),
        "iqr": F.col("q3") - F.col("q1"),
        "p5": F.col("p5"),
        "p95": F.col("p95"),
    }
    return full.where(F.col("n") > 0).select(
        "column_name", F.col("n").alias("value_count"), *[F.round(e, digits).alias(k) for k, e in out.items()]
    )


def skewness_report(df: DataFrame, digits: int = 6) -> DataFrame:
    """``(column_name, skewness)`` as in ``numeric_statistics``, without its quantiles and modes."""
    names = numeric_columns(df)
    if not names:
        return no_rows(df, "column_name string, skewness double")
    skew = corrected_skewness(F.col("skew"), F.col("n"), F.col("variance"))
    return moments(df, names).where(F.col("n") > 0).select("column_name", F.round(skew, digits).alias("skewness"))


def category_counts(df: DataFrame) -> DataFrame:
    """``(column_name, value, cnt, total_rows, rare)`` over the categorical columns."""
    names = categorical_columns(df)
    if not names:
        return no_rows(df, "column_name string, value string, cnt long, total_rows long, rare boolean")
    totals = null_counts(df, names).select("column_name", "total_rows")
    counts = value_counts(df, names).join(F.broadcast(totals), "column_name")
    rare = F.col("cnt") < F.greatest(F.lit(1.0), F.col("total_rows") * RARE_SHARE)
    return counts.withColumn("rare", rare)


def categorical_report(df: DataFrame) -> DataFrame:
    """Distinct values, cardinality ratio and number of rare values per column."""
    return category_counts(df).groupBy("column_name").agg(
        F.count("*").alias("unique_count"),
        F.round(F.count("*") / F.max("total_rows"), 4).alias("cardinality_ratio"),
        F.count_if("rare").alias("rare_count"),
        (F.count("*") == F.max("total_rows")).alias("all_unique"),
        (F.count_if("rare") > F.count("*") * 0.5).alias("many_rare"),
    )


def rare_values(df: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` rare values of each column, the more frequent first."""
    order = Window.partitionBy("column_name").orderBy(F.desc("cnt"), "value")
    ranked = category_counts(df).where("rare").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select("column_name", F.col("place").cast("long").alias("place"), "value", "cnt")


# ---------------------------------------------------------------- dates

def date_columns(df: DataFrame, min_share: float = 0.95) -> list[str]:
    """Datetime columns, plus text columns in which at least ``min_share`` of the values
    are dates. One aggregate over the text columns."""
    texts = columns_of(df, "string")
    found = columns_of(df, "datetime")
    if texts:
        row = df.agg(
            *[F.avg(iso_timestamp(ref(c)).isNotNull().cast("int")).alias(f"s{i}") for i, c in enumerate(texts)]
        ).first()
        row_share = [row[f"s{i}"] for i in range(len(texts))]
        found = found + [c for c, share in zip(texts, row_share) if share is not None and share >= min_share]
    return found


def date_report(
    df: DataFrame,
    now: str,
    names: Sequence[str] | None = None,
    formats: Sequence[str] = (),
) -> DataFrame:
    """Valid, unparseable, future and repeated timestamps, first and last, per column."""
    names = list(names or date_columns(df))
    if not names:
        return no_rows(
            df,
            "column_name string, valid_count long, invalid_count long, future_dates long, "
            "duplicate_timestamps long, min_date timestamp_ntz, max_date timestamp_ntz",
        )
    texts = set(columns_of(df, "string"))

    def stamp(c):
        return iso_timestamp(ref(c), formats) if c in texts else ref(c).cast("timestamp_ntz")

    limit = F.lit(now).cast("timestamp_ntz")
    basics = per_column(
        df,
        names,
        {
            "valid_count": lambda c: F.count(stamp(c)),
            "invalid_count": lambda c: F.count_if(ref(c).isNotNull() & stamp(c).isNull()),
            "future_dates": lambda c: F.count_if(stamp(c) > limit),
            "min_date": lambda c: F.min(stamp(c)),
            "max_date": lambda c: F.max(stamp(c)),
        },
    )
    stamps = df.select(*[stamp(c).alias(c) for c in names])
    distinct = distinct_counts(stamps, names)
    return one_column(basics, distinct).select(
        "column_name",
        "valid_count",
        "invalid_count",
        "future_dates",
        (F.col("valid_count") - F.col("unique_count")).alias("duplicate_timestamps"),
        "min_date",
        "max_date",
    )


# ---------------------------------------------------------------- outliers

def outlier_report(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """IQR and z-score outliers of each numeric column with at least ten values.

    The limits are one row per column; the second pass tests every value against them.
    """
    names = list(names or numeric_columns(df))
    if not names:
        return no_rows(
            df,
            "column_name string, q1 double, q3 double, iqr double, lower_fence double, upper_fence double, "
            "iqr_outliers long, iqr_outlier_pct double, z_outliers long, z_outlier_pct double",
        )
    def x(c):
        return present(df, c).cast("double")

    spread = per_column(
        df, names, {"n": lambda c: F.count(x(c)), "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c))}
    )
    limits = one_column(
        spread,
        quantile_columns(df, names, {"q1": 0.25, "q3": 0.75}),
    ).where(F.col("n") >= MIN_OUTLIER_VALUES)
    reach = (F.col("q3") - F.col("q1")) * FENCE
    limits = limits.select("*", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))
    value = F.col("value")
    tested = numeric_rows(df, names).join(F.broadcast(limits), "column_name")
    keys = ["column_name", "n", "q1", "q3", "lower", "upper"]
    far = (F.col("std") > 0) & (F.abs((value - F.col("mean")) / F.col("std")) > Z_LIMIT)
    counted = tested.groupBy(*keys).agg(
        F.count_if((value < F.col("lower")) | (value > F.col("upper"))).alias("iqr_outliers"),
        F.count_if(far).alias("z_outliers"),
    )
    return counted.select(
        "column_name",
        F.round("q1", 4).alias("q1"),
        F.round("q3", 4).alias("q3"),
        F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
        F.round("lower", 4).alias("lower_fence"),
        F.round("upper", 4).alias("upper_fence"),
        "iqr_outliers",
        pct(F.col("iqr_outliers"), F.col("n")).alias("iqr_outlier_pct"),
        "z_outliers",
        pct(F.col("z_outliers"), F.col("n")).alias("z_outlier_pct"),
    )
