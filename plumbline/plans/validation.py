"""Whole validation run: every check as a DataFrame, plus a summary and the warnings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import profile, quality, validate


def _text(frame: DataFrame, stage: str, condition, *parts) -> DataFrame:
    """Rows of ``frame`` that meet ``condition``, as ``(stage, warning)``."""
    pieces = [p if not isinstance(p, str) else F.lit(p) for p in parts]
    return frame.where(condition).select(F.lit(stage).alias("stage"), F.concat(*pieces).alias("warning"))


def warnings_of(reports: dict[str, DataFrame], issues: dict) -> list[DataFrame]:
    """The warnings each report gives rise to."""
    out = []
    name = F.concat(F.lit("Column '"), F.col("column_name"), F.lit("': "))
    if "missing" in reports:
        worst = reports["missing"].where("missing_pct > 30").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "column_name"))), lambda s: s["column_name"]).alias("names")
        )
        out.append(_text(worst, "missing", F.size("names") > 0, "Columns with >30% missing values: ", F.array_join("names", ", ")))
    if "duplicates" in reports:
        out.append(_text(reports["duplicates"], "duplicates", F.col("duplicate_rows") > 0,
                         F.col("duplicate_rows").cast("string"), " duplicate rows"))
    if "numeric" in reports:
        out.append(_text(reports["numeric"], "numeric", F.abs("skewness") > 2, name, "highly skewed"))
    if "categorical" in reports:
        out.append(_text(reports["categorical"], "categorical", F.col("all_unique"), name, "100% unique values"))
        out.append(_text(reports["categorical"], "categorical", F.col("many_rare"), name, "many rare categories"))
    if "dates" in reports:
        for column, label in (("invalid_count", "unparseable date(s)"), ("future_dates", "future date(s)"),
                              ("duplicate_timestamps", "duplicate timestamp(s)")):
            out.append(_text(reports["dates"], "dates", F.col(column) > 0, name, F.col(column).cast("string"), f" {label}"))
    if "outliers" in reports:
        out.append(_text(reports["outliers"], "outliers", F.col("iqr_outliers") > 0, name,
                         F.col("iqr_outliers").cast("string"), " IQR outliers"))
    return out


def run_validation(
    df: DataFrame,
    dataset: str = "dataset",
    expected: dict[str, str] | None = None,
    now: str = "9999-12-31 00:00:00",
) -> dict[str, DataFrame]:
    """All checks of one table. A check that cannot be built leaves an entry in
    ``summary.errors`` and does not stop the others. Nothing runs until a report is read."""
    issues = validate.schema_issues(df, expected)
    stages: dict[str, Callable[[], DataFrame]] = {
        "schema": lambda: validate.schema_check(df, expected) if expected else profile.schema_report(df),
        "missing": lambda: validate.missing_report(df),
        "duplicates": lambda: profile.duplicate_summary(df),
        "dtypes": lambda: validate.dtype_report(df),
        "numeric": lambda: validate.numeric_statistics(df),
        "categorical": lambda: validate.categorical_report(df),
        "dates": lambda: validate.date_report(df, now),
        "outliers": lambda: validate.outlier_report(df),
        "quality": lambda: quality.quality_score(df, expected),
    }
    reports: dict[str, DataFrame] = {}
    errors = []
    for stage, build in stages.items():
        try:
            reports[stage] = build()
        except Exception as exc:  # noqa: BLE001 - isolation between stages is the contract
            errors.append(f"{stage}: {exc}")

    spark = df.sparkSession
    texts = []
    if issues["missing"]:
        texts.append("Missing expected columns: " + ", ".join(issues["missing"]))
    if issues["unexpected"]:
        texts.append("Unexpected columns found: " + ", ".join(issues["unexpected"]))
    if issues["mismatched"]:
        texts.append(f"{len(issues['mismatched'])} column(s) have type mismatches")
    schema_texts = spark.createDataFrame([("schema", t) for t in texts], "stage string, warning string")
    # of the numeric report the warnings need the skewness alone, so no quantile or mode is computed for them
    read = {**reports, "numeric": validate.skewness_report(df)} if "numeric" in reports else reports
    warnings = reduce(DataFrame.unionByName, [schema_texts, *warnings_of(read, issues)])

    gone = validate.missing_summary(df).select(F.col("total_missing_cells").alias("m"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("k"))
    copies = profile.duplicate_summary(df).select(F.lit(None).cast("long").alias("m"), F.col("total_rows").alias("n"), F.col("duplicate_rows").alias("k"))
    summary = gone.unionByName(copies).agg(*[F.max(c).alias(c) for c in "mnk"]).select(
        F.lit(dataset).alias("dataset"),
        F.col("n").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.lit(issues["status"]).alias("schema_status"),
        F.lit(len(issues["missing"])).cast("long").alias("missing_columns"),
        F.lit(len(issues["mismatched"])).cast("long").alias("type_mismatches"),
        F.col("m").alias("missing_cells"),
        F.col("k").alias("duplicate_rows"),
        F.lit("; ".join(errors)).alias("errors"),
    )
    return {**reports, "summary": summary, "warnings": warnings}
