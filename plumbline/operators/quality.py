"""Weighted data-quality score, its grade and the recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import duplicate_summary
from plumbline.operators.validate import missing_report, missing_summary, outlier_report, schema_issues

# Fixed values of the score.
WEIGHTS = {"completeness": 0.30, "validity": 0.25, "uniqueness": 0.20, "consistency": 0.20, "accuracy": 0.05}
ACCURACY = 85.0
MISMATCH_PENALTY = 5
MISSING_COLUMN_PENALTY = 10
FAILED_PENALTY = 20
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
GOOD = "Dataset quality is good. Proceed to Feature Engineering."


def grade(score: Column) -> Column:
    chain = F
    for limit, letter in GRADES:
        chain = chain.when(score >= limit, letter)
    return chain.otherwise("F")


def dimension_scores(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """``(dimension, raw)`` with the unrounded score of each of the five dimensions."""
    issues = schema_issues(df, expected)
    penalty = MISMATCH_PENALTY * len(issues["mismatched"]) + MISSING_COLUMN_PENALTY * len(issues["missing"])
    if issues["status"] == "failed":
        penalty += FAILED_PENALTY

    def scored(frame: DataFrame, name: str, loss: Column) -> DataFrame:
        return frame.select(F.lit(name).alias("dimension"), F.greatest(F.lit(0.0), 100.0 - loss).alias("raw"))

    missing = scored(missing_summary(df), "completeness", F.col("total_missing_pct"))
    copies = scored(duplicate_summary(df), "uniqueness", F.col("duplicate_pct") * 2)
    spread = outlier_report(df).agg(F.coalesce(F.avg("iqr_outlier_pct"), F.lit(0.0)).alias("avg_pct"))
    outliers = scored(spread, "consistency", F.col("avg_pct"))
    fixed = df.sparkSession.createDataFrame(
        [("validity", max(0.0, 100.0 - penalty)), ("accuracy", ACCURACY)], "dimension string, raw double"
    )
    return reduce(DataFrame.unionByName, [missing, fixed, copies, outliers])


def quality_score(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """One row per dimension with its weight, next to the overall score and grade."""
    names = list(WEIGHTS)
    scores = dimension_scores(df, expected)
    wide = scores.agg(*[F.max(F.when(F.col("dimension") == d, F.col("raw"))).alias(d) for d in names])
    total = F.round(sum((F.lit(WEIGHTS[d]) * F.col(d) for d in names), F.lit(0.0)), 2)
    rows = [
        F.struct(F.lit(d).alias("dimension"), F.round(F.col(d), 2).alias("score"), F.lit(WEIGHTS[d]).alias("weight"))
        for d in names
    ]
    return wide.select(total.alias("overall_score"), F.inline(F.array(*rows))).select(
        "dimension", "score", "weight", "overall_score", grade(F.col("overall_score")).alias("grade")
    )


def recommendations(
    df: DataFrame, expected: dict[str, str] | None = None, most_columns: int | None = 5, most_mismatches: int | None = 3
) -> DataFrame:
    """Advice that follows from the dimension scores, one row per sentence. A sentence names
    the first so many columns in the table's order; None names all."""
    issues = schema_issues(df, expected)
    scores = dimension_scores(df, expected).select("dimension", "raw", F.lit(None).cast("string").alias("gappy"))
    place = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column_name"))
    most = len(df.columns) if most_columns is None else most_columns
    gappy = missing_report(df).where("missing_pct > 10").agg(
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "column_name"))), lambda s: s["column_name"]), 1, most), ", ").alias("gappy")
    )
    both = scores.unionByName(gappy.select(F.lit("gappy").alias("dimension"), F.lit(None).cast("double").alias("raw"), "gappy"))
    at = {d: F.max(F.when(F.col("dimension") == d, F.col("raw"))).alias(d) for d in WEIGHTS}
    one = both.agg(*at.values(), F.max("gappy").alias("gappy"))
    mismatched = ", ".join(issues["mismatched"][:most_mismatches])
    advice = F.array_compact(
        F.array(
            F.when(
                (F.col("completeness") < 90) & (F.col("gappy") != ""),
                F.concat(F.lit("Impute or drop columns with high missing values: "), F.col("gappy")),
            ),
            F.when(F.col("uniqueness") < 90, "Remove or investigate duplicate rows before training."),
            F.when((F.col("validity") < 90) & F.lit(mismatched != ""), f"Fix data type mismatches in: {mismatched}"),
            F.when(
                F.col("consistency") < 85,
                "Investigate outliers — consider capping or log-transforming skewed columns.",
            ),
        )
    )
    return one.select(
        F.posexplode(F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(GOOD)))).alias("place", "recommendation")
    ).select(F.col("place").cast("long").alias("place"), "recommendation")
