"""Distribution drift between a baseline table and a current one.

All features are handled together in long form, so a report over many features is one
set of jobs. Each side is ``(feature, value)`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import present
from plumbline.operators.ordered import running_totals

# Fixed values of the drift rules.
BUCKETS = 10
EMPTY_COUNT = 0.0001
ABSENT_SHARE = 0.0001
PSI_LIMIT = 0.2
P_LIMIT = 0.05
SCORE_LIMIT = 0.3
SERIES_TERMS = 100


def feature_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form of numeric features, missing values left out."""
    wide = df.select(*[present(df, c).cast("double").alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "value").where(F.col("value").isNotNull())


def category_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    wide = df.select(*[present(df, c).cast("string").alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "value").where(F.col("value").isNotNull())


def both_sides(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``(feature, value, base, cur)``: both tables as one, counted per distinct value."""
    sides = baseline.select("feature", "value", F.lit(1).alias("base"), F.lit(0).alias("cur")).unionByName(
        current.select("feature", "value", F.lit(0).alias("base"), F.lit(1).alias("cur"))
    )
    return sides.groupBy("feature", "value").agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))


# ---------------------------------------------------------------- histograms, PSI, JS

def baseline_ranges(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def edge(i: int, buckets: int) -> Column:
    """Left edge of bin ``i`` of an equal-width histogram from low to high."""
    if i == buckets:
        return F.col("high")
    return F.lit(float(i)) * ((F.col("high") - F.col("low")) / F.lit(float(buckets))) + F.col("low")


def histograms(
    baseline: DataFrame,
    current: DataFrame,
    buckets: int = BUCKETS,
    ranges: DataFrame | None = None,
    outside: bool = False,
) -> DataFrame:
    """``(feature, bin, base, cur)`` on equal-width bins of the baseline range.

    The last bin is closed; current values outside the range are not counted, or with
    ``outside`` as bins -1 and ``buckets``. Every inner bin is present, the empty ones with 0. One partial count per task, then one small shuffle.
    """
    ranges = baseline_ranges(baseline) if ranges is None else ranges

    def counted(side: DataFrame, name: str) -> DataFrame:
        placed = side.join(F.broadcast(ranges), "feature")
        if not outside:
            placed = placed.where(F.col("value").between(F.col("low"), F.col("high")))
        counts = placed.groupBy("feature", placed_bin(buckets).alias("bin")).agg(F.count("*").alias("cnt"))
        return counts.select(
            "feature", "bin", *[(F.col("cnt") if s == name else F.lit(0).cast("long")).alias(s) for s in ("base", "cur")]
        )

    frame = ranges.select("feature", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bin")).select(
        "feature", "bin", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("cur")
    )
    every = counted(baseline, "base").unionByName(counted(current, "cur")).unionByName(frame)
    return every.groupBy("feature", "bin").agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))


def psi_scores(bins: DataFrame) -> DataFrame:
    """Population stability index: empty bins count as 0.0001, shares are renormalised."""
    floor = [F.when(F.col(s) == 0, EMPTY_COUNT).otherwise(F.col(s).cast("double")).alias(s) for s in ("base", "cur")]
    every = Window.partitionBy("feature")  # one row per bin
    shares = bins.select("feature", *floor).select(
        "feature", *[(F.col(s) / F.sum(s).over(every)).alias(s) for s in ("base", "cur")]
    )
    return shares.groupBy("feature").agg(
        F.sum((F.col("cur") - F.col("base")) * F.log(F.col("cur") / F.col("base"))).alias("psi")
    )


def js_distances(bins: DataFrame) -> DataFrame:
    """Jensen-Shannon distance (square root, natural logarithm) without smoothing."""
    every = Window.partitionBy("feature")
    shares = bins.select("feature", *[(F.col(s) / F.nullif(F.sum(s).over(every), F.lit(0))).alias(s) for s in ("base", "cur")])
    middle = (F.col("base") + F.col("cur")) / 2

    def part(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / middle)).otherwise(F.when(F.col(c) == 0, 0.0))

    total = (F.sum(part("base")) + F.sum(part("cur"))) / 2
    # without a value on one side there is no distance, not a distance of 0
    return shares.groupBy("feature").agg(
        F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total))).alias("js_distance")
    )


def placed_bin(buckets: int) -> Column:
    """Bin of ``value`` between ``low`` and ``high``; -1 below, ``buckets`` above."""
    inside = sum(((F.col("value") >= edge(i, buckets)).cast("int") for i in range(1, buckets)), F.lit(0))
    return F.when(F.col("value") < F.col("low"), -1).when(F.col("value") > F.col("high"), buckets).otherwise(inside)


def edge_tests(bins: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """KS per key on the edges of ``(bin, base, cur)`` with the values outside the range as
    bins -1 and ``buckets``: the largest gap at an edge, so never more than the full
    statistic, and its p-value."""
    upto = Window.partitionBy(*keys).orderBy("bin")  # one row per bin
    every = Window.partitionBy(*keys)
    summed = bins.groupBy(*keys, "bin").agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))
    run = summed.select(
        *keys, F.sum("base").over(upto).alias("b"), F.sum("cur").over(upto).alias("c"),
        F.sum("base").over(every).alias("n"), F.sum("cur").over(every).alias("m"),
    )
    shares = [F.col(x) / F.nullif(F.col(y), F.lit(0)) for x, y in (("b", "n"), ("c", "m"))]
    found = run.groupBy(*keys, "n", "m").agg(F.max(F.abs(shares[0] - shares[1])).alias("ks_statistic"))
    return found.select(*keys, "ks_statistic", ks_p_value(F.col("ks_statistic"), F.col("n"), F.col("m")).alias("ks_p_value"))


# ---------------------------------------------------------------- two-sample tests

def ks_p_value(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    t = distance * F.sqrt(n.cast("double") * m / (n + m))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.lit(0.0),
        lambda total, j: total + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * j * j * t * t),
    )
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * terms)))


def ks_tests(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Two-sample KS per feature, exact statistic, asymptotic p-value.

    Both tables are counted per distinct value first; the empirical distributions are
    then prefix sums over range buckets.
    """
    counts = both_sides(baseline, current)
    totals = counts.groupBy("feature").agg(F.sum("base").alias("n"), F.sum("cur").alias("m"))
    cumulated = running_totals(counts, ["value"], {"base_upto": "base", "cur_upto": "cur"}, ["feature"])
    gap = F.abs(F.col("base_upto") / F.col("n") - F.col("cur_upto") / F.col("m"))
    found = (
        cumulated.join(F.broadcast(totals), "feature").groupBy("feature", "n", "m").agg(F.max(gap).alias("ks_statistic"))
    )
    p = ks_p_value(F.col("ks_statistic"), F.col("n"), F.col("m"))
    return found.select("feature", "ks_statistic", p.alias("ks_p_value"), (p < P_LIMIT).alias("ks_drift"))


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return h * scale
    raise ArithmeticError(f"the tail of chi-square did not converge at {a}, {x}")


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, degrees: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; one value per feature."""
    values = [
        np.nan if pd.isna(s) or pd.isna(k) or k < 1 else _upper_gamma(k / 2, s / 2) for s, k in zip(statistic, degrees)
    ]
    return pd.Series(values, dtype="float64")


def chi_square_tests(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return chi_square_of_counts(both_sides(baseline, current))


def chi_square_of_counts(counts: DataFrame) -> DataFrame:
    """Goodness of fit of the current category shares to the baseline ones, from one row
    ``(feature, value, base, cur)`` per category.

    A category absent on one side has share 0.0001; shares are scaled by the number of
    current rows. ``sums_differ`` marks features whose two sides had different
    categories, for which the two scaled sums are not equal.
    """
    totals = counts.groupBy("feature").agg(F.sum("base").alias("n"), F.sum("cur").alias("m"))
    joined = counts.join(F.broadcast(totals), "feature")
    expected = F.when(F.col("base") == 0, ABSENT_SHARE).otherwise(F.col("base") / F.col("n"))
    observed = F.when(F.col("cur") == 0, ABSENT_SHARE).otherwise(F.col("cur") / F.col("m"))
    cells = joined.select(
        "feature",
        (expected * F.col("m")).alias("e"),
        (observed * F.col("m")).alias("o"),
        ((F.col("base") == 0) | (F.col("cur") == 0)).alias("one_sided"),
    )
    summed = cells.groupBy("feature").agg(
        F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2_statistic"),
        (F.count("*") - 1).alias("degrees"),
        F.bool_or("one_sided").alias("sums_differ"),
    )
    p = chi_square_p(F.col("chi2_statistic"), F.col("degrees"))
    scored = summed.withColumn("chi2_p_value", F.nanvl(p, F.lit(None).cast("double")))
    return scored.withColumn("chi2_drift", F.coalesce(F.col("chi2_p_value") < P_LIMIT, F.lit(False)))


# ---------------------------------------------------------------- verdicts

def numeric_verdicts(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """PSI, JS and KS per numeric feature; drift if PSI > 0.2 or KS says so."""
    bins = histograms(baseline, current)
    out = (
        psi_scores(bins)
        .join(F.broadcast(js_distances(bins)), "feature")
        .join(F.broadcast(ks_tests(baseline, current)), "feature")
    )
    return out.select(
        "feature",
        "psi",
        "js_distance",
        "ks_statistic",
        "ks_p_value",
        ((F.col("psi") > PSI_LIMIT) | F.col("ks_drift")).alias("has_drift"),
    )


def category_verdicts(baseline: DataFrame, current: DataFrame) -> DataFrame:
    tests = chi_square_tests(baseline, current)
    return tests.select("feature", "chi2_statistic", "chi2_p_value", F.col("chi2_drift").alias("has_drift"))
