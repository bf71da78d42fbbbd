"""Monitoring runs: baseline snapshots, drift reports over a window, and their events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import drift
from plumbline.operators.tables import in_window
from plumbline.session import materialize

EVENT_TYPE = "HIGH_DRIFT_DETECTED"

# Size of a quantile sketch, and the ranks at which two sketches are compared.
SKETCH_SIZE = 2048
PROBES = 1000


def drift_report(
    baseline: DataFrame, current: DataFrame, numeric: Sequence[str] = (), categories: Sequence[str] = ()
) -> DataFrame:
    """One row per feature: kind, the measures that apply, and the verdict."""
    names = ("psi", "js_distance", "ks_statistic", "ks_p_value", "chi2_statistic", "chi2_p_value")

    def shaped(df: DataFrame, kind: str) -> DataFrame:
        cols = [(F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in names]
        return df.select("feature", F.lit(kind).alias("kind"), *cols, "has_drift")

    parts = []
    if numeric:
        parts.append(shaped(drift.numeric_verdicts(drift.feature_rows(baseline, numeric), drift.feature_rows(current, numeric)), "numerical"))
    if categories:
        parts.append(shaped(drift.category_verdicts(drift.category_rows(baseline, categories), drift.category_rows(current, categories)), "categorical"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def overall_drift(report: DataFrame) -> DataFrame:
    """Share of drifted features; data drift from 0.3 on."""
    score = F.avg(F.col("has_drift").cast("double"))
    return report.agg(
        F.count("*").alias("features"),
        F.count_if("has_drift").alias("drifted"),
        score.alias("overall_drift_score"),
        (score >= drift.SCORE_LIMIT).alias("has_data_drift"),
    )


def drift_events(overall: DataFrame, model_version: str, report_id: str) -> DataFrame:
    """The warning event a drifted report gives rise to, with a JSON payload."""
    payload = F.to_json(
        F.struct(
            F.lit(model_version).alias("model_version_id"),
            F.col("overall_drift_score").alias("drift_score"),
            F.lit(report_id).alias("report_id"),
        )
    )
    title = F.concat(F.lit("Data Drift Detected (Score: "), F.format_number("overall_drift_score", 2), F.lit(")"))
    return overall.where("has_data_drift").select(
        F.lit(EVENT_TYPE).alias("event_type"),
        F.lit("WARNING").alias("severity"),
        title.alias("title"),
        payload.alias("payload"),
        F.lit("pending").alias("status"),
    )


def monitoring_run(
    history: DataFrame, time: str, baseline: tuple, window: tuple, numeric: Sequence[str] = (), categories: Sequence[str] = ()
) -> DataFrame:
    """Drift report of one time window of a log against an earlier one; both filters
    reach the scan, and prune partitions of a log laid out by time."""
    wanted = [*numeric, *categories]
    before = in_window(history, time, *baseline).select(*wanted)
    now = in_window(history, time, *window).select(*wanted)
    return drift_report(before, now, numeric, categories)


# ---------------------------------------------------------------- stored baselines

def baseline_snapshot(df: DataFrame, numeric: Sequence[str], buckets: int = drift.BUCKETS) -> DataFrame:
    """What later runs need of a baseline: size, mean, deviation, range and bin counts per
    feature. The raw baseline is not read again."""
    rows = drift.feature_rows(df, numeric)
    stats = rows.groupBy("feature").agg(
        F.count("*").alias("sample_size"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    bins = drift.histograms(rows, rows.limit(0), buckets, stats.select("feature", "low", "high"))
    counts = bins.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "base"))), lambda s: s["base"]).alias("bin_counts")
    )
    return stats.join(F.broadcast(counts), "feature")


def drift_against_snapshot(snapshot: DataFrame, current: DataFrame, numeric: Sequence[str], buckets: int = drift.BUCKETS) -> DataFrame:
    """PSI, JS and KS of a table against a stored baseline; drift by PSI or KS.

    The snapshot keeps bins, so KS is taken on their edges; values outside the baseline's
    range count there, and only there. Without any current value in range JS is NULL.
    """
    ranges = snapshot.select("feature", "low", "high")
    rows = drift.feature_rows(current, numeric)
    bins = materialize(drift.histograms(rows.limit(0), rows, buckets, ranges, outside=True), "bins")
    stored = snapshot.select("feature", F.posexplode("bin_counts").alias("bin", "base"))
    return bin_verdicts(bins.select("feature", "bin", "cur"), stored)


def bin_verdicts(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``current(feature, bin, cur)``, values outside the range included, against the stored
    ``(feature, bin, base)``: PSI, JS and KS per feature and the verdict by PSI or KS."""
    both = current.join(F.broadcast(stored), ["feature", "bin"], "left").select("feature", "bin", F.coalesce("base", F.lit(0)).alias("base"), "cur")
    inner = both.join(F.broadcast(stored.select("feature", "bin")), ["feature", "bin"], "left_semi")
    scored = drift.psi_scores(inner).join(F.broadcast(drift.js_distances(inner)), "feature").join(F.broadcast(drift.edge_tests(both)), "feature")
    verdict: Column = (F.col("psi") > drift.PSI_LIMIT) | F.coalesce(F.col("ks_p_value") < drift.P_LIMIT, F.lit(False))
    return scored.withColumn("has_drift", verdict)


# ---------------------------------------------------------------- baselines that merge

def baseline_sketch(df: DataFrame, numeric: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """A numeric baseline that merges: per feature its size, mean, sum of squared deviations,
    range and a quantile sketch. One scan; a sketch has a few KB whatever the rows."""
    return drift.feature_rows(df, numeric).groupBy("feature").agg(
        F.count("*").alias("sample_size"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("*")).alias("deviations"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", size).alias("sketch"),
    )


def merge_baselines(parts: DataFrame) -> DataFrame:
    """One baseline of several (say, of days, as a union): what ``baseline_sketch`` over all
    their rows gives, within the error of the sketch. Rows are parts times features."""
    mean = F.sum(F.col("sample_size") * F.col("mean")).over(Window.partitionBy("feature")) / F.sum("sample_size").over(Window.partitionBy("feature"))
    centred = parts.withColumn("_mean", mean)
    apart = F.col("mean") - F.col("_mean")
    return centred.groupBy("feature").agg(
        F.sum("sample_size").alias("sample_size"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("deviations") + F.col("sample_size") * apart * apart).alias("deviations"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketch_error(size: int = SKETCH_SIZE, probes: int = PROBES) -> float:
    """Bound of the KS distance of two sketches against the exact one: the normalised rank
    error of both (99 % confidence each) and the step of the probed ranks of both."""
    return 2 * 2.296 / size**0.9021 + 2 / probes


def drift_against_sketch(baseline: DataFrame, current: DataFrame, numeric: Sequence[str], size: int = SKETCH_SIZE, probes: int = PROBES) -> DataFrame:
    """KS of a table against a merged baseline, within ``sketch_error``. A feature drifts if
    the distance less the error says so, so the sketch alone never raises an alarm.

    Both sketches give ``probes + 1`` quantiles; how many of them lie up to a value is the
    rank of the value, and the largest gap of ranks at any quantile is the distance.
    """
    ranks = F.array(*[F.lit(i / probes) for i in range(probes + 1)])
    zero = F.lit(0).cast("long")

    def quantiles(sketches: DataFrame, base: Column, cur: Column) -> DataFrame:
        points = F.explode(F.kll_sketch_get_quantile_double("sketch", ranks))
        return sketches.where("sample_size > 0").select("feature", points.alias("value"), base.alias("base"), cur.alias("cur"))

    now = baseline_sketch(current, numeric, size)
    points = quantiles(baseline, F.lit(1), zero).unionByName(quantiles(now, zero, F.lit(1)))
    steps = points.groupBy("feature", "value").agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))
    upto = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)

    def rank(side: str) -> Column:
        return F.greatest(F.sum(side).over(upto) - 1, zero) / probes

    gaps = steps.select("feature", F.abs(rank("base") - rank("cur")).alias("gap")).groupBy("feature").agg(F.max("gap").alias("ks_statistic"))
    sizes = baseline.select("feature", F.col("sample_size").alias("n")).join(now.select("feature", F.col("sample_size").alias("m")), "feature")
    tested = gaps.join(F.broadcast(sizes), "feature")
    error = F.lit(sketch_error(size, probes))
    sure = F.greatest(F.lit(0.0), F.col("ks_statistic") - error)
    return tested.select(
        "feature",
        "ks_statistic",
        error.alias("ks_error"),
        drift.ks_p_value(F.col("ks_statistic"), F.col("n"), F.col("m")).alias("ks_p_value"),
        (drift.ks_p_value(sure, F.col("n"), F.col("m")) < drift.P_LIMIT).alias("has_drift"),
    )


def category_snapshot(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The categorical side of a baseline: ``(feature, value, base)``, one row per value.

    Counts are exact and stay a table, so a feature of very many values is no row, list or
    broadcast; missing values are left out, as in the tests.
    """
    return drift.category_rows(df, categories).groupBy("feature", "value").agg(F.count("*").alias("base"))


def merge_category_snapshots(parts: DataFrame) -> DataFrame:
    """One snapshot of several, exactly that over all their rows."""
    return parts.groupBy("feature", "value").agg(F.sum("base").alias("base"))


def category_drift_against_snapshot(snapshot: DataFrame, current: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Chi-square of a table's categories against a stored snapshot of those features."""
    stored = snapshot.where(F.col("feature").isin(*categories)).select("feature", "value", "base", F.lit(0).cast("long").alias("cur"))
    now = category_snapshot(current, categories).select("feature", "value", F.lit(0).cast("long").alias("base"), F.col("base").alias("cur"))
    counts = stored.unionByName(now).groupBy("feature", "value").agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))
    return drift.chi_square_of_counts(counts).select("feature", "chi2_statistic", "chi2_p_value", F.col("chi2_drift").alias("has_drift"))
