"""Evaluation metrics: classification, ranking curves, regression and clustering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ref
from plumbline.functions.joins import lookup_join
from plumbline.operators.ordered import exact_quantiles, running_totals
from plumbline.session import materialize

# Smallest denominator of a relative error: the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16

# Clusters are broadcast and compared in blocks of this many.
CLUSTER_BLOCK = 4096


# ---------------------------------------------------------------- classification

def confusion_matrix(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, ref(actual).cast("string").alias("actual"), ref(predicted).cast("string").alias("predicted")).agg(
        F.count("*").alias("cnt")
    )


def class_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: true positives, actual and predicted rows (one row per class)."""
    actual = cells.select(*by, F.col("actual").alias("class"), F.col("cnt").alias("t"), F.lit(0).cast("long").alias("p"),
                          F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0).alias("tp"))
    predicted = cells.select(*by, F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("cnt").alias("p"), F.lit(0).cast("long").alias("tp"))
    return actual.unionByName(predicted).groupBy(*by, "class").agg(*[F.sum(c).cast("double").alias(c) for c in ("t", "p", "tp")])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for an empty denominator."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def classification_metrics(
    df: DataFrame, actual: str, predicted: str, positive: str = "1", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1, MCC, kappa, and - for two
    classes - specificity and sensitivity.

    With two actual classes precision, recall and F1 are those of ``positive``, else
    they are weighted by class size. Everything follows from the confusion matrix.
    """
    classes = class_counts(confusion_matrix(df, actual, predicted, by), by)
    t, p, tp = F.col("t"), F.col("p"), F.col("tp")
    recall, precision = ratio(tp, t), ratio(tp, p)
    f1 = ratio(2 * tp, t + p)
    is_pos = F.col("class") == positive

    def one(e: Column) -> Column:
        return F.coalesce(F.max(F.when(is_pos, e)), F.lit(0.0))

    sums = classes.groupBy(*by).agg(
        F.sum("t").alias("s"),
        F.sum("tp").alias("c"),
        F.sum(p * t).alias("pt"),
        F.sum(p * p).alias("pp"),
        F.sum(t * t).alias("tt"),
        F.count_if(t > 0).alias("k"),
        F.avg(F.when(t > 0, recall)).alias("balanced_accuracy"),
        F.sum(precision * t).alias("wp"),
        F.sum(recall * t).alias("wr"),
        F.sum(f1 * t).alias("wf"),
        one(precision).alias("bp"),
        one(recall).alias("br"),
        one(f1).alias("bf"),
        F.coalesce(F.max(F.when(~is_pos & (t > 0), recall)), F.lit(0.0)).alias("spec"),
    )
    s, c = F.col("s"), F.col("c")
    binary = F.col("k") == 2
    mcc_base = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    chance = F.col("pt") / (s * s)
    return sums.select(
        *by,
        (c / s).alias("accuracy"),
        "balanced_accuracy",
        F.when(binary, F.col("bp")).otherwise(F.col("wp") / s).alias("precision"),
        F.when(binary, F.col("br")).otherwise(F.col("wr") / s).alias("recall"),
        F.when(binary, F.col("bf")).otherwise(F.col("wf") / s).alias("f1_score"),
        ratio(c * s - F.col("pt"), mcc_base).alias("mcc"),
        F.when(chance != 1, (c / s - chance) / F.when(chance != 1, 1 - chance)).alias("kappa"),
        F.when(binary, F.col("spec")).alias("specificity"),
        F.when(binary, F.col("br")).alias("sensitivity"),
    )


# ---------------------------------------------------------------- ranking

def score_counts(df: DataFrame, actual: str, score: str, positive, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: equal scores become one row."""
    hit = (ref(actual) == F.lit(positive)).cast("long")
    return (
        df.where(ref(score).isNotNull())
        .groupBy(*by, ref(score).cast("double").alias("score"))
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
        .withColumn("down", -F.col("score"))
    )


def roc_points(df: DataFrame, actual: str, score: str, positive=1, by: Sequence[str] = ()) -> DataFrame:
    """True and false positive rate at every distinct score, the highest first."""
    counts = score_counts(df, actual, score, positive, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    upto = running_totals(counts, ["down"], {"tp": "pos", "fp": "neg"}, by)
    if by:
        joined = upto.join(F.broadcast(totals), list(by))  # one row per group
    else:
        one = totals.select(F.struct("P", "N").alias("t")).scalar()
        joined = upto.withColumn("_t", one).select("*", "_t.P", "_t.N")
    return joined.select(
        *by,
        F.col("score").alias("threshold"),
        "pos",
        "neg",
        "tp",
        "fp",
        "P",
        "N",
        F.try_divide("tp", "P").alias("tpr"),
        F.try_divide("fp", "N").alias("fpr"),
    )


def ranking_metrics(df: DataFrame, actual: str, score: str, positive=1, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties count half) and average precision from one pass over the points."""
    points = roc_points(df, actual, score, positive, by)
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return points.groupBy(*by).agg(
        F.try_divide(pairs, F.max("P") * F.max("N").cast("double")).alias("roc_auc"),
        F.try_divide(steps, F.max("P").cast("double")).alias("pr_auc"),
    )


def roc_auc_one_vs_rest(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """Unweighted mean over the classes of one-against-rest AUC; ``scores`` maps a class to
    its score column. All classes go through one set of prefix sums."""
    rows = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("class"),
                        (ref(actual).cast("string") == k).cast("int").alias("hit"),
                        ref(c).cast("double").alias("score"),
                    )
                    for k, c in scores.items()
                ]
            )
        )
    )
    return ranking_metrics(rows, "hit", "score", 1, ["class"]).agg(F.avg("roc_auc").alias("roc_auc"))


# ---------------------------------------------------------------- regression

def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R2, MAPE, median absolute error and explained variance."""
    rows = df.select(*by, ref(actual).cast("double").alias("y"), ref(predicted).cast("double").alias("z"))
    error = F.col("y") - F.col("z")
    sums = rows.groupBy(*by).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.abs(error) / F.greatest(F.abs("y"), F.lit(EPSILON))).alias("mape"),
        F.var_pop("y").alias("spread"),
        F.var_pop(error).alias("noise"),
    )
    middle = exact_quantiles(rows.select(*by, F.abs(error).alias("value")), by, [0.5])
    middle = middle.select(*by, F.element_at("quantiles", 1).alias("median_ae"))
    if by:
        joined = sums.join(F.broadcast(middle), list(by))
    else:
        joined = sums.withColumn("median_ae", middle.select("median_ae").scalar())

    def explained(loss: str) -> Column:
        return F.when(F.col("spread") > 0, 1 - F.col(loss) / F.when(F.col("spread") > 0, F.col("spread"))).otherwise(
            F.when(F.col(loss) == 0, 1.0).otherwise(0.0)
        )

    return joined.select(
        *by,
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        explained("mse").alias("r2"),
        "mape",
        "median_ae",
        explained("noise").alias("explained_variance"),
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", ref(actual) - ref(predicted))


# ---------------------------------------------------------------- clustering

def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _worst_neighbours(known: DataFrame) -> DataFrame:
    """Per cluster the largest ``(s_i + s_j) / distance`` to any other cluster.

    The clusters are compared with blocks of clusters, a block at a time on the driver.
    """
    def against(block: list) -> DataFrame:
        labels = np.array([r["label"] for r in block], dtype=object)
        spreads = np.array([r["s"] for r in block])
        centers = np.array([r["center"] for r in block])

        def scan(batches):
            for pdf in batches:
                worst = []
                for label, s, center in zip(pdf["label"], pdf["s"], pdf["center"]):
                    distance = np.sqrt(((centers - np.asarray(center)) ** 2).sum(axis=1))
                    ratios = np.where(distance > 0, (spreads + s) / np.where(distance > 0, distance, 1.0), 0.0)
                    worst.append(float(ratios[labels != label].max(initial=0.0)))
                yield pd.DataFrame({"label": pdf["label"], "worst": worst})

        return known.select("label", "s", "center").mapInPandas(scan, "label string, worst double")

    parts, block = [], []
    for r in known.toLocalIterator():
        block.append(r)
        if len(block) == CLUSTER_BLOCK:
            parts.append(against(block))
            block = []
    if block or not parts:
        parts.append(against(block))
    return reduce(DataFrame.unionByName, parts).groupBy("label").agg(F.max("worst").alias("worst"))


def cluster_scores(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of labelled vectors; 0 if there is at most one
    cluster or as many clusters as rows.

    Centroids are one aggregate and are written, distances to them a second; what is left
    is one row per cluster.
    """
    rows = df.select(ref(label).cast("string").alias("label"), ref(vector).cast("array<double>").alias("v"))
    parts = rows.select("label", F.posexplode("v").alias("i", "x"))
    means = materialize(parts.groupBy("label", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n")), "means")
    centroids = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center")
    )
    near = lookup_join(rows, centroids, ["label"], "inner", limit=CLUSTER_BLOCK)
    spread = near.select("label", squared_distance("v", "center").alias("d2")).groupBy("label").agg(
        F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"), F.count("*").alias("n")
    )
    known = materialize(spread.join(centroids, "label"), "clusters")
    middle = means.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mid"))
    gap = F.col("x") - F.col("mid")

    columns = {"within": "double", "rows": "long", "k": "long", "worst": "double", "between": "double"}

    def part(frame: DataFrame, **values: Column) -> DataFrame:
        return frame.agg(*[v.cast(columns[c]).alias(c) for c, v in values.items()]).select(
            *[F.col(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        )

    pieces = [
        part(known, within=F.sum("w"), rows=F.sum("n"), k=F.count("*")),
        part(_worst_neighbours(known), worst=F.avg("worst")),
        part(means.join(F.broadcast(middle), "i"), between=F.sum(F.col("n") * gap * gap)),
    ]
    final = reduce(DataFrame.unionByName, pieces).agg(*[F.max(c).alias(c) for c in columns])
    valid = (F.col("k") > 1) & (F.col("k") < F.col("rows"))
    ratio_ = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("rows") - F.col("k")))
    return final.select(
        F.when(valid, F.col("worst")).otherwise(0.0).alias("davies_bouldin"),
        F.when(valid, F.when(F.col("within") == 0, 1.0).otherwise(ratio_)).otherwise(0.0).alias("calinski_harabasz"),
    )
