"""Feature selection: variance, correlation, ANOVA F and mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import no_rows, numeric_columns, per_column, present, ref
from plumbline.operators.profile import quantile_columns

MI_BINS = 16


def filled(df: DataFrame, name: str):
    return F.coalesce(present(df, name).cast("double"), F.lit(0.0))


def variances(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Population variance of each numeric column, missing values as 0."""
    names = numeric_columns(df, exclude)
    if not names:
        return no_rows(df, "column_name string, variance double")
    return per_column(df, names, {"variance": lambda c: F.var_pop(filled(df, c))})


def correlations(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows that have both.

    Each Arrow batch adds to a few column-by-column product matrices; a partition emits
    one row per pair, and the sums per pair are the only shuffle. Values are shifted by
    the column mean first, which keeps the sums well scaled.
    """
    names = numeric_columns(df, exclude)
    if len(names) < 2:
        return no_rows(df, "col_a string, col_b string, correlation double")
    means = {r["column_name"]: r["m"] or 0.0 for r in per_column(df, names, {"m": lambda c: F.avg(present(df, c).cast("double"))}).collect()}
    shift = np.array([means[c] for c in names])

    def products(batches):
        size = len(names)
        n, sx, sxx, sxy = (np.zeros((size, size)) for _ in range(4))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float, na_value=np.nan) - shift
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            n += has.T @ has
            sx += x.T @ has
            sxx += (x * x).T @ has
            sxy += x.T @ x
        a, b = np.triu_indices(size, 1)
        yield pd.DataFrame(
            {"a": a, "b": b, "n": n[a, b], "sa": sx[a, b], "sb": sx[b, a], "saa": sxx[a, b], "sbb": sxx[b, a], "sab": sxy[a, b]}
        )

    numbers = df.select(*[present(df, c).cast("double").alias(c) for c in names])
    sums = numbers.mapInPandas(products, "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    spread_a = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    spread_b = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    value = F.when(
        (spread_a > 0) & (spread_b > 0),
        (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / (F.sqrt(spread_a) * F.sqrt(spread_b)),
    )
    labels = F.array(*[F.lit(c) for c in names])
    return total.select(
        F.element_at(labels, F.col("a") + 1).alias("col_a"), F.element_at(labels, F.col("b") + 1).alias("col_b"), value.alias("correlation")
    )


def anova_scores(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    """ANOVA F of each numeric column against the classes of ``target``."""
    names = numeric_columns(df, [target, *exclude])
    wide = df.select(ref(target).alias("_class"), *[filled(df, c).alias(c) for c in names])
    rows = wide.unpivot(["_class"], names, "column_name", "value").where(F.col("_class").isNotNull())
    classes = rows.groupBy("column_name", "_class").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    totals = classes.groupBy("column_name").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("groups"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
    )
    within = classes.join(F.broadcast(totals), "column_name").groupBy("column_name", "total", "groups").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    score = F.try_divide(
        F.col("between") / F.nullif(F.col("groups") - 1, F.lit(0)),
        F.col("within") / F.nullif(F.col("total") - F.col("groups"), F.lit(0)),
    )
    return within.select("column_name", score.alias("f_score"))


def mutual_information(df: DataFrame, target: str, bins: int = MI_BINS, exclude: Sequence[str] = ()) -> DataFrame:
    """Plug-in mutual information (nats) between quantile bins of each numeric column and
    the classes of ``target``."""
    names = numeric_columns(df, [target, *exclude])
    wide = df.select(ref(target).cast("string").alias("_class"), *[filled(df, c).alias(c) for c in names])
    rows = wide.unpivot(["_class"], names, "column_name", "value").where(F.col("_class").isNotNull())
    shares = {f"q{i}": i / bins for i in range(1, bins)}
    edges = quantile_columns(wide.where(F.col("_class").isNotNull()), names, shares)
    edges = edges.select("column_name", F.array(*shares).alias("quantiles"))
    bin_ = sum(((F.col("value") > F.element_at("quantiles", i)).cast("int") for i in range(1, bins)), F.lit(0))
    cells = (
        rows.join(F.broadcast(edges), "column_name")
        .groupBy("column_name", bin_.alias("bin"), "_class")
        .agg(F.count("*").cast("double").alias("n"))
    )
    counted = cells.select(
        "*",
        F.sum("n").over(Window.partitionBy("column_name", "bin")).alias("nx"),
        F.sum("n").over(Window.partitionBy("column_name", "_class")).alias("ny"),
        F.sum("n").over(Window.partitionBy("column_name")).alias("total"),
    )
    share = F.col("n") / F.col("total")
    return counted.groupBy("column_name").agg(
        F.sum(share * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mutual_information")
    )


@dataclass
class Selection:
    strategy: str
    dropped: list[str] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)
    target: str | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in self.dropped and c != self.target]
        if self.target and self.target in df.columns:
            kept.append(self.target)
        return df.select(*[ref(c) for c in kept])


def correlated_columns(pairs, threshold: float) -> list[str]:
    """Columns whose correlation with any earlier column is above the threshold."""
    out = []
    for r in pairs:
        if r["correlation"] is not None and abs(r["correlation"]) > threshold and r["col_b"] not in out:
            out.append(r["col_b"])
    return out


def best_k(scores: dict[str, float | None], order: Sequence[str], k: int, later_wins: bool) -> set[str]:
    floor = float("-inf")
    places = {c: i for i, c in enumerate(order)}
    ranked = sorted(
        order,
        key=lambda c: (scores.get(c) if scores.get(c) is not None else floor, places[c] if later_wins else -places[c]),
        reverse=True,
    )
    return set(ranked[:k])


def fit_selection(
    df: DataFrame,
    strategy: str = "auto",
    target: str | None = None,
    variance_threshold: float = 0.01,
    correlation_threshold: float = 0.95,
    k_best: int = 20,
) -> Selection:
    """Choose the columns to drop; the target is set aside and comes last.

    ``auto`` filters by variance, then by correlation. ``kbest`` and ``mutual_info``
    do nothing up to ``k_best`` numeric columns, and never drop other columns.
    """
    out = Selection(strategy, target=target)
    features = df.drop(target) if target else df
    has_target = target is not None and target in df.columns
    if strategy in ("variance", "auto"):
        low = [r["column_name"] for r in variances(features).collect() if r["variance"] is not None and r["variance"] <= variance_threshold]
        order = [c for c in features.columns if c in set(low)]
        out.dropped += order
        out.actions.append(f"variance_threshold={variance_threshold}: dropped {len(order)} cols")
        features = features.drop(*order)
    if strategy in ("correlation", "auto"):
        names = numeric_columns(features)
        drop = []
        if len(names) >= 2:
            drop = correlated_columns(correlations(features).collect(), correlation_threshold)
        out.dropped += [c for c in names if c in set(drop)]
        out.actions.append(f"correlation_threshold={correlation_threshold}: dropped {len(drop)} cols")
    if strategy in ("kbest", "mutual_info") and has_target:
        names = numeric_columns(df, [target])
        if len(names) > k_best:
            anova = strategy == "kbest"
            table = anova_scores(df, target) if anova else mutual_information(df, target)
            scores = {r[0]: r[1] for r in table.collect()}
            keep = best_k(scores, names, k_best, later_wins=anova)
            out.dropped += [c for c in names if c not in keep]
        out.actions.append(f"{strategy} top-{k_best}")
    return out
