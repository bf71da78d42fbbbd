"""Shape transforms: log1p, square root and Yeo-Johnson with a fitted exponent."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import missing, numeric_columns, per_column, present, ref
from plumbline.operators.profile import numeric_rows
from plumbline.operators.validate import corrected_skewness

GRID = 9
ROUNDS = 6


def yeo_johnson(x: Column, power: float) -> Column:
    """Yeo-Johnson transform with a known exponent; NULL stays NULL."""
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / F.lit(power)
    rest = 2.0 - power
    down = -F.log1p(-x) if abs(rest) < 1e-12 else -(F.pow(1 - x, F.lit(rest)) - 1) / F.lit(rest)
    return F.when(x >= 0, up).otherwise(F.when(x < 0, down))


def _from_log(size: Column, negative: Column, power: Column) -> Column:
    """The same transform from ``size = log1p(|x|)``, the sign, and an exponent column."""
    p = F.when(negative, 2 - power).otherwise(power)
    grown = F.when(F.abs(p) < 1e-12, size).otherwise((F.exp(size * p) - 1) / p)
    return F.when(negative, -grown).otherwise(grown)


def fit_powers(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Maximum-likelihood exponents of several columns by grid refinement.

    Each round is one aggregate that scores the same number of exponents for every
    column; a window that ends at its edge moves before it narrows. A parabola through
    the last three points gives the final digits.
    """
    names = list(names)
    if not names:
        return {}
    spark = df.sparkSession
    logs = numeric_rows(df, names).select(
        "column_name", F.log1p(F.abs("value")).alias("size"), (F.col("value") < 0).alias("negative")
    )
    signed = F.when(F.col("negative"), -F.col("size")).otherwise(F.col("size"))
    base = {
        r["column_name"]: (r["n"], r["total"])
        for r in logs.groupBy("column_name").agg(F.count("*").alias("n"), F.sum(signed).alias("total")).collect()
    }
    names = [c for c in names if c in base]
    centers = {c: 0.0 for c in names}
    half = {c: 2.0 for c in names}
    best: dict[str, float] = {}
    done = {c: 0 for c in names}
    while any(n < ROUNDS for n in done.values()):
        grids = {
            c: [centers[c] - half[c] + 2 * half[c] * i / (GRID - 1) for i in range(GRID)]
            for c in names
            if done[c] < ROUNDS
        }
        points = [(c, i, p) for c, grid in grids.items() for i, p in enumerate(grid)]
        grid_rows = F.broadcast(spark.createDataFrame(points, "column_name string, i int, power double"))
        spreads = {
            (r["column_name"], r["i"]): r["spread"]
            for r in logs.join(grid_rows, "column_name")
            .groupBy("column_name", "i")
            .agg(F.var_pop(_from_log(F.col("size"), F.col("negative"), F.col("power"))).alias("spread"))
            .collect()
        }
        for c, grid in grids.items():
            scores = [_likelihood(spreads.get((c, i)), *base[c], p) for i, p in enumerate(grid)]
            top = max(range(GRID), key=lambda i: scores[i])
            if scores[top] == float("-inf"):
                best[c], done[c] = 1.0, ROUNDS
                continue
            if top in (0, GRID - 1) and abs(grid[top]) < 50:
                centers[c] = grid[top]
                continue
            step = 2 * half[c] / (GRID - 1)
            best[c] = _vertex(grid, scores, top, step)
            centers[c], half[c] = grid[top], step
            done[c] += 1
    return best


def _likelihood(spread: float | None, n: int, total: float, power: float) -> float:
    if spread is None or not 0 < spread < float("inf"):
        return float("-inf")
    return -n / 2 * math.log(spread) + (power - 1) * total


def _vertex(grid, scores, top, step) -> float:
    if top in (0, len(grid) - 1):
        return grid[top]
    a, b, c = scores[top - 1], scores[top], scores[top + 1]
    bend = a - 2 * b + c
    if bend >= 0 or float("-inf") in (a, c):
        return grid[top]
    return grid[top] + step * 0.5 * (a - c) / bend


@dataclass
class Transformer:
    methods: dict[str, str] = field(default_factory=dict)
    powers: dict[str, float] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        def shaped(c: str) -> Column:
            x = present(df, c).cast("double")
            kind = self.methods.get(c)
            if kind == "log1p":
                return F.log1p(x).alias(c)
            if kind == "sqrt":
                return F.sqrt(x).alias(c)
            if kind == "yeo_johnson":
                return yeo_johnson(x, self.powers[c]).alias(c)
            return ref(c)

        return df.select(*[shaped(c) for c in df.columns])

    def params(self, spark) -> DataFrame:
        rows = [(c, m, self.powers.get(c)) for c, m in self.methods.items()]
        return spark.createDataFrame(rows, "column_name string, method string, power double")


def fit_transformer(
    df: DataFrame,
    apply_log: bool = False,
    apply_sqrt: bool = False,
    apply_yeo_johnson: bool = False,
    skew_threshold: float = 1.0,
    auto_skewed: bool = True,
    exclude: Sequence[str] = (),
) -> Transformer:
    """Choose a transform per numeric column and fit the exponents that need fitting.

    A skewed column takes Yeo-Johnson first; log needs positive and square root
    non-negative values everywhere, a missing one included. Log wins over square root
    even where it does not apply.
    """
    names = numeric_columns(df, exclude)
    if not names:
        return Transformer()

    def x(c):
        return present(df, c).cast("double")

    rows = per_column(
        df,
        names,
        {
            "n": lambda c: F.count(x(c)),
            "gaps": lambda c: F.count_if(missing(df, c)),
            "low": lambda c: F.min(x(c)),
            "skew": lambda c: corrected_skewness(F.skewness(x(c)), F.count(x(c)), F.var_pop(x(c))),
        },
    ).collect()
    out = Transformer()
    for r in rows:
        c = r["column_name"]
        if auto_skewed and r["skew"] is not None and abs(r["skew"]) > skew_threshold:
            out.methods[c] = "yeo_johnson"
        elif apply_log:
            if not r["gaps"] and r["low"] is not None and r["low"] > 0:
                out.methods[c] = "log1p"
        elif apply_sqrt:
            if not r["gaps"] and r["low"] is not None and r["low"] >= 0:
                out.methods[c] = "sqrt"
        elif apply_yeo_johnson:
            out.methods[c] = "yeo_johnson"
    out.powers = fit_powers(df, [c for c, m in out.methods.items() if m == "yeo_johnson"])
    return out
