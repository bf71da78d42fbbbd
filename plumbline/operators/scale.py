"""Feature scaling: standard, min-max, robust, max-abs and unit rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import missing, numeric_columns, per_column, present, ref
from plumbline.operators.profile import quantile_columns


@dataclass
class Scaler:
    """Fitted ``(x - center) / scale`` per column; unit rows have no parameters."""

    strategy: str
    columns: list[str]
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "none" or not self.columns:
            return df
        if self.strategy == "normalizer":
            squares = sum((ref(c).cast("double") * ref(c) for c in self.columns), F.lit(0.0))
            norm = F.sqrt(squares)
            out = {c: ref(c) / F.when(norm == 0, 1.0).otherwise(norm) for c in self.columns}
        else:
            out = {
                c: (present(df, c).cast("double") - F.lit(self.center[c])) / F.lit(self.scale[c])
                for c in self.columns
            }
        return df.select(*[out[c].alias(c) if c in out else ref(c) for c in df.columns])

    def params(self, spark) -> DataFrame:
        """Centre, scale and limits as usual scalers name them, one row per column."""
        schema = "column_name string, strategy string, center double, scale double, data_min double, data_max double"
        rows = []
        for c in self.columns:
            low, high = self.limits.get(c, (None, None))
            hide = self.strategy == "minmax"
            rows.append((c, self.strategy, None if hide else self.center.get(c), None if hide else self.scale.get(c), low, high))
        return spark.createDataFrame(rows, schema)


def fit_scaler(
    df: DataFrame, strategy: str = "auto", exclude: Sequence[str] = (), approx: bool = False
) -> Scaler:
    """Fit one scaler for all numeric columns; ``auto`` is robust scaling.

    Standard scaling uses the population deviation. A zero spread divides by 1.
    """
    strategy = "robust" if strategy == "auto" else strategy
    if strategy not in ("standard", "minmax", "robust", "maxabs", "normalizer", "none"):
        raise ValueError(f"unknown strategy {strategy!r}")
    names = numeric_columns(df, exclude)
    out = Scaler(strategy, names)
    if not names or strategy == "none":
        return out

    def x(c):
        return present(df, c).cast("double")

    if strategy == "robust":
        rows = quantile_columns(df, names, {"low": 0.25, "mid": 0.5, "high": 0.75}, approx).collect()
        fits = {r["column_name"]: (r["mid"], r["high"] - r["low"]) for r in rows}
    elif strategy == "standard":
        rows = per_column(df, names, {"m": lambda c: F.avg(x(c)), "s": lambda c: F.stddev_pop(x(c))}).collect()
        fits = {r["column_name"]: (r["m"], r["s"]) for r in rows}
    elif strategy == "minmax":
        rows = per_column(df, names, {"lo": lambda c: F.min(x(c)), "hi": lambda c: F.max(x(c))}).collect()
        fits = {r["column_name"]: (r["lo"], None if r["lo"] is None else r["hi"] - r["lo"]) for r in rows}
        out.limits = {r["column_name"]: (r["lo"], r["hi"]) for r in rows}
    elif strategy == "maxabs":
        rows = per_column(df, names, {"m": lambda c: F.max(F.abs(x(c)))}).collect()
        fits = {r["column_name"]: (0.0, r["m"]) for r in rows}
    else:
        if df.where(F.greatest(*[missing(df, c) for c in names], F.lit(False))).limit(1).count():
            raise ValueError("unit rows need a value in every numeric column")
        return out
    for c in names:
        center, scale = fits.get(c, (None, None))
        out.center[c] = center if center is not None else 0.0
        out.scale[c] = scale if scale else 1.0
    return out
