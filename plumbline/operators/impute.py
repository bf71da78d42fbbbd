"""Missing-value treatment: fitted fills, ordered fills, dropped rows and columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import family, missing, per_column, present, ref
from plumbline.operators.ordered import carry_forward
from plumbline.operators.profile import quantile_columns, value_counts

STRATEGIES = ("mean", "median", "mode", "constant", "ffill", "bfill", "drop_rows", "drop_columns", "auto")
EMPTY_FILL = "unknown"


@dataclass
class Imputer:
    """Fitted fills: at most one small value per column, so ``transform`` is a projection."""

    strategy: str
    fills: dict[str, Any] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)
    dropped_columns: list[str] = field(default_factory=list)
    row_filter: list[str] = field(default_factory=list)
    ordered: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame, order_by: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
        out = df
        for c in self.row_filter:
            out = out.where(~missing(df, c))
        if self.ordered:
            if not order_by:
                raise ValueError("forward and backward fill need order_by")
            clean = out.select(*[present(df, c).alias(c) if c in self.ordered else ref(c) for c in df.columns])
            out = carry_forward(clean, self.ordered, order_by, groups, backward=self.strategy == "bfill")
        kept = [c for c in df.columns if c not in self.dropped_columns]
        return out.select(*[self._filled(df, c) for c in kept])

    def _filled(self, df: DataFrame, name: str):
        if name not in self.fills:
            return ref(name)
        dtype = df.schema[name].dataType
        value = self.fills[name]
        if family(dtype) == "integer" and isinstance(value, float):
            return F.coalesce(present(df, name).cast("double"), F.lit(value)).alias(name)
        return F.coalesce(present(df, name), F.lit(value).cast(dtype)).alias(name)

    def report(self, spark) -> DataFrame:
        rows = [(c, a, None if c not in self.fills else str(self.fills[c])) for c, a in self.actions.items()]
        return spark.createDataFrame(rows, "column_name string, action string, fill string")


def modes_of(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column as text, the smallest of ties (by column type)."""
    if not names:
        return {}
    counts = value_counts(df, names)
    best = F.lit(None).cast("struct<a:bigint,b:double,c:string>")
    numeric = [c for c in names if family(df.schema[c].dataType) in ("integer", "float")]
    number = F.when(F.col("column_name").isin(*numeric), F.col("value").try_cast("double")) if numeric else F.lit(0.0)
    best = F.struct(-F.col("cnt"), number, F.col("value"))
    rows = counts.groupBy("column_name").agg(F.min_by("value", best).alias("mode")).collect()
    return {r["column_name"]: r["mode"] for r in rows}


def fit_imputer(
    df: DataFrame,
    strategy: str = "auto",
    fill_value: Any = None,
    threshold: float = 0.5,
    threshold_strict: bool = False,
    columns: Sequence[str] | None = None,
) -> Imputer:
    """Choose and fit a treatment per column with missing values.

    ``drop_columns`` drops every column that misses anything; with
    ``threshold_strict`` only those above ``threshold``. ``auto`` drops columns above
    the threshold, takes the median of numeric ones and the mode of the others.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    names = list(columns or df.columns)
    counts = per_column(
        df,
        names,
        {"rows_": lambda c: F.count(F.lit(1)), "missing_": lambda c: F.sum(missing(df, c).cast("long"))},
    ).collect()
    gaps = {r["column_name"]: r["missing_"] / r["rows_"] for r in counts if r["missing_"]}
    numeric = {c for c in gaps if family(df.schema[c].dataType) in ("integer", "float")}
    out = Imputer(strategy, actions={c: "no_action" for c in names if c not in gaps})

    plan: dict[str, str] = {}
    for c, share in gaps.items():
        choice = strategy
        if strategy == "auto":
            choice = "drop_columns" if share > threshold else "median" if c in numeric else "mode"
        if choice == "drop_columns" and strategy == "drop_columns" and threshold_strict and share <= threshold:
            out.actions[c] = "no_action"
            continue
        if choice in ("mean", "median") and c not in numeric:
            choice = "mode"
        plan[c] = choice

    means = [c for c, p in plan.items() if p == "mean"]
    if means:
        for r in per_column(df, means, {"v": lambda c: F.avg(present(df, c).cast("double"))}).collect():
            out.fills[r["column_name"]] = r["v"]
    medians = [c for c, p in plan.items() if p == "median"]
    if medians:
        for r in quantile_columns(df, medians, {"v": 0.5}).collect():
            out.fills[r["column_name"]] = r["v"]
    wanted = [c for c, p in plan.items() if p == "mode"]
    found = modes_of(df, wanted)
    for c in wanted:
        value = found.get(c, EMPTY_FILL if family(df.schema[c].dataType) == "string" else None)
        if value is not None:
            out.fills[c] = value
    for c, p in plan.items():
        if p == "drop_columns":
            out.dropped_columns.append(c)
        elif p == "drop_rows":
            out.row_filter.append(c)
        elif p in ("ffill", "bfill"):
            out.ordered.append(c)
        elif p == "constant":
            out.fills[c] = 0 if fill_value is None else fill_value
        out.actions[c] = {"drop_columns": "dropped_column", "drop_rows": "dropped_rows", "ffill": "forward_filled",
                          "bfill": "backward_filled"}.get(p, f"filled_{p}")
    return out


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value in ``columns``."""
    for c in columns or df.columns:
        df = df.where(~missing(df, c))
    return df
