"""Categorical encoders: one-hot, label, ordinal and frequency."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import categorical_columns, ref
from plumbline.functions.joins import lookup_join
from plumbline.operators.ordered import dense_index
from plumbline.session import materialize

# A one-hot step turns each value into a column; wider results belong to another encoder.
MAX_ONE_HOT = 2_000
LITERAL_ROWS = 10_000
NULL_CLASS = "nan"


def as_text(df: DataFrame, name: str) -> Column:
    """Category text of a value; truth values read True and False."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(ref(name), "True").when(~ref(name), "False")
    return ref(name).cast("string")


@dataclass
class Encoder:
    """Fitted encoders by column: category lists for one-hot, tables for the others."""

    categories: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    strategies: dict[str, str] = field(default_factory=dict)
    drop_first: bool = False

    def new_columns(self, name: str) -> list[str]:
        return [f"{name}_{v}" for v in self.categories[name][1 if self.drop_first else 0:]]

    def transform(self, df: DataFrame) -> DataFrame:
        order = [c for c in df.columns if c not in self.categories]
        added = []
        for c, values in self.categories.items():
            for v, label in zip(values[1 if self.drop_first else 0:], self.new_columns(c)):
                added.append(as_text(df, c).eqNullSafe(F.lit(v)).cast("int").alias(label))
                order.append(label)
        out = df.select("*", *added)
        for c, table in self.tables.items():
            kind = self.strategies[c]
            key = as_text(df, c)
            if kind == "label":
                key = F.coalesce(key, F.lit(NULL_CLASS))
            keyed = out.withColumn("_value", key)
            mapped = lookup_join(keyed, table.withColumnRenamed("value", "_value"), ["_value"], "left", weight="cnt")
            missing = {"ordinal": F.lit(-1).cast("long"), "frequency": F.lit(0.0)}.get(kind)
            code = F.col("_code") if missing is None else F.coalesce("_code", missing)
            out = mapped.withColumn(c, code).drop("_value", "_code")
        return out.select(*[ref(c) for c in order])

    def report(self, spark) -> DataFrame:
        rows = [(c, s, self.new_columns(c) if c in self.categories else []) for c, s in self.strategies.items()]
        return spark.createDataFrame(rows, "column_name string, strategy string, generated_columns array<string>")


def counts_of(df: DataFrame, name: str, null_class: str | None = None) -> DataFrame:
    text = as_text(df, name)
    if null_class is not None:
        text = F.coalesce(text, F.lit(null_class))
    rows = df.select(text.alias("value")).where(F.col("value").isNotNull())
    return rows.groupBy("value").agg(F.count("*").alias("cnt"))


def few_rows(table: DataFrame, most: int) -> list | None:
    """The rows of a table if there are at most ``most``; reads one more to know."""
    rows = table.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def code_table(df: DataFrame, name: str, null_class: str | None = None) -> DataFrame:
    """``(value, cnt, _code)``: 0-based rank of each value in code-point order.

    Few values are ranked on the driver; many are ranked over range buckets and written.
    """
    counts = counts_of(df, name, null_class)
    few = few_rows(counts, LITERAL_ROWS)
    if few is None:
        counts = materialize(counts, "counts")
        return materialize(dense_index(counts, "value").withColumnRenamed("position", "_code"), "codes")
    ranked = [(v, n, i) for i, (v, n) in enumerate(sorted((r["value"], r["cnt"]) for r in few))]
    return df.sparkSession.createDataFrame(ranked, "value string, cnt long, _code long")


def share_table(df: DataFrame, name: str) -> DataFrame:
    """``(value, cnt, _code)``: share of each value among the non-missing ones."""
    counts = counts_of(df, name)
    few = few_rows(counts, LITERAL_ROWS)
    if few is None:
        counts = materialize(counts, "counts")
        total = counts.agg(F.sum("cnt")).first()[0]
        return counts.withColumn("_code", F.col("cnt") / F.lit(float(total)))
    total = sum(r["cnt"] for r in few) or 1
    shares = [(r["value"], r["cnt"], r["cnt"] / total) for r in few]
    return df.sparkSession.createDataFrame(shares, "value string, cnt long, _code double")


def fit_encoder(
    df: DataFrame,
    strategy: str = "auto",
    max_one_hot: int = 10,
    drop_first: bool = False,
    exclude: Sequence[str] = (),
    most_columns: int = MAX_ONE_HOT,
) -> Encoder:
    """Fit an encoder for every text and truth column not excluded.

    ``auto`` takes one-hot up to ``max_one_hot`` distinct values and label codes beyond. A
    one-hot step that is asked for may make up to ``most_columns`` columns, else it raises.
    """
    if strategy not in ("auto", "onehot", "label", "ordinal", "frequency"):
        raise ValueError(f"unknown strategy {strategy!r}")
    out = Encoder(drop_first=drop_first)
    for c in categorical_columns(df, exclude):
        kind, values = strategy, None
        if kind in ("auto", "onehot"):
            values = few_rows(counts_of(df, c).select("value"), max_one_hot if kind == "auto" else most_columns)
            if values is None and kind == "onehot":
                raise ValueError(f"{c}: more than {most_columns} values; use label or frequency codes")
            kind = "label" if values is None else "onehot"
        if kind == "onehot":
            out.categories[c] = sorted(r["value"] for r in values)
        elif kind == "label":
            out.tables[c] = code_table(df, c, NULL_CLASS)
        elif kind == "ordinal":
            if df.where(ref(c).isNull()).limit(1).count():
                raise ValueError(f"{c}: ordinal codes need a value in every row")
            out.tables[c] = code_table(df, c)
        else:
            out.tables[c] = share_table(df, c)
        out.strategies[c] = kind
    return out
