"""Whole preprocessing run: fit every step on one table, apply the fits to any other."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import without_nan
from plumbline.operators.encode import fit_encoder
from plumbline.operators.generate import generate_features
from plumbline.operators.impute import fit_imputer
from plumbline.operators.scale import fit_scaler
from plumbline.operators.select import fit_selection
from plumbline.operators.transform import fit_transformer

# What a step raises when it can't take its settings or columns. Failed jobs raise others.
REFUSALS = (ValueError, TypeError, KeyError, AnalysisException)


@dataclass
class Settings:
    """Options per step, as keyword arguments of the step's fit function.

    The target keeps its own form unless ``encode_target`` asks otherwise.
    """

    target: str | None = None
    drop_columns: list[str] = field(default_factory=list)
    missing: dict[str, Any] = field(default_factory=dict)
    generation: dict[str, Any] = field(default_factory=dict)
    encoding: dict[str, Any] = field(default_factory=dict)
    transformation: dict[str, Any] = field(default_factory=dict)
    scaling: dict[str, Any] = field(default_factory=dict)
    selection: dict[str, Any] = field(default_factory=dict)
    order_by: list[str] = field(default_factory=list)
    encode_target: bool = False


class _Generate:
    def __init__(self, options: dict[str, Any]):
        self.options = options

    def transform(self, df: DataFrame) -> DataFrame:
        return generate_features(df, **self.options)


@dataclass
class Prepared:
    """Fitted steps in order; ``transform`` applies them to train, test or stream alike."""

    settings: Settings
    steps: list[tuple[str, Any]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    input_columns: list[str] = field(default_factory=list)
    output_columns: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        df = without_nan(df.drop(*self.settings.drop_columns))
        for name, step in self.steps:
            df = step.transform(df, self.settings.order_by) if name == "missing" else step.transform(df)
        return df

    def whole(self) -> Prepared:
        """These steps, if none was skipped; for results that must not pass without a step."""
        if self.errors:
            raise RuntimeError("preprocessing skipped steps: " + "; ".join(self.errors))
        return self

    def report(self, spark) -> DataFrame:
        done = {n for n, _ in self.steps}
        failed = dict(e.split(": ", 1) for e in self.errors)
        order = ("missing", "generation", "encoding", "transformation", "scaling", "selection")
        rows = [(i, s, "ok" if s in done else "failed", failed.get(s)) for i, s in enumerate(order)]
        return spark.createDataFrame(rows, "place int, step string, state string, error string")


def fit_preprocessing(df: DataFrame, settings: Settings | None = None) -> Prepared:
    """Fit the steps one after another. A step that refuses its settings or columns is skipped and
    recorded (``Prepared.whole`` raises then); a failure of Spark itself, which says nothing about the step, is raised."""
    s = settings or Settings()
    out = Prepared(s, input_columns=df.columns)
    aside = [s.target] if s.target else []
    current = without_nan(df.drop(*s.drop_columns))
    fits = {
        "missing": lambda x: fit_imputer(x, **s.missing),
        "generation": lambda x: _Generate({**s.generation, "exclude": aside}),
        "encoding": lambda x: fit_encoder(x, **s.encoding, exclude=[] if s.encode_target else aside),
        "transformation": lambda x: fit_transformer(x, **s.transformation, exclude=aside),
        "scaling": lambda x: fit_scaler(x, **s.scaling, exclude=aside),
        "selection": lambda x: fit_selection(x, **s.selection, target=s.target),
    }
    for name, fit in fits.items():
        try:
            step = fit(current)
            current = step.transform(current, s.order_by) if name == "missing" else step.transform(current)
            out.steps.append((name, step))
        except REFUSALS as exc:
            out.errors.append(f"{name}: {exc}")
    out.output_columns = current.columns
    return out


def ready_for_preprocessing(datasets: DataFrame, reports: DataFrame) -> DataFrame:
    """Datasets that have a completed validation report.

    ``reports`` holds ``(dataset_id, created_at, status)``; the last completed one is a
    per-dataset aggregate, so a dataset with very many reports stays one row per task.
    """
    done = reports.where(F.col("status") == "completed").groupBy("dataset_id").agg(F.max("created_at").alias("last"))
    return datasets.join(done.select("dataset_id"), "dataset_id", "left_semi")
