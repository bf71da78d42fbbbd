"""Stored fits: parameter tables saved per dataset, listed and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_params(params: DataFrame, path: str, dataset_id: str, run_id: str, created: str) -> None:
    """Append a parameter table as JSON, partitioned by dataset and run."""
    payload = F.to_json(F.struct(*params.columns))
    rows = params.select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(run_id).alias("run_id"), F.lit(created).alias("created_at"), payload.alias("payload")
    )
    rows.write.mode("append").partitionBy("dataset_id", "run_id").json(path)


def list_runs(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    """Saved runs with the number of parameter rows, newest first."""
    stored = spark.read.schema("created_at string, payload string, dataset_id string, run_id string").json(path)
    if dataset_id is not None:
        stored = stored.where(F.col("dataset_id") == dataset_id)
    runs = stored.groupBy("dataset_id", "run_id").agg(F.max("created_at").alias("created_at"), F.count("*").alias("rows"))
    return runs.orderBy(F.desc("created_at"), "run_id")


def load_params(spark: SparkSession, path: str, dataset_id: str, run_id: str, schema: str) -> DataFrame:
    stored = spark.read.schema("created_at string, payload string, dataset_id string, run_id string").json(path)
    mine = stored.where((F.col("dataset_id") == dataset_id) & (F.col("run_id") == run_id))
    return mine.select(F.from_json("payload", schema).alias("p")).select("p.*")
