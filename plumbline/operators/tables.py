"""Record-keeping queries: soft deletes, pages, latest rows, versions, stages and routing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import ref
from plumbline.operators.ordered import running_totals

# Ascending metrics, default metric per problem, and event routes.
LOWER_IS_BETTER = ("mse", "rmse", "mae", "mape", "median_ae", "davies_bouldin")
DEFAULT_METRIC = {"classification": "f1_score", "regression": "r2", "clustering": "silhouette_score"}
ROUTES = {"DATASET_UPLOADED": "validation_pipeline", "TRAINING_COMPLETED": "evaluation_pipeline"}


# ---------------------------------------------------------------- filters

def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_active"))


def soft_delete(df: DataFrame, condition: Column) -> DataFrame:
    """Mark the matching rows inactive; nothing is removed."""
    return df.withColumn("is_active", F.col("is_active") & ~F.coalesce(condition, F.lit(False)))


def filter_by(df: DataFrame, **given: Any) -> DataFrame:
    """Equality filters for the arguments that are not None; all of them reach the scan."""
    for name, value in given.items():
        if value is not None:
            df = df.where(ref(name) == F.lit(value))
    return df


def expire(df: DataFrame, created: str, now: str, ttl_hours: int) -> DataFrame:
    """Deactivate active rows created more than ``ttl_hours`` before ``now``."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(ttl_hours))
    return soft_delete(df, ref(created).cast("timestamp_ntz") < cutoff)


def in_window(df: DataFrame, time: str, start: Any, end: Any) -> DataFrame:
    """Rows with ``start <= time < end``; plain comparisons, so partitions and row groups prune."""
    dtype = df.schema[time].dataType
    return df.where((ref(time) >= F.lit(start).cast(dtype)) & (ref(time) < F.lit(end).cast(dtype)))


def excerpt(text: Column, size: int) -> Column:
    """First ``size`` characters, with an ellipsis if there is more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


# ---------------------------------------------------------------- pages and latest rows

def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result; each task keeps only ``offset + limit`` rows."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def preview(df: DataFrame, order: Sequence[str], number: int = 1, size: int = 100) -> DataFrame:
    """Page ``number`` as text, missing values as empty text, with the total row count."""
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    rows = page(df, [ref(c) for c in order], size, (number - 1) * size)
    return rows.select(*[F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in df.columns], total.alias("total_rows"))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``. A maximum is combined within each task
    first, so a key with very many rows costs no more than any other."""
    # a primitive maximum is a hash aggregate; whole rows are only compared where it ties
    top = df.groupBy(*keys).agg(F.max(order[0]).alias("_top")).withColumnsRenamed({c: f"_key_{c}" for c in keys})
    match = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys], F.col(order[0]).eqNullSafe(F.col("_top")))
    tied = df.join(top, match, "left_semi")
    best = tied.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_last"))
    return best.select("_last.*")


def latest_reports(reports: DataFrame, key: str = "dataset_id", created: str = "created_at") -> DataFrame:
    return latest_per(reports.where(F.col("status") == "completed"), [key], [created, "report_id"])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key with their ``place``; cut to ``k`` within tasks before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


# ---------------------------------------------------------------- joins

def visible_projects(projects: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ``(user_id, project_id)``: owners, and active members, of active projects.

    Two plain branches instead of an OR in a join, so every step is an equi-join and the
    filters reach both scans.
    """
    live = active(projects)
    owned = live.select(F.col("owner_id").alias("user_id"), "project_id")
    joined = active(members).select("user_id", "project_id").join(live.select("project_id"), "project_id", "left_semi")
    return owned.unionByName(joined.select("user_id", "project_id")).distinct()


def model_reports(reports: DataFrame, jobs: DataFrame, model_version: Any) -> DataFrame:
    """Reports of the jobs of one model version."""
    chosen = jobs.where(F.col("model_version_id") == F.lit(model_version)).select("job_id")
    return reports.join(chosen, "job_id", "left_semi")


def session_citations(citations: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Citations of messages whose session exists, belongs to its user and is active."""
    owned = active(sessions).select("session_id", "user_id")
    in_session = messages.select("message_id", "session_id").join(owned, "session_id")
    return citations.join(in_session, "message_id")


def nested_pages(
    parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], size: int = 1000
) -> DataFrame:
    """Parents with their ordered children as lists, ``size`` per row and page.

    Positions are prefix counts over range buckets, so a parent with any number of
    children is spread over pages, and no list grows without bound.
    """
    numbered = running_totals(children.withColumn("_one", F.lit(1)), order, {"_at": "_one"}, [key])
    paged = numbered.withColumn("page", F.floor((F.col("_at") - 1) / size))
    lists = paged.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("_at", *fields))).alias("_items"))
    items = F.transform("_items", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return parents.join(lists.select(key, "page", items.alias("items")), key, "left")


def route_events(events: DataFrame, routes: dict[str, str] | None = None) -> DataFrame:
    """Events with the target their type is routed to; other types are processed without one.

    The rule table is configuration, a few rows; works on batch and streaming events.
    """
    rules = events.sparkSession.createDataFrame(list((routes or ROUTES).items()), "event_type string, target string")
    routed = events.join(F.broadcast(rules), "event_type", "left")
    return routed.withColumn("status", F.lit("processed"))


# ---------------------------------------------------------------- versions and stages

def version_list(versions: DataFrame, dataset_id: Any) -> DataFrame:
    return versions.where(F.col("dataset_id") == F.lit(dataset_id)).orderBy(F.desc("version"))


def rollback(datasets: DataFrame, versions: DataFrame, choices: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Datasets with ``fields`` and ``version`` taken from the chosen version, if it exists."""
    chosen = versions.join(choices, ["dataset_id", "version"], "left_semi").select(
        "dataset_id", F.col("version").alias("_version"), *[ref(f).alias(f"_{f}") for f in fields]
    )
    joined = datasets.join(chosen, "dataset_id", "left")
    hit = F.col("_version").isNotNull()
    new = {f: F.when(hit, F.col(f"_{f}")).otherwise(ref(f)) for f in fields}
    new["version"] = F.coalesce("_version", "version")
    return joined.select(*[new[c].alias(c) if c in new else ref(c) for c in datasets.columns])


def latest_versions(registry: DataFrame, stages: Sequence[str] | None = None) -> DataFrame:
    """Highest version of each model in each stage."""
    rows = registry.where(F.col("stage").isin(*stages)) if stages else registry
    return latest_per(rows, ["name", "stage"], ["version"])


def resolve_versions(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Version to serve per request ``(name, version)``: the one asked for, else the last
    in production, else the last of all."""
    known = registry.groupBy("name").agg(
        F.max(F.when(F.col("stage") == "Production", F.col("version"))).alias("_production"),
        F.max("version").alias("_latest"),
    )
    joined = requests.join(known, "name", "left")
    return joined.select(*requests.columns, F.coalesce("version", "_production", "_latest").alias("resolved_version"))


def transition_stage(registry: DataFrame, moves: DataFrame, archive_existing: bool = True) -> DataFrame:
    """Registry after ``moves (name, version, stage)``; other holders of a taken stage are
    archived on request."""
    moved = moves.select("name", "version", F.col("stage").alias("_to"))
    taken = moves.select("name", "stage").distinct().withColumn("_taken", F.lit(archive_existing))
    joined = registry.join(moved, ["name", "version"], "left").join(taken, ["name", "stage"], "left")
    stage = F.coalesce("_to", F.when(F.col("_taken"), "Archived"), "stage")
    return joined.withColumn("stage", stage).select(*registry.columns)


# ---------------------------------------------------------------- ranking

def leaderboard(metrics: DataFrame, metric: str | None = None, problem: str = "classification", tie: str = "algorithm") -> DataFrame:
    """Algorithms ranked by one metric, errors ascending; a missing metric counts as 0.

    ``metrics`` has one row per algorithm, as few as a search tries.
    """
    chosen = metric or DEFAULT_METRIC[problem]
    score = F.coalesce(ref(chosen).cast("double"), F.lit(0.0)) if chosen in metrics.columns else F.lit(0.0)
    first = score if chosen in LOWER_IS_BETTER else -score
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(first, ref(tie)))
    return metrics.select("*", F.lit(chosen).alias("primary_metric"), score.alias("score"), rank.cast("long").alias("rank"))
