"""Windowed service metrics over event logs; the same functions take batches and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default histogram bounds in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def event_time(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """The stream with a watermark on ``time``, which must be a TIMESTAMP for that; a batch
    as it is."""
    if not (df.isStreaming and late):
        return df
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(df: DataFrame, time: str, size: str, slide: str | None, keys: Sequence[str], late: str | None, *aggregates: Column) -> DataFrame:
    """Aggregates per time window and key. ``late`` sets the watermark of a stream; rows
    older than it are dropped, and a window is final once it has passed."""
    kind = df.schema[time].dataType
    df = event_time(df, time, late)
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.groupBy(frame.alias("_w"), *keys).agg(*aggregates)
    rest = [c for c in out.columns if c != "_w"]
    return out.select(
        F.col("_w.start").cast(kind).alias("window_start"), F.col("_w.end").cast(kind).alias("window_end"), *rest
    )


def event_rates(df: DataFrame, time: str, keys: Sequence[str] = (), minutes: int = 5, slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per second over sliding windows."""
    rate = (F.count("*") / F.lit(float(minutes * 60))).alias("rate")
    return windowed(df, time, f"{minutes} minutes", slide, keys, late, F.count("*").alias("events"), rate)


def mean_values(df: DataFrame, time: str, value: str, keys: Sequence[str] = (), size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean per window, as sum over count."""
    return windowed(df, time, size, None, keys, late, F.avg(value).alias("mean_value"), F.count(value).alias("samples"))


def success_ratios(df: DataFrame, time: str, success: Column, keys: Sequence[str] = (), size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    good = (F.count_if(success) / F.count("*")).alias("success_ratio")
    return windowed(df, time, size, None, keys, late, F.count("*").alias("events"), good)


def latency_histograms(
    df: DataFrame, time: str, value: str, keys: Sequence[str] = (), size: str = "5 minutes",
    bounds: Sequence[float] = LATENCY_BOUNDS, late: str = "10 minutes",
) -> DataFrame:
    """Cumulative bucket counts per window and label, one row per upper bound ("+Inf" last).

    The buckets are columns of one aggregate, so no row is multiplied before the shuffle.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = windowed(df, time, size, None, keys, late, *counts, F.count(value).alias("le_all"), F.sum(value).alias("value_sum"))
    rows = [F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"le_{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_all").alias("cumulative")))
    return wide.select("window_start", "window_end", *keys, "value_sum", F.inline(F.array(*rows)))


def totals(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("total"))


def last_values(df: DataFrame, labels: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last value of a gauge per label set."""
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("last_value"))


# ---------------------------------------------------------------- sessions and run states

def stream_sessions(df: DataFrame, key: str, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by inactivity with Spark's session window; for streams.

    Where the session sets ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    (as ``local_session`` does), sessions are merged within each task before the shuffle, so
    a busy key sends sessions, not events. The setting is left to the caller.
    """
    kind = df.schema[time].dataType
    df = event_time(df, time, late)
    out = df.groupBy(F.session_window(time, gap).alias("_s"), key).agg(F.count("*").alias("events"))
    return out.select(
        key, F.col("_s.start").cast(kind).alias("session_start"), F.col("_s.end").cast(kind).alias("session_end"), "events"
    )


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """The same sessions on a batch, safe for a key with a very large share of the events.

    Events are first reduced to one row per key and slot of ``gap_seconds``: events of one
    slot always share a session. What a window then sees per key is bounded by the time
    span, not by the number of events.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    slots = (
        df.select(key, seconds.alias("_t"))
        .groupBy(key, F.floor(F.col("_t") / gap).alias("_slot"))
        .agg(F.min("_t").alias("a"), F.max("_t").alias("b"), F.count("*").alias("n"))
    )
    along = Window.partitionBy(key).orderBy("a")
    opens = F.coalesce(F.col("a") > F.lag("b").over(along) + gap, F.lit(True)).cast("int")
    numbered = slots.withColumn("_new", opens).withColumn("_session", F.sum("_new").over(along))
    out = numbered.groupBy(key, "_session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("events"))
    return out.select(
        key,
        F.timestamp_micros("a").cast("timestamp_ntz").alias("session_start"),
        F.timestamp_micros(F.col("b") + gap).cast("timestamp_ntz").alias("session_end"),
        "events",
    )


def run_states(tasks: DataFrame, order: Sequence[str]) -> DataFrame:
    """State of each run from the latest state of its tasks: failed if any failed,
    completed if all completed, else running."""
    latest = tasks.groupBy("run_id", "task_id").agg(F.max_by("status", F.struct(*order)).alias("status"))
    state = (
        F.when(F.bool_or(F.col("status") == "failed"), "failed")
        .when(F.bool_and(F.col("status") == "completed"), "completed")
        .otherwise("running")
    )
    return latest.groupBy("run_id").agg(state.alias("status"), F.count("*").alias("tasks"))
