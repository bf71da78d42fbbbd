"""Structured Streaming jobs: file sources, sinks in the shared folder, routing, drift."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import drift
from plumbline.operators.tables import route_events
from plumbline.plans.monitoring import bin_verdicts
from plumbline.session import work_path
from plumbline.streaming.metrics import event_time


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def start(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet below ``path`` until the available input is used up.

    Data and checkpoint lie in the shared folder, so a restarted job goes on exactly once.
    """
    return (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all available input and read its output back."""
    path = work_path(stream.sparkSession, label)
    start(stream, path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all available input with a function per micro-batch.

    A later run with the same ``checkpoint`` folder goes on where this one ended.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def handle_events(batch: DataFrame, number: int, handlers: dict[str, Callable[[DataFrame, int], None]], path: str, routes: dict[str, str] | None = None) -> None:
    """Route the events of one micro-batch, hand them to the handlers of their targets, and
    write them with ``status`` and ``error`` below ``path``.

    A handler gets its rows and the number of the batch. If it raises, its rows are
    ``failed`` with the message; those of other targets, of targets without a handler and of
    no target are ``processed``. The routed rows are written before any handler sees them,
    and results under the batch's number: a batch that comes again replaces itself, and a
    handler that writes under the number does too.
    """
    spark = batch.sparkSession
    routed = route_events(batch, routes).drop("status")
    routed.write.mode("overwrite").parquet(f"{path}/routed/batch={number}")
    rows = spark.read.schema(routed.schema).parquet(f"{path}/routed/batch={number}")
    failures = {}
    for target, handler in handlers.items():
        try:
            handler(rows.where(F.col("target") == target), number)
        except Exception as error:  # whatever a handler raises belongs to its events
            failures[target] = f"{type(error).__name__}: {error}"
    known = spark.createDataFrame(list(failures.items()), "target string, error string")
    marked = rows.join(F.broadcast(known), "target", "left")
    status = F.when(F.col("error").isNull(), "processed").otherwise("failed")
    marked.withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(f"{path}/events/batch={number}")


def routing_job(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], path: str, routes: dict[str, str] | None = None) -> None:
    """Handle all available events of a stream; a job started again with the same ``path``
    goes on where the last one ended."""
    run_batches(stream, f"{path}/checkpoint", lambda batch, number: handle_events(batch, number, handlers, path, routes))


def handled_events(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """Events written by ``routing_job``; ``failed`` are the dead letters, read alone."""
    events = spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events").drop("batch")
    return events.where(F.col("status") == status) if status else events


def distinct_uploads(stream: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour", salts: int = 16) -> DataFrame:
    """First upload of each key; repeats within the watermark are dropped, and so is the
    state of keys that have fallen behind it.

    Repeats are dropped per key and salt first, so one file uploaded over and over is
    spread over tasks and reaches the final step a few times only.
    """
    salt = F.pmod(F.xxhash64(*stream.columns), F.lit(salts))
    marked = event_time(stream, time, late).withColumn("_salt", salt)
    thinned = marked.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return thinned.dropDuplicatesWithinWatermark(list(keys))


def bin_counts(stream: DataFrame, time: str, features: Sequence[str], ranges: DataFrame, size: str, late: str, buckets: int = drift.BUCKETS) -> DataFrame:
    """Histogram counts per closed window and feature, on the baseline's bins; values outside
    its range are counted as bins -1 and ``buckets``, so no window is lost.

    The state is a few counters per window, whatever the number of events.
    """
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    rows = event_time(stream, time, late).select(time, F.inline(F.array(*cells)))
    known = F.col("value").isNotNull() & ~F.isnan("value")
    placed = rows.join(F.broadcast(ranges), "feature").where(known)
    counts = placed.groupBy(F.window(time, size).alias("_w"), "feature", drift.placed_bin(buckets).alias("bin")).agg(F.count("*").alias("cur"))
    return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "feature", "bin", "cur")


def window_drift(counts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """PSI, JS and KS of every window against a stored baseline (one row per window and feature)."""
    stored = snapshot.select("feature", F.posexplode("bin_counts").alias("bin", "base"))
    windows = counts.select("window_start", "window_end", "feature").distinct()
    frame = windows.join(F.broadcast(stored.select("feature", "bin")), "feature")
    keyed = frame.join(counts, ["window_start", "window_end", "feature", "bin"], "full").fillna(0, ["cur"])
    label = F.to_json(F.struct(F.col("feature").alias("f"), F.col("window_start").cast("string").alias("s"), F.col("window_end").cast("string").alias("e")))
    labelled = keyed.select(label.alias("_label"), "feature", "bin", "cur")
    base = labelled.select("_label", "feature").distinct().join(F.broadcast(stored), "feature").select(F.col("_label").alias("feature"), "bin", "base")
    scored = bin_verdicts(labelled.select(F.col("_label").alias("feature"), "bin", "cur"), base)
    parsed = scored.withColumn("_k", F.from_json("feature", "f string, s string, e string"))
    return parsed.select(
        F.col("_k.s").cast("timestamp_ntz").alias("window_start"),
        F.col("_k.e").cast("timestamp_ntz").alias("window_end"),
        F.col("_k.f").alias("feature"),
        "psi",
        "js_distance",
        "ks_statistic",
        "ks_p_value",
        "has_drift",
    )


def drift_stream(stream: DataFrame, time: str, features: Sequence[str], snapshot: DataFrame, size: str, path: str, late: str = "1 hour") -> None:
    """Drift reports of closed windows, appended below ``path`` batch by batch.

    A batch is written under its own number, so one that is repeated after a failure
    replaces itself. The checkpoint lies beside the reports: a job started again with the
    same ``path`` neither repeats nor loses a window.
    """
    counts = bin_counts(stream, time, features, snapshot.select("feature", "low", "high"), size, late)

    def write(batch: DataFrame, number: int) -> None:
        window_drift(batch, snapshot).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(counts, f"{path}/_checkpoint", write)
