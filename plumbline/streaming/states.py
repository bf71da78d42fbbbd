"""Run states of a task stream as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.session import work_path
from plumbline.streaming.jobs import start
from plumbline.streaming.metrics import event_time

OUTPUT = "run_id string, status string, tasks long, changed_at timestamp_ntz, step long"
TASK = ["run_id", "task_id", "place", "tie", "status"]
RUN = ["run_id", "status", "tasks", "last", "step"]

BUCKETS = 2048
MOST_HELD = 200_000


def latest(parts: Sequence[pd.DataFrame]) -> pd.DataFrame:
    """The latest row of each task; of rows of one place the one that came first."""
    rows = pd.concat([p for p in parts if len(p)], ignore_index=True)
    rows = rows.sort_values(["place", "tie"], ascending=False, kind="stable")
    return rows.drop_duplicates(["run_id", "task_id"])


def packed(table: pd.DataFrame) -> bytes:
    found = pa.Table.from_pandas(table, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(found)
    return sink.getvalue().to_pybytes()


class RunStates(StatefulProcessor):
    """Latest status per task and a line per run, for a bucket of many runs at once.

    A batch asks the state store twice per bucket that has rows, not per row, and whole columns are
    compared. One state is two tables in Arrow's own format.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tasks binary, runs binary, due long")

    def known(self) -> tuple[pd.DataFrame, pd.DataFrame, int]:
        found = self.state.get()
        if found is None:
            return pd.DataFrame(columns=TASK), pd.DataFrame(columns=RUN), -1
        tasks, runs = (pa.ipc.open_stream(bytes(b)).read_pandas() for b in found[:2])
        return tasks, runs, found[2]

    def keep(self, tasks: pd.DataFrame, runs: pd.DataFrame, before: int) -> None:
        """Write the state, and set the timer to when the first of its runs has been idle."""
        due = int(max(0, runs["last"].min() // 1000 + self.idle_ms)) if len(runs) else -1
        if due != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            if due >= 0:
                self.handle.registerTimer(due)
        if len(runs):
            self.state.update((packed(tasks), packed(runs), due))
        else:
            self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tasks, runs, due = self.known()
        held, count, last = [tasks], 0, []
        for part in rows:
            last.append(part.groupby("run_id")["place"].max())
            held.append(part[TASK])
            count += len(part)
            if count > max(MOST_HELD, len(held[0])):
                held, count = [latest(held)], 0
        tasks = latest(held)
        last = pd.concat(last).groupby(level=0).max()
        mine = tasks[tasks["run_id"].isin(last.index)]
        marks = pd.DataFrame({"run_id": mine["run_id"], "tasks": 1, "failed": mine["status"] == "failed", "open": mine["status"] != "completed"})
        now = marks.groupby("run_id")[["tasks", "failed", "open"]].sum()
        now["status"] = np.where(now["failed"] > 0, "failed", np.where(now["open"] > 0, "running", "completed"))
        # gaps would make floats of whole numbers, which are not exact at this size
        old = runs.astype({c: "Int64" for c in ("tasks", "last", "step")}).set_index("run_id").reindex(now.index)
        changed = (now["status"] != old["status"]) | (now["tasks"] != old["tasks"].fillna(0))
        fresh = pd.DataFrame({
            "run_id": now.index,
            "status": now["status"].to_numpy(),
            "tasks": now["tasks"].to_numpy(np.int64),
            "last": np.maximum(old["last"].fillna(-(1 << 63)).to_numpy(np.int64), last.reindex(now.index).to_numpy(np.int64)),
            "step": old["step"].fillna(0).to_numpy(np.int64) + changed.to_numpy(np.int64),
        })
        others = runs[~runs["run_id"].isin(now.index)]
        self.keep(tasks, pd.concat([others, fresh]) if len(others) else fresh, due)
        yield fresh[changed.to_numpy()].rename(columns={"last": "micros"})[["run_id", "status", "tasks", "micros", "step"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tasks, runs, _ = self.known()
        idle = runs["last"] // 1000 + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs()
        gone = set(runs["run_id"][idle])
        # the timer that has come is not there to be deleted
        self.keep(tasks[~tasks["run_id"].isin(gone)], runs[~idle], -1)
        return iter(())


def stream_run_states(tasks: DataFrame, time: str, tie: str | None = None, late: str = "10 minutes", idle: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """The state of each run of a stream of ``(run_id, task_id, status, time)``, one row whenever
    its status or its number of tasks has changed at the end of a batch.

    A task has the status of its latest row by ``time`` and ``tie`` (a whole number), in
    whatever order rows come; rows that come again change nothing. Rows behind the watermark
    ``late`` are dropped, and so are rows without a run, task, status or time. The state of a
    run goes once the watermark is ``idle`` beyond its latest row; a later row begins it anew.
    ``step`` counts the changes of a run. Runs share ``buckets`` states by their hash, and a batch
    reads and writes those it has rows for. The session must keep its state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), as such states and timers need it.
    """
    idle_ms = tasks.sparkSession.sql(f"SELECT (unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {idle}) DIV 1000) AS ms").first()["ms"]
    timed = event_time(tasks, time, late)
    known = timed.dropna(subset=["run_id", "task_id", "status", time])
    rows = known.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("task_id").cast("string").alias("task_id"),
        "status",
        F.col(time),
        F.unix_micros(F.col(time).cast("timestamp")).alias("place"),
        (F.coalesce(F.col(tie).cast("long"), F.lit(0)) if tie else F.lit(0)).cast("long").alias("tie"),
    )
    out = rows.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RunStates(idle_ms), outputStructType="run_id string, status string, tasks long, micros long, step long", outputMode="Append", timeMode="EventTime"
    )
    return out.select("run_id", "status", "tasks", F.timestamp_micros("micros").cast("timestamp_ntz").alias("changed_at"), "step")


def run_states_of_stream(tasks: DataFrame, time: str, tie: str | None = None, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """All changes of a stream's available input, written to the shared folder and read back."""
    states = stream_run_states(tasks, time, tie, late, idle)
    path = work_path(tasks.sparkSession, "run-states")
    start(states, path).awaitTermination()
    return tasks.sparkSession.read.schema(OUTPUT).parquet(f"{path}/data")
