"""Run states of a stream against the batch operator."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from plumbline.streaming import jobs, metrics, states

SCHEMA = "run_id string, task_id bigint, status string, at timestamp, n bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def written(spark, folder, batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return jobs.file_stream(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema, files=1)


def latest(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["step"]):
        out[r["run_id"]] = (r["status"], r["tasks"])
    return out


def test_same_states_as_the_batch(rocks, tmp_path):
    rng = random.Random(0)
    rows = [
        (f"r{rng.choice([0, 0, 0, 1, 2, 3])}", rng.randrange(4), rng.choice(["running", "completed", "completed", "failed"]), DAY + timedelta(seconds=rng.randrange(60)), n)
        for n in range(60)
    ]
    rows += rows[:20] + [("r9", 1, "completed", DAY, 1), (None, 1, "failed", DAY, 1), ("r9", None, "failed", DAY, 1), ("r9", 2, None, DAY, 1), ("r9", 2, "failed", None, 1)]
    rng.shuffle(rows)
    stream = written(rocks, str(tmp_path), [rows[i::3] for i in range(3)])
    got = latest(states.run_states_of_stream(stream, "at", "n").collect())
    whole = rocks.createDataFrame(rows, SCHEMA).dropna()
    want = {r["run_id"]: (r["status"], r["tasks"]) for r in metrics.run_states(whole, ["at", "n"]).collect()}
    assert got == want and want["r9"] == ("completed", 1)


def test_only_changes_are_emitted_and_idle_runs_are_forgotten(rocks, tmp_path):
    later = DAY + timedelta(days=3)
    batches = [
        [("a", 1, "running", DAY, 0), ("a", 2, "completed", DAY, 0)],
        [("a", 1, "running", DAY + timedelta(seconds=5), 0)],
        [("a", 1, "completed", DAY + timedelta(seconds=9), 0)],
        [("b", 1, "running", later, 0)],
        [("b", 1, "running", later, 0)],
        [("a", 3, "failed", later, 0)],
    ]
    stream = written(rocks, str(tmp_path), batches)
    rows = states.run_states_of_stream(stream, "at", "n", idle="1 day").collect()
    changes = [(r["status"], r["tasks"], r["step"]) for r in sorted(rows, key=lambda r: (r["changed_at"], r["step"])) if r["run_id"] == "a"]
    assert changes == [("running", 2, 1), ("completed", 2, 2), ("failed", 1, 1)]


class Handle:
    """One state and its timers, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_the_store_is_not_asked_per_row_or_run():
    far = 1 << 60
    rows = pd.DataFrame([(f"r{n % 1000}", str(n // 1000), far + n, 0, "completed") for n in range(3000)], columns=states.TASK)
    handle, runs = Handle(), states.RunStates(1000)
    runs.init(handle)
    out = pd.concat(runs.handleInputRows((0,), iter([rows[:1500], rows[1500:]]), None))
    assert len(out) == 1000 and set(out["tasks"]) == {3} and set(out["step"]) == {1} and out["micros"].max() == far + 2999
    again = pd.concat(runs.handleInputRows((0,), iter([rows[:10].assign(status="failed", tie=1)]), None))
    assert len(again) == 10 and set(again["step"]) == {2} and set(again["micros"]) == {far + 2000 + n for n in range(10)}
    assert handle.calls <= 8 and handle.timers == {(far + 2000) // 1000 + 1000}
    handle.timers.clear()
    expired = type("Info", (), {"getExpiryTimeInMs": lambda self: (far + 2999) // 1000 + 1000})()
    assert list(runs.handleExpiredTimer((0,), None, expired)) == [] and handle.value is None and not handle.timers
