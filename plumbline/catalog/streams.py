"""Windowed metrics and streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import drift, query, table
from plumbline.catalog.dialogue import check_sql
from plumbline.operators import safety, tables
from plumbline.plans import monitoring
from plumbline.session import materialize, work_path
from plumbline.streaming import jobs, states
from plumbline.streaming import metrics as sm

SLIDING = "(select *, unnest(range(0, 5)) as back from events)"
RATES = f"""select date_trunc('minute', ts) - to_minutes(back::int) as window_start, date_trunc('minute', ts) - to_minutes(back::int) + interval 5 minutes as window_end,
  event_type, count(*) as events, round(count(*) / 300.0::double, 9) as rate from {SLIDING} group by all"""


def stream_of(spark, d, name):
    """A table as a stream, whether it is one file or a folder of files. The path is written as
    a glob, as a stream takes any other path for a folder."""
    return jobs.file_stream(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema, "*")


@query(RATES)
def event_rates(spark, d):
    return sm.event_rates(table(spark, d, "events"), "ts", ["event_type"]).withColumn("rate", F.round("rate", 9))


HOUR = "date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end"


@query(f"select {HOUR}, event_type, round(sum(value) / count(value), 6) as mean_value, count(value) as samples from events group by all")
def mean_latency(spark, d):
    out = sm.mean_values(table(spark, d, "events"), "ts", "value", ["event_type"], "1 hour")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query(f"select {HOUR}, count(*) as events, round(count(*) filter (where event_type <> 'error') / count(*)::double, 9) as success_ratio from events group by all")
def success_ratio(spark, d):
    out = sm.success_ratios(table(spark, d, "events"), "ts", F.col("event_type") != "error", size="1 hour")
    return out.withColumn("success_ratio", F.round("success_ratio", 9))


@query("""with w as (select date_trunc('day', ts) as window_start, event_type, value from events)
select window_start, window_start + interval 1 day as window_end, event_type, round(any_value(s), 4) as value_sum, le, count(*) filter (where le = '+Inf' or value <= try_cast(le as double)) as cumulative
from (select *, sum(value) over (partition by window_start, event_type) as s from w), (values ('10.0'), ('50.0'), ('100.0'), ('+Inf')) b(le) group by window_start, event_type, le""")
def latency_histogram(spark, d):
    out = sm.latency_histograms(table(spark, d, "events"), "ts", "value", ["event_type"], "1 day", (10.0, 50.0, 100.0))
    return out.withColumn("value_sum", F.round("value_sum", 4))


@query("select event_type, user_id, count(*) as total from events group by 1, 2")
def totals_by_label(spark, d):
    return sm.totals(table(spark, d, "events"), ["event_type", "user_id"])


@query("select event_type, last(value order by ts, event_id) as last_value from events group by 1")
def last_gauge(spark, d):
    return sm.last_values(table(spark, d, "events"), ["event_type"], "value", ["ts", "event_id"])


@query("""with o as (select user_id, ts, coalesce(ts > lag(ts) over w + interval 6 hours, true) as opens from events window w as (partition by user_id order by ts)),
n as (select *, sum(opens::int) over (partition by user_id order by ts) as s from o)
select user_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as events from n group by user_id, s""")
def user_sessions(spark, d):
    return sm.sessions(table(spark, d, "events"), "user_id", "ts", 6 * 3600)


TASKS = """tasks as (select l_orderkey as run_id, l_linenumber as task_id, case l_returnflag when 'R' then 'failed' when 'A' then 'completed' else 'running' end as status,
  l_shipdate, l_partkey, l_suppkey from lineitem)"""


@query(f"""with {TASKS}, latest as (select * from (select *, row_number() over (partition by run_id, task_id order by l_shipdate desc, l_partkey desc, l_suppkey desc) as k from tasks) where k = 1)
select run_id, case when bool_or(status = 'failed') then 'failed' when bool_and(status = 'completed') then 'completed' else 'running' end as status, count(*) as tasks from latest group by 1""")
def run_states(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "completed").otherwise("running")
    tasks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task_id"), status.alias("status"), "l_shipdate", "l_partkey", "l_suppkey")
    return sm.run_states(tasks, ["l_shipdate", "l_partkey", "l_suppkey"])


@query(f"""with {TASKS}, latest as (select * from (select *, row_number() over (partition by run_id, task_id order by l_shipdate desc, l_partkey desc, l_suppkey desc) as k from tasks) where k = 1)
select run_id::varchar as run_id, case when bool_or(status = 'failed') then 'failed' when bool_and(status = 'completed') then 'completed' else 'running' end as status, count(*) as tasks from latest group by 1""")
def stream_run_states(spark, d):
    """The last state of each run a stream gives out. Map states and timers need RocksDB, so the
    session's provider is set while the stream runs."""
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "completed").otherwise("running")
    tasks = stream_of(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("task_id"), status.alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_partkey") * (1 << 31) + F.col("l_suppkey")).alias("tie"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = states.run_states_of_stream(tasks, "at", "tie", late="10000 days")
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return changes.groupBy("run_id").agg(F.max_by("status", "step").alias("status"), F.max_by("tasks", "step").alias("tasks"))


# ---------------------------------------------------------------- streaming jobs

CLOSED = "window_end <= (select max(ts) - interval 10 minutes from events)"


@query(f"select * from ({RATES}) where {CLOSED}")
def stream_event_rates(spark, d):
    """Closed windows only: a stream gives a window out once its watermark has passed it."""
    rates = sm.event_rates(stream_of(spark, d, "events"), "ts", ["event_type"])
    return jobs.run_to_table(rates.withColumn("rate", F.round("rate", 9)), "rates")


@query(check_sql("select conv_id, turn, text from conversations", "conv_id, turn"))
def stream_safety(spark, d):
    checked = safety.check_text(stream_of(spark, d, "conversations").select("conv_id", "turn", "text"))
    return jobs.run_to_table(checked.drop("text"), "safety")


@query("""select event_id, event_type, case event_type when 'signup' then 'welcome' when 'purchase' then 'receipt' end as target, 'processed' as status
from events where event_type in ('signup', 'purchase')""")
def stream_routing(spark, d):
    """Routed events, written per micro-batch."""
    path = work_path(spark, "routed")
    routed = tables.route_events(stream_of(spark, d, "events").select("event_id", "event_type"), {"signup": "welcome", "purchase": "receipt"})

    def write(batch, number):
        batch.where(F.col("target").isNotNull()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    jobs.run_batches(routed, f"{path}/_checkpoint", write)
    return spark.read.parquet(path).drop("batch")


@query("""select event_id, event_type, case event_type when 'signup' then 'welcome' when 'purchase' then 'receipt' end as target,
  case when event_type = 'purchase' then 'failed' else 'processed' end as status, case when event_type = 'purchase' then 'ValueError: no printer' end as error from events""")
def stream_routing_failures(spark, d):
    """Every event with its status: one handler writes its rows, one fails. The job is
    started twice; the second run finds nothing new."""
    path = work_path(spark, "handled")

    def receipt(rows, number):
        raise ValueError("no printer")

    handlers = {"welcome": lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/welcome/batch={number}"), "receipt": receipt}
    for _ in range(2):
        jobs.routing_job(stream_of(spark, d, "events").select("event_id", "event_type"), handlers, path, {"signup": "welcome", "purchase": "receipt"})
    return jobs.handled_events(spark, path)


@query("select distinct user_id as project, md5(event_type) as checksum from events")
def stream_distinct_uploads(spark, d):
    """Uploads by project and checksum, here users and event types; all within the watermark."""
    stream = stream_of(spark, d, "events").select("ts", F.col("user_id").alias("project"), F.md5("event_type").alias("checksum"))
    return jobs.run_to_table(jobs.distinct_uploads(stream, "ts", ["project", "checksum"], "60 days"), "uploads").select("project", "checksum")


@query("""with o as (select user_id, ts, coalesce(ts > lag(ts) over w + interval 6 hours, true) as opens from events window w as (partition by user_id order by ts)),
n as (select *, sum(opens::int) over (partition by user_id order by ts) as s from o),
t as (select user_id, min(ts) as session_start, max(ts) + interval 6 hours as session_end, count(*) as events from n group by user_id, s)
select * from t where session_end <= (select max(ts) - interval 10 minutes from events)""")
def stream_sessions(spark, d):
    return jobs.run_to_table(sm.stream_sessions(stream_of(spark, d, "events"), "user_id", "ts", "6 hours"), "sessions")


WEEKS = f"""e as (select ts, case when ts >= timestamp '2024-01-18' and ts < timestamp '2024-01-25' then value + 100000 else value end as value,
  time_bucket(interval 7 days, ts, timestamp '1970-01-01') as w from events),
first as (select value from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-08'),
closed as (select distinct w from e where w + interval 7 days <= (select max(ts) - interval 1 hour from events)),
sides as (select w::varchar as feature, value, false as later from first, closed union all select w::varchar, value, true from e join closed using (w)),
longs as (select * from sides), {drift.SIDES[drift.SIDES.index("ranges as"):]}"""


@query(f"""with {WEEKS}, {drift.PSI}, {drift.JS}, {drift.EDGE_KS}
select feature::timestamp as window_start, feature::timestamp + interval 7 days as window_end, 'value' as feature,
  {drift.SNAPSHOT_SQL.replace("round(js, 6)", "case when feature::timestamp <> timestamp '2024-01-18' then round(js, 6) end")}""")
def stream_drift(spark, d):
    """Weekly drift of the event values against the first week; one week is all out of range.

    The job is started twice: the second run finds its checkpoint and adds nothing.
    """
    first = tables.in_window(table(spark, d, "events"), "ts", "2024-01-01", "2024-01-08")
    snapshot = materialize(monitoring.baseline_snapshot(first, ["value"]), "snapshot")
    path = work_path(spark, "drift-reports")
    cut = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-18", "2024-01-25")]
    far = F.when((F.col("ts") >= cut[0]) & (F.col("ts") < cut[1]), F.col("value") + 100000).otherwise(F.col("value"))
    for _ in range(2):
        jobs.drift_stream(stream_of(spark, d, "events").withColumn("value", far), "ts", ["value"], snapshot, "7 days", path)
    return drift.rounded_verdicts(spark.read.parquet(path).drop("batch"))
