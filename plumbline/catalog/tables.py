"""Record-keeping queries on tables derived from orders, lineitem, customer and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import metrics, tables


def projects(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("is_active"))


def members(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("user_id"), (F.col("l_returnflag") != "R").alias("is_active"))


PROJECTS = "projects as (select o_orderkey as project_id, o_custkey as owner_id, o_orderdate as created_at, o_orderstatus <> 'P' as is_active from orders)"
MEMBERS = "members as (select l_orderkey as project_id, l_suppkey as user_id, l_returnflag <> 'R' as is_active from lineitem)"


# ---------------------------------------------------------------- filters

@query(f"with {PROJECTS} select project_id, owner_id from projects where is_active")
def active_rows(spark, d):
    return tables.active(projects(spark, d)).select("project_id", "owner_id")


@query(f"with {PROJECTS} select project_id, is_active and owner_id <> 7 as is_active from projects")
def soft_delete(spark, d):
    return tables.soft_delete(projects(spark, d), F.col("owner_id") == 7).select("project_id", "is_active")


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '2-HIGH'")
def optional_filters(spark, d):
    df = tables.filter_by(table(spark, d, "orders"), o_orderstatus="F", o_custkey=None, o_orderpriority="2-HIGH")
    return df.select("o_orderkey", "o_custkey")


@query("""select event_id, event_type <> 'error' and ts >= timestamp '2024-01-29 00:00:00' as is_active from events""")
def expire_sessions(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", (F.col("event_type") != "error").alias("is_active"))
    return tables.expire(df, "ts", "2024-01-30 00:00:00", 24).drop("ts")


@query("select event_id, ts, value from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def time_window(spark, d):
    return tables.in_window(table(spark, d, "events"), "ts", "2024-01-10", "2024-01-12").select("event_id", "ts", "value")


@query("select * exclude (l_tax, l_discount, l_shipdate) from lineitem")
def drop_columns(spark, d):
    return table(spark, d, "lineitem").drop("l_tax", "l_discount", "l_shipdate", "not_there")


# ---------------------------------------------------------------- joins

@query(f"""with {PROJECTS}, {MEMBERS} select owner_id as user_id, project_id from projects where is_active
union select m.user_id, p.project_id from members m join projects p using (project_id) where m.is_active and p.is_active""")
def visible_projects(spark, d):
    return tables.visible_projects(projects(spark, d), members(spark, d))


@query(f"""with {PROJECTS}, {MEMBERS}, v as (select owner_id as user_id, project_id from projects where is_active
  union select m.user_id, p.project_id from members m join projects p using (project_id) where m.is_active and p.is_active)
select v.project_id, created_at from v join projects using (project_id) where user_id = 7 order by created_at desc, project_id limit 20 offset 10""")
def visible_projects_page(spark, d):
    mine = tables.visible_projects(projects(spark, d), members(spark, d)).where("user_id = 7")
    named = projects(spark, d).join(mine.select("project_id"), "project_id")
    return tables.page(named.select("project_id", "created_at"), [F.desc("created_at"), F.asc("project_id")], 20, 10)


@query("""select l_orderkey as job_id, l_partkey as report_id, l_shipdate as created_at from lineitem join orders on l_orderkey = o_orderkey
where o_custkey = 7 order by l_shipdate desc, l_partkey, l_orderkey limit 25""")
def model_reports(spark, d):
    reports = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("report_id"), F.col("l_shipdate").alias("created_at"))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("model_version_id"))
    order = [F.desc("created_at"), F.asc("report_id"), F.asc("job_id")]
    return tables.page(tables.model_reports(reports, jobs, 7), order, 25)


@query(f"""with {PROJECTS}, messages as (select distinct l_orderkey * 10 + l_linenumber as message_id, l_orderkey as session_id from lineitem),
cites as (select l_orderkey * 10 + l_linenumber as message_id, l_partkey as chunk_id from lineitem)
select chunk_id, message_id, session_id, owner_id as user_id from cites join messages using (message_id) join projects on project_id = session_id where is_active""")
def session_citations(spark, d):
    items = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"), F.col("l_orderkey").alias("session_id"),
        F.col("l_partkey").alias("chunk_id"))
    sessions = projects(spark, d).select(F.col("project_id").alias("session_id"), F.col("owner_id").alias("user_id"), "is_active")
    messages = items.select("message_id", "session_id").distinct()
    return tables.session_citations(items.select("message_id", "chunk_id"), messages, sessions)


@query("""select conv_id, 0::bigint as page, count(*) as messages, string_agg(role || ':' || length(text), ' ' order by turn) as steps
from conversations group by conv_id""")
def nested_runs(spark, d):
    messages = table(spark, d, "conversations")
    runs = messages.select("conv_id").distinct()
    paged = tables.nested_pages(runs, messages, "conv_id", ["turn"], ["role", "text"])
    steps = F.transform("items", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["text"])))
    return paged.select("conv_id", "page", F.size("items").cast("long").alias("messages"), F.array_join(steps, " ").alias("steps"))


@query("""select event_id, event_type, case event_type when 'signup' then 'welcome' when 'purchase' then 'receipt' end as target, 'processed' as status from events""")
def route_events(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    return tables.route_events(df, {"signup": "welcome", "purchase": "receipt"})


# ---------------------------------------------------------------- pages and latest rows

@query("select o_orderkey, o_custkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50 offset 100")
def newest_page(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return tables.page(df, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 100)


@query("""select cast(o_orderkey as varchar) as o_orderkey, coalesce(cast(nullif(o_custkey, 7) as varchar), '') as o_custkey,
  coalesce(nullif(o_orderstatus, 'P'), '') as o_orderstatus, (select count(*) from orders) as total_rows from orders order by orders.o_orderkey limit 100 offset 100""")
def preview_page(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", F.nullif(F.col("o_custkey"), F.lit(7)).alias("o_custkey"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    return tables.preview(df, ["o_orderkey"], 2)


@query("""select o_custkey as dataset_id, o_orderkey as report_id, o_orderdate as created_at, 'completed' as status from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders where o_orderstatus = 'F') where k = 1""")
def latest_reports(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    df = table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"))
    return tables.latest_reports(df)


VERSIONS = "versions as (select o_custkey as dataset_id, o_orderkey as version, o_totalprice as checksum, o_orderpriority as storage_path from orders)"


def versions(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("version"),
        F.col("o_totalprice").alias("checksum"), F.col("o_orderpriority").alias("storage_path"))


@query(f"with {VERSIONS} select * from versions where dataset_id = 7")
def version_list(spark, d):
    return tables.version_list(versions(spark, d), 7)


@query(f"""with {VERSIONS}, last as (select dataset_id, max(version) as version from versions group by 1), first as (select dataset_id, min(version) as version from versions group by 1)
select c_custkey as dataset_id, case when c_mktsegment = 'BUILDING' and f.version is not null then f.version else l.version end as version,
  case when c_mktsegment = 'BUILDING' and f.version is not null then fv.checksum else lv.checksum end as checksum
from customer join last l on l.dataset_id = c_custkey join versions lv on lv.version = l.version
left join first f on f.dataset_id = c_custkey left join versions fv on fv.version = f.version""")
def version_rollback(spark, d):
    every = versions(spark, d)
    current = tables.latest_per(every, ["dataset_id"], ["version"]).select("dataset_id", "version", "checksum")
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("dataset_id"))
    first = every.groupBy("dataset_id").agg(F.min("version").alias("version"))
    return tables.rollback(current, every, first.join(chosen, "dataset_id", "left_semi"), ["checksum"])


REGISTRY = """registry as (select 'model-' || o_custkey as name, o_orderkey as version, case o_orderpriority when '1-URGENT' then 'Production'
  when '2-HIGH' then 'Staging' when '3-MEDIUM' then 'Archived' else 'None' end as stage from orders)"""


def registry(spark, d):
    stage = F.col("o_orderpriority")
    stage = F.when(stage == "1-URGENT", "Production").when(stage == "2-HIGH", "Staging").when(stage == "3-MEDIUM", "Archived").otherwise("None")
    return table(spark, d, "orders").select(
        F.concat(F.lit("model-"), F.col("o_custkey")).alias("name"), F.col("o_orderkey").alias("version"), stage.alias("stage"))


@query(f"with {REGISTRY} select name, max(version) as version, stage from registry where stage in ('Production', 'Staging') group by name, stage")
def latest_model_versions(spark, d):
    return tables.latest_versions(registry(spark, d), ["Production", "Staging"])


@query(f"""with {REGISTRY}, asked as (select 'model-' || c_custkey as name, case when c_nationkey < 5 then c_custkey end as version from customer)
select name, version, coalesce(version, (select max(version) from registry r where r.name = a.name and stage = 'Production'),
  (select max(version) from registry r where r.name = a.name)) as resolved_version from asked a""")
def resolve_model_version(spark, d):
    asked = table(spark, d, "customer").select(
        F.concat(F.lit("model-"), F.col("c_custkey")).alias("name"), F.when(F.col("c_nationkey") < 5, F.col("c_custkey")).alias("version"))
    return tables.resolve_versions(asked, registry(spark, d))


@query(f"""with {REGISTRY}, moves as (select name, max(version) as v from registry group by 1)
select r.name, version, case when version = v then 'Production' when stage = 'Production' then 'Archived' else stage end as stage
from registry r join moves using (name)""")
def stage_transition(spark, d):
    models = registry(spark, d)
    moves = models.groupBy("name").agg(F.max("version").alias("version")).withColumn("stage", F.lit("Production"))
    return tables.transition_stage(models, moves)


ERRORS = """errors as (select l_returnflag || l_linestatus as algorithm, avg(abs(l_extendedprice - 1500 * l_quantity)) as mae,
  avg(pow(l_extendedprice - 1500 * l_quantity, 2)) as mse, var_pop(l_extendedprice) as v from lineitem group by 1)"""


@query(f"with {ERRORS} select algorithm, round(mae, 2) as score, row_number() over (order by mae, algorithm) as rank from errors")
def leaderboard_ascending(spark, d):
    scored = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("algorithm"), "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    scores = metrics.regression_metrics(scored, "l_extendedprice", "guess", ["algorithm"])
    return tables.leaderboard(scores, "mae").select("algorithm", F.round("score", 2).alias("score"), "rank")


@query(f"with {ERRORS} select algorithm, 'r2' as primary_metric, round(1 - mse / v, 6) as score, row_number() over (order by 1 - mse / v desc, algorithm) as rank from errors")
def leaderboard_default_metric(spark, d):
    scored = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("algorithm"), "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    scores = metrics.regression_metrics(scored, "l_extendedprice", "guess", ["algorithm"])
    board = tables.leaderboard(scores, problem="regression")
    return board.select("algorithm", "primary_metric", F.round("score", 6).alias("score"), "rank")


@query("select event_id, ts, value from events where event_type = 'view' order by ts desc, event_id limit 50")
def prediction_history(spark, d):
    df = tables.filter_by(table(spark, d, "events"), event_type="view").select("event_id", "ts", "value")
    return tables.page(df, [F.desc("ts"), F.asc("event_id")], 50)


# ---------------------------------------------------------------- sets

@query("select c_nationkey as nation from customer union select s_nationkey from supplier where s_acctbal < 0")
def union_of_sets(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    suppliers = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"))
    return customers.union(suppliers).distinct()


@query("""select l_orderkey as order_key, 'both' as side from lineitem where l_returnflag = 'R' intersect select l_orderkey, 'both' from lineitem where l_returnflag = 'A'
union select l_orderkey, 'first' from lineitem where l_returnflag = 'R' and l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')""")
def set_differences(spark, d):
    df = table(spark, d, "lineitem")
    first = df.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_key"))
    second = df.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("order_key"))
    both = first.intersect(second).withColumn("side", F.lit("both"))
    return both.unionByName(first.subtract(second).withColumn("side", F.lit("first")))


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
