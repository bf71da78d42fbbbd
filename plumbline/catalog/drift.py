"""Drift queries: baseline against current rows of the same table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import drift
from plumbline.plans import monitoring

CUT = "1999-01-01 00:00:00"
EVENT_CUT = "2024-01-15 00:00:00"
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def halves(spark, d):
    df = table(spark, d, "lineitem", heavy=True)
    cut = F.lit(CUT).cast("timestamp_ntz")
    price = F.when(F.col("l_shipdate") < cut, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 1.5)
    df = df.select("l_shipdate", "l_quantity", price.alias("l_extendedprice"), "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return df.where(F.col("l_shipdate") < cut), df.where(F.col("l_shipdate") >= cut)


SIDES = f"""sides as (select l_shipdate >= timestamp '{CUT}' as later, l_quantity,
    case when l_shipdate < timestamp '{CUT}' then l_extendedprice else l_extendedprice * 1.5::double end as l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus from lineitem),
longs as ({" union all ".join(f"select '{c}' as feature, {c} as value, later from sides" for c in FEATURES)}),
ranges as (select feature, min(value) as low, max(value) as high from longs where not later group by 1),
edges as (select feature, low, high, i, case when i = 10 then high else i::double * ((high - low) / 10.0::double) + low end as e from ranges, range(0, 11) t(i)),
binned as (select l.feature, l.later, count(*) filter (where e.i between 1 and 9 and l.value >= e.e) as bin
  from (select *, row_number() over () as rid from longs) l join edges e on e.feature = l.feature
  where l.value between e.low and e.high group by l.feature, l.later, rid),
hist as (select r.feature, b.i as bin, (select count(*) from binned x where x.feature = r.feature and x.bin = b.i and not later) as base,
  (select count(*) from binned x where x.feature = r.feature and x.bin = b.i and later) as cur from ranges r, range(0, 10) b(i))"""

PSI = """psis as (select feature, sum((c - b) * ln(c / b)) as psi from (
  select feature, b / sum(b) over (partition by feature) as b, c / sum(c) over (partition by feature) as c from (
    select feature, case when base = 0 then 0.0001::double else base::double end as b,
      case when cur = 0 then 0.0001::double else cur::double end as c from hist)) group by feature)"""

JS = """jss as (select feature, sqrt(greatest(0, (sum(case when b > 0 then b * ln(b / ((b + c) / 2)) else 0 end)
    + sum(case when c > 0 then c * ln(c / ((b + c) / 2)) else 0 end)) / 2)) as js from (
  select feature, base / sum(base) over (partition by feature) as b, cur / sum(cur) over (partition by feature) as c from hist) group by feature)"""

KS = """kss as (select feature, n, m, max(abs(fb / n::double - fc / m::double)) as ks from (
  select feature, sum(b) over w as fb, sum(c) over w as fc, sum(b) over (partition by feature) as n, sum(c) over (partition by feature) as m
  from (select feature, value, count(*) filter (where not later) as b, count(*) filter (where later) as c from longs group by 1, 2)
  window w as (partition by feature order by value)) group by all),
kps as (select feature, ks, case when t < 0.2 then 1.0::double else least(1.0::double, greatest(0.0::double, 2 * list_sum(list_transform(range(1, 101),
    lambda j: (case when j % 2 = 1 then 1 else -1 end) * exp(-2 * j * j * t * t))))) end as p
  from (select *, ks * sqrt(n::double * m / (n + m)) as t from kss))"""

# The same test on the edges of the bins, with the values outside the range as bins -1 and 10.
EDGE_KS = """every as (select * from hist
  union all select r.feature, -1, 0, (select count(*) from longs l where l.feature = r.feature and later and value < low) from ranges r
  union all select r.feature, 10, 0, (select count(*) from longs l where l.feature = r.feature and later and value > high) from ranges r),
kss as (select feature, n, m, max(abs(fb / n::double - fc / m::double)) as ks from (
  select feature, sum(base) over w as fb, sum(cur) over w as fc, sum(base) over (partition by feature) as n, sum(cur) over (partition by feature) as m
  from every window w as (partition by feature order by bin)) group by all),
""" + KS[KS.index("kps as"):]


@query(f"with {SIDES} select feature, bin::int as bin, base, cur from hist")
def drift_histograms(spark, d):
    before, after = halves(spark, d)
    return drift.histograms(drift.feature_rows(before, FEATURES), drift.feature_rows(after, FEATURES))


@query(f"with {SIDES}, {PSI} select feature, round(psi, 6) as psi from psis")
def population_stability(spark, d):
    before, after = halves(spark, d)
    bins = drift.histograms(drift.feature_rows(before, FEATURES), drift.feature_rows(after, FEATURES))
    return drift.psi_scores(bins).withColumn("psi", F.round("psi", 6))


@query(f"with {SIDES}, {JS} select feature, round(js, 6) as js_distance from jss")
def jensen_shannon(spark, d):
    before, after = halves(spark, d)
    bins = drift.histograms(drift.feature_rows(before, FEATURES), drift.feature_rows(after, FEATURES))
    return drift.js_distances(bins).withColumn("js_distance", F.round("js_distance", 6))


@query(f"with {SIDES}, {KS} select feature, round(ks, 9) as ks_statistic, round(p, 6) as ks_p_value, p < 0.05 as ks_drift from kps")
def kolmogorov_smirnov(spark, d):
    before, after = halves(spark, d)
    out = drift.ks_tests(drift.feature_rows(before, FEATURES), drift.feature_rows(after, FEATURES))
    return out.withColumns({"ks_statistic": F.round("ks_statistic", 9), "ks_p_value": F.round("ks_p_value", 6)})


CHI = """cats as (select value, count(*) filter (where not later) as b, count(*) filter (where later) as c from kinds group by 1),
chi as (select sum((o - e) * (o - e) / e) as x, count(*) - 1 as df, bool_or(gap) as gap from (
  select m * case when b = 0 then 0.0001::double else b / n::double end as e, m * case when c = 0 then 0.0001::double else c / m::double end as o, b = 0 or c = 0 as gap
  from cats, (select sum(b)::double as n, sum(c)::double as m from cats)))"""


@query(f"""with kinds as (select event_type as value, ts >= timestamp '{EVENT_CUT}' as later from events), {CHI}
select 'event_type' as feature, round(x, 6) as chi2_statistic, df as degrees, gap as sums_differ,
  round(exp(-x / 2) * (1 + x / 2), 6) as chi2_p_value, exp(-x / 2) * (1 + x / 2) < 0.05 as chi2_drift from chi""")
def chi_square(spark, d):
    df = table(spark, d, "events")
    cut = F.lit(EVENT_CUT).cast("timestamp_ntz")
    out = drift.chi_square_tests(
        drift.category_rows(df.where(F.col("ts") < cut), ["event_type"]),
        drift.category_rows(df.where(F.col("ts") >= cut), ["event_type"]),
    )
    return out.withColumns({c: F.round(c, 6) for c in ("chi2_statistic", "chi2_p_value")})


@query(f"""with kinds as (select case when ts >= timestamp '{EVENT_CUT}' and event_type = 'view' then 'watch' else event_type end as value, ts >= timestamp '{EVENT_CUT}' as later from events), {CHI}
select 'event_type' as feature, round(x, 2) as chi2_statistic, df as degrees, gap as sums_differ from chi""")
def chi_square_new_category(spark, d):
    cut = F.lit(EVENT_CUT).cast("timestamp_ntz")
    later = F.col("ts") >= cut
    kind = F.when(later & (F.col("event_type") == "view"), "watch").otherwise(F.col("event_type"))
    df = table(spark, d, "events").select("ts", kind.alias("event_type"))
    out = drift.chi_square_tests(
        drift.category_rows(df.where(~later), ["event_type"]), drift.category_rows(df.where(later), ["event_type"])
    )
    return out.select("feature", F.round("chi2_statistic", 2).alias("chi2_statistic"), "degrees", "sums_differ")


@query(f"""with {SIDES}, {PSI}, {JS}, {KS} select feature, 'numerical' as kind, round(psi, 6) as psi, round(js, 6) as js_distance, round(ks, 6) as ks_statistic,
  round(p, 6) as ks_p_value, psi > 0.2 or p < 0.05 as has_drift from psis join jss using (feature) join kps using (feature)""")
def drift_report(spark, d):
    before, after = halves(spark, d)
    out = monitoring.drift_report(before, after, FEATURES)
    names = ("psi", "js_distance", "ks_statistic", "ks_p_value")
    return out.select("feature", "kind", *[F.round(c, 6).alias(c) for c in names], "has_drift")


def chi_sql(column: str, name: str) -> str:
    """Chi-square statistic and degrees of a column of ``sides``."""
    return f"""{name} as (select '{column}' as feature, sum((o - e) * (o - e) / e) as x, count(*) - 1 as df from (
  select m * b / n as e, c::double as o from (select {column}, (count(*) filter (where not later))::double as b, count(*) filter (where later) as c from sides group by 1),
    (select (count(*) filter (where not later))::double as n, count(*) filter (where later) as m from sides)))"""


# Upper tail for 1, 2 and 4 degrees of freedom; the first by the series of the error function.
TAIL_SQL = """case df when 2 then exp(-x / 2) when 4 then exp(-x / 2) * (1 + x / 2) else 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60),
  lambda k: (case when k % 2 = 0 then 1 else -1 end) * pow(sqrt(x / 2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) end"""


def rounded(report):
    names = ("psi", "js_distance", "ks_statistic", "ks_p_value", "chi2_statistic", "chi2_p_value")
    return report.select("feature", "kind", *[F.round(c, 6).alias(c) for c in names], "has_drift")


@query(f"""with {SIDES}, {PSI}, {JS}, {KS}, {chi_sql("l_returnflag", "c1")}, {chi_sql("l_linestatus", "c2")},
cs as (select feature, x, {TAIL_SQL} as p from (select * from c1 union all select * from c2))
select feature, 'numerical' as kind, round(psi, 6) as psi, round(js, 6) as js_distance, round(ks, 6) as ks_statistic, round(p, 6) as ks_p_value,
  null::double as chi2_statistic, null::double as chi2_p_value, psi > 0.2 or p < 0.05 as has_drift from psis join jss using (feature) join kps using (feature)
union all select feature, 'categorical', null, null, null, null, round(x, 6), round(p, 6), p < 0.05 from cs""")
def drift_report_mixed(spark, d):
    before, after = halves(spark, d)
    return rounded(monitoring.drift_report(before, after, FEATURES, ["l_returnflag", "l_linestatus"]))


@query(f"""with {SIDES}, {PSI}, {KS}, v as (select psi > 0.2 or p < 0.05 as drifted from psis join kps using (feature))
select count(*) as features, count(*) filter (where drifted) as drifted, avg(drifted::int)::double as overall_drift_score, avg(drifted::int) >= 0.3 as has_data_drift from v""")
def drift_overall(spark, d):
    before, after = halves(spark, d)
    return monitoring.overall_drift(monitoring.drift_report(before, after, FEATURES))


@query(f"""with {SIDES}, {PSI}, {KS}, v as (select avg((psi > 0.2 or p < 0.05)::int)::double as score from psis join kps using (feature))
select 'HIGH_DRIFT_DETECTED' as event_type, 'WARNING' as severity, 'Data Drift Detected (Score: ' || printf('%.2f', score) || ')' as title,
  '{{"model_version_id":"v1","drift_score":' || score || ',"report_id":"r1"}}' as payload, 'pending' as status from v where score >= 0.25""")
def drift_events(spark, d):
    before, after = halves(spark, d)
    overall = monitoring.overall_drift(monitoring.drift_report(before, after, FEATURES))
    return monitoring.drift_events(overall.withColumn("has_data_drift", F.col("overall_drift_score") >= 0.25), "v1", "r1")


WINDOW_SIDES = SIDES[SIDES.index("ranges as"):]
WINDOWED = f"""sides as (select value, event_type, ts >= timestamp '2024-01-22' as later from events where (ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-15')
  or (ts >= timestamp '2024-01-22' and ts < timestamp '2024-01-29')), longs as (select 'value' as feature, value, later from sides), {WINDOW_SIDES}"""


@query(f"""with {WINDOWED}, {PSI}, {JS}, {KS}, {chi_sql("event_type", "c1")}, cs as (select feature, x, {TAIL_SQL} as p from c1)
select feature, 'numerical' as kind, round(psi, 6) as psi, round(js, 6) as js_distance, round(ks, 6) as ks_statistic, round(p, 6) as ks_p_value,
  null::double as chi2_statistic, null::double as chi2_p_value, psi > 0.2 or p < 0.05 as has_drift from psis join jss using (feature) join kps using (feature)
union all select feature, 'categorical', null, null, null, null, round(x, 6), round(p, 6), p < 0.05 from cs""")
def drift_window(spark, d):
    report = monitoring.monitoring_run(
        table(spark, d, "events"), "ts", ("2024-01-01 00:00:00", "2024-01-15 00:00:00"),
        ("2024-01-22 00:00:00", "2024-01-29 00:00:00"), ["value"], ["event_type"])
    return rounded(report)


@query(f"""with {SIDES}, s as (select feature, count(*) as sample_size, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std,
  min(value) as low, max(value) as high from longs where not later group by 1)
select s.*, (select string_agg(base::varchar, ',' order by bin) from hist h where h.feature = s.feature) as bin_counts from s""")
def baseline_snapshot(spark, d):
    before, _ = halves(spark, d)
    out = monitoring.baseline_snapshot(before, FEATURES)
    counts = F.array_join(F.transform("bin_counts", lambda x: x.cast("string")), ",")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "bin_counts": counts})


SNAPSHOT_SQL = """round(psi, 6) as psi, round(js, 6) as js_distance, round(ks, 6) as ks_statistic, round(p, 6) as ks_p_value, psi > 0.2 or p < 0.05 as has_drift
from psis join jss using (feature) join kps using (feature)"""


def rounded_verdicts(df):
    return df.withColumns({c: F.round(c, 6) for c in ("psi", "js_distance", "ks_statistic", "ks_p_value")})


@query(f"with {SIDES}, {PSI}, {JS}, {EDGE_KS} select feature, {SNAPSHOT_SQL}")
def drift_against_snapshot(spark, d):
    before, after = halves(spark, d)
    return rounded_verdicts(monitoring.drift_against_snapshot(monitoring.baseline_snapshot(before, FEATURES), after, FEATURES))


FAR_SIDES = SIDES.replace("l_discount, l_tax, l_returnflag", "case when l_shipdate >= timestamp '" + CUT + "' then l_discount + 5 else l_discount end as l_discount, l_tax, l_returnflag")


@query(f"with {FAR_SIDES}, {PSI}, {JS.replace('greatest(0, (', 'greatest(0::double, (')}, {EDGE_KS} select feature, {SNAPSHOT_SQL.replace('round(js, 6)', 'case when feature <> $$l_discount$$ then round(js, 6) end')}")
def drift_fully_outside(spark, d):
    """One feature has left the baseline's range with every value: no distance, and drift."""
    before, after = halves(spark, d)
    after = after.withColumn("l_discount", F.col("l_discount") + 5)
    return rounded_verdicts(monitoring.drift_against_snapshot(monitoring.baseline_snapshot(before, FEATURES), after, FEATURES))


# ---------------------------------------------------------------- baselines that merge

KINDS = ["l_returnflag", "l_linestatus"]
MIDDLE = "1996-01-01 00:00:00"


def baseline_parts(spark, d):
    """The baseline in two parts, as of two days, and the rows after it."""
    before, after = halves(spark, d)
    cut = F.lit(MIDDLE).cast("timestamp_ntz")
    return before.where(F.col("l_shipdate") < cut), before.where(F.col("l_shipdate") >= cut), after


@query(f"""with {SIDES} select feature, count(*) as sample_size, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, min(value) as low, max(value) as high
from longs where not later group by 1""")
def merged_baseline(spark, d):
    one, two, _ = baseline_parts(spark, d)
    merged = monitoring.merge_baselines(monitoring.baseline_sketch(one, FEATURES).unionByName(monitoring.baseline_sketch(two, FEATURES)))
    std = F.sqrt(F.col("deviations") / (F.col("sample_size") - 1))
    return merged.select("feature", "sample_size", F.round("mean", 4).alias("mean"), F.round(std, 4).alias("std"), "low", "high")


@query()
def drift_against_sketch(spark, d):
    """KS against a baseline of two merged sketches; an estimate with a stated error, so
    no SQL gives the same digits."""
    one, two, after = baseline_parts(spark, d)
    merged = monitoring.merge_baselines(monitoring.baseline_sketch(one, FEATURES).unionByName(monitoring.baseline_sketch(two, FEATURES)))
    return monitoring.drift_against_sketch(merged, after, FEATURES)


@query(f"""with {SIDES}, k as (select unnest(['l_returnflag', 'l_linestatus']) as feature, unnest([l_returnflag, l_linestatus]) as value from sides where not later)
select feature, value, count(*) as base from k where value is not null group by 1, 2""")
def category_snapshot(spark, d):
    one, two, _ = baseline_parts(spark, d)
    return monitoring.merge_category_snapshots(monitoring.category_snapshot(one, KINDS).unionByName(monitoring.category_snapshot(two, KINDS)))


@query(f"""with {SIDES}, {chi_sql("l_returnflag", "c1")}, {chi_sql("l_linestatus", "c2")}, cs as (select feature, x, {TAIL_SQL} as p from (select * from c1 union all select * from c2))
select feature, round(x, 6) as chi2_statistic, round(p, 6) as chi2_p_value, p < 0.05 as has_drift from cs""")
def category_drift_against_snapshot(spark, d):
    one, two, after = baseline_parts(spark, d)
    stored = monitoring.merge_category_snapshots(monitoring.category_snapshot(one, KINDS).unionByName(monitoring.category_snapshot(two, KINDS)))
    out = monitoring.category_drift_against_snapshot(stored, after, KINDS)
    return out.withColumns({c: F.round(c, 6) for c in ("chi2_statistic", "chi2_p_value")})
