"""Preprocessing and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.catalog.profiling import GAPS_SQL, gaps
from plumbline.operators import encode, generate, impute, scale, select, transform
from plumbline.operators.ordered import carry_forward
from plumbline.plans import preprocessing

KEYS = "l_orderkey, l_partkey, l_suppkey"


def rounded(df, digits, *names):
    return df.withColumns({c: F.round(c, digits) for c in names})


# ---------------------------------------------------------------- missing values

@query(f"""with {GAPS_SQL}, f as (select avg(l_quantity) as q, avg(l_linenumber::double) as n from gaps),
  r as (select l_returnflag as m from gaps where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)
select {KEYS}, round(coalesce(l_linenumber::double, n), 6) as l_linenumber, round(coalesce(l_quantity, q), 6) as l_quantity,
  coalesce(l_returnflag, m) as l_returnflag from gaps, f, r""")
def impute_mean(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_linenumber", "l_quantity", "l_returnflag")
    return rounded(impute.fit_imputer(df, "mean").transform(df), 6, "l_linenumber", "l_quantity")


@query(f"""with {GAPS_SQL}, f as (select median(l_quantity) as q, median(l_linenumber::double) as n from gaps)
select {KEYS}, coalesce(l_linenumber::double, n) as l_linenumber, coalesce(l_quantity, q) as l_quantity from gaps, f""")
def impute_median(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_linenumber", "l_quantity")
    return impute.fit_imputer(df, "median").transform(df)


@query(f"""with {GAPS_SQL},
  q as (select l_quantity as q from gaps where l_quantity is not null group by 1 order by count(*) desc, 1 limit 1),
  n as (select l_linenumber as n from gaps where l_linenumber is not null group by 1 order by count(*) desc, 1 limit 1),
  r as (select l_returnflag as m from gaps where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)
select {KEYS}, coalesce(l_linenumber, n) as l_linenumber, coalesce(l_quantity, q) as l_quantity, coalesce(l_returnflag, m) as l_returnflag
from gaps, q, n, r""")
def impute_mode(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_linenumber", "l_quantity", "l_returnflag")
    return impute.fit_imputer(df, "mode").transform(df)


@query(f"""with {GAPS_SQL} select {KEYS}, coalesce(l_linenumber, 0) as l_linenumber, coalesce(l_quantity, 0) as l_quantity,
  coalesce(l_returnflag, '0') as l_returnflag from gaps""")
def impute_constant(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_linenumber", "l_quantity", "l_returnflag")
    return impute.fit_imputer(df, "constant").transform(df)


def sparse_events(spark, d):
    quiet = F.when(~F.col("event_type").isin("error", "view"), F.col("value"))
    return table(spark, d, "events").select("event_id", "ts", "user_id", quiet.alias("value"))


SPARSE_SQL = "sparse as (select event_id, ts, user_id, case when event_type not in ('error', 'view') then value end as value from events)"


@query(f"""with {SPARSE_SQL} select event_id, user_id, last_value(value ignore nulls) over (
  partition by user_id order by ts, event_id rows between unbounded preceding and current row) as value from sparse""")
def forward_fill_by_user(spark, d):
    return carry_forward(sparse_events(spark, d), ["value"], ["ts", "event_id"], ["user_id"]).drop("ts")


@query(f"""with {SPARSE_SQL} select event_id, user_id, last_value(value ignore nulls) over (
  order by ts, event_id rows between unbounded preceding and current row) as value from sparse""")
def forward_fill(spark, d):
    df = sparse_events(spark, d)
    return impute.fit_imputer(df, "ffill").transform(df, ["ts", "event_id"]).drop("ts")


@query(f"""with {SPARSE_SQL} select event_id, user_id, first_value(value ignore nulls) over (
  order by ts, event_id rows between current row and unbounded following) as value from sparse""")
def backward_fill(spark, d):
    df = sparse_events(spark, d)
    return impute.fit_imputer(df, "bfill").transform(df, ["ts", "event_id"]).drop("ts")


@query(f"""with {GAPS_SQL} select * exclude (l_shipdate) from gaps where l_linenumber is not null and l_quantity is not null
  and l_returnflag is not null and l_shipdate is not null""")
def drop_missing_rows(spark, d):
    df = gaps(spark, d)
    return impute.fit_imputer(df, "drop_rows").transform(df).drop("l_shipdate")


@query(f"with {GAPS_SQL} select {KEYS}, l_extendedprice, l_discount, l_tax, l_linestatus from gaps")
def drop_missing_columns(spark, d):
    df = gaps(spark, d)
    return impute.fit_imputer(df, "drop_columns").transform(df)


@query(f"""with {GAPS_SQL}, f as (select median(l_quantity) as q, median(l_linenumber::double) as n from gaps),
  r as (select l_returnflag as m from gaps where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)
select {KEYS}, coalesce(l_linenumber::double, n) as l_linenumber, coalesce(l_quantity, q) as l_quantity, coalesce(l_returnflag, m) as l_returnflag
from gaps, f, r""")
def impute_auto(spark, d):
    df = gaps(spark, d).select(
        *KEYS.split(", "), "l_linenumber", "l_quantity", "l_returnflag",
        F.when(F.col("l_tax") > 0.06, 1).alias("mostly_gone"),
    )
    return impute.fit_imputer(df, "auto").transform(df)


# ---------------------------------------------------------------- generated features

@query("""select o_orderkey, year(o_orderdate)::int as o_orderdate__year, month(o_orderdate)::int as o_orderdate__month,
  day(o_orderdate)::int as o_orderdate__day, hour(o_orderdate)::int as o_orderdate__hour,
  (isodow(o_orderdate) - 1)::int as o_orderdate__weekday, quarter(o_orderdate)::int as o_orderdate__quarter from orders""")
def date_features(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return generate.date_features(df).drop("o_orderdate")


@query(f"""with {GAPS_SQL} select {KEYS}, length(coalesce(l_returnflag, 'nan'))::int as l_returnflag__length,
  length(coalesce(l_linestatus, 'nan'))::int as l_linestatus__length from gaps""")
def text_lengths(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_returnflag", "l_linestatus")
    return generate.text_lengths(df).drop("l_returnflag", "l_linestatus")


@query(f"""with {GAPS_SQL}, z as (select {KEYS}, coalesce(l_quantity, 0) as a, l_discount as b, l_tax as c from gaps)
select {KEYS}, round(a*a, 6) as "l_quantity^2", round(a*b, 6) as "l_quantity l_discount", round(a*c, 6) as "l_quantity l_tax",
  round(b*b, 6) as "l_discount^2", round(b*c, 6) as "l_discount l_tax", round(c*c, 6) as "l_tax^2" from z""")
def polynomial_terms(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_quantity", "l_discount", "l_tax")
    out = generate.polynomial_terms(df, 2, columns=["l_quantity", "l_discount", "l_tax"])
    new = [c for c in out.columns if " " in c or "^" in c]
    return out.select(*KEYS.split(", "), *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in new])


TWELVE = [f"c{i}" for i in range(12)]
TWELVE_TERMS = [(a, b) for i, a in enumerate(TWELVE) for b in TWELVE[i:]]


@query("select c_custkey, " + ", ".join(
    f"((c_custkey + {a[1:]}) % {int(a[1:]) + 5} * ((c_custkey + {b[1:]}) % {int(b[1:]) + 5}))::double as \"{a + '^2' if a == b else a + ' ' + b}\"" for a, b in TWELVE_TERMS) + " from customer")
def polynomial_terms_many(spark, d):
    """Twelve named columns give all 78 products."""
    key = F.col("c_custkey")
    df = table(spark, d, "customer").select("c_custkey", *[((key + i) % (i + 5)).alias(f"c{i}") for i in range(12)])
    return generate.polynomial_terms(df, 2, columns=TWELVE).drop(*TWELVE)


# ---------------------------------------------------------------- encoders

@query("""select c_custkey, (c_mktsegment = 'AUTOMOBILE')::int as "c_mktsegment_AUTOMOBILE", (c_mktsegment = 'BUILDING')::int as "c_mktsegment_BUILDING",
  (c_mktsegment = 'FURNITURE')::int as "c_mktsegment_FURNITURE", (c_mktsegment = 'HOUSEHOLD')::int as "c_mktsegment_HOUSEHOLD",
  (c_mktsegment = 'MACHINERY')::int as "c_mktsegment_MACHINERY" from customer""")
def one_hot(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return encode.fit_encoder(df, "onehot").transform(df)


LABEL_SQL = """(select value, row_number() over (order by value) - 1 as code from (select distinct {e} as value from {t}))"""


@query(f"""with {GAPS_SQL} select {KEYS}, r.code as l_returnflag, s.code as l_linestatus from gaps
  join {LABEL_SQL.format(e="coalesce(l_returnflag, 'nan')", t="gaps")} r on r.value = coalesce(l_returnflag, 'nan')
  join {LABEL_SQL.format(e="l_linestatus", t="gaps")} s on s.value = l_linestatus""")
def label_encode(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_returnflag", "l_linestatus")
    return encode.fit_encoder(df, "label").transform(df)


@query(f"""select c_custkey, code as c_name from customer join {LABEL_SQL.format(e="c_name", t="customer")} on value = c_name""")
def label_encode_unique(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    return encode.fit_encoder(df, "auto").transform(df)


@query(f"""select o_orderkey, code as o_orderpriority from orders join {LABEL_SQL.format(e="o_orderpriority", t="orders")} on value = o_orderpriority""")
def ordinal_encode(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return encode.fit_encoder(df, "ordinal").transform(df)


@query(f"""with {GAPS_SQL}, f as (select l_returnflag as value, count(*) / (select count(l_returnflag) from gaps)::double as share
    from gaps where l_returnflag is not null group by 1)
select {KEYS}, round(coalesce(share, 0), 9) as l_returnflag from gaps left join f on value = l_returnflag""")
def frequency_encode(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_returnflag")
    return rounded(encode.fit_encoder(df, "frequency").transform(df), 9, "l_returnflag")


# ---------------------------------------------------------------- scalers

SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def scaled_sql(formula: str, limits: str) -> str:
    fits = ", ".join(limits.format(c=c) for c in SCALED)
    return (f"with {GAPS_SQL}, f as (select {fits} from gaps) select {KEYS}, "
            + ", ".join(f"round({formula.format(c=c)}, 6) as {c}" for c in SCALED) + " from gaps, f")


def scaled(spark, d, strategy):
    df = gaps(spark, d).select(*KEYS.split(", "), *SCALED)
    fit = scale.fit_scaler(df, strategy, exclude=KEYS.split(", "))
    return rounded(fit.transform(df), 6, *SCALED)


@query(scaled_sql("({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end", "avg({c}) as m_{c}, stddev_pop({c}) as s_{c}"))
def standard_scale(spark, d):
    return scaled(spark, d, "standard")


@query(scaled_sql("({c} - a_{c}) / case when b_{c} = a_{c} then 1 else b_{c} - a_{c} end", "min({c}) as a_{c}, max({c}) as b_{c}"))
def minmax_scale(spark, d):
    return scaled(spark, d, "minmax")


@query(scaled_sql("({c} - m_{c}) / case when b_{c} = a_{c} then 1 else b_{c} - a_{c} end",
                  "quantile_cont({c}, 0.25) as a_{c}, median({c}) as m_{c}, quantile_cont({c}, 0.75) as b_{c}"))
def robust_scale(spark, d):
    return scaled(spark, d, "auto")


@query(scaled_sql("{c} / case when b_{c} = 0 then 1 else b_{c} end", "max(abs({c})) as b_{c}"))
def maxabs_scale(spark, d):
    return scaled(spark, d, "maxabs")


UNIT = ["l_extendedprice", "l_discount", "l_tax"]


@query(f"select {KEYS}, " + ", ".join(
    f"round({c} / case when n = 0 then 1 else n end, 9) as {c}" for c in UNIT) + f""" from (
  select *, sqrt({" + ".join(f"{c} * {c}" for c in UNIT)}) as n from lineitem)""")
def unit_rows(spark, d):
    df = table(spark, d, "lineitem").select(*KEYS.split(", "), *UNIT)
    return rounded(scale.fit_scaler(df, "normalizer", exclude=KEYS.split(", ")).transform(df), 9, *UNIT)


@query(f"with {GAPS_SQL} " + " union all ".join(f"""
select '{c}' as column_name, round(avg({c}), 4) as mean, round(stddev_pop({c}), 4) as std, min({c}) as data_min, max({c}) as data_max,
  round(median({c}), 4) as middle, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) as spread from gaps""" for c in SCALED))
def scaler_parameters(spark, d):
    df = gaps(spark, d).select(*SCALED)
    standard = scale.fit_scaler(df, "standard").params(spark).select(
        "column_name", F.round("center", 4).alias("mean"), F.round("scale", 4).alias("std"))
    limits = scale.fit_scaler(df, "minmax").params(spark).select("column_name", "data_min", "data_max")
    robust = scale.fit_scaler(df, "robust").params(spark).select(
        "column_name", F.round("center", 4).alias("middle"), F.round("scale", 4).alias("spread"))
    return standard.join(limits, "column_name").join(robust, "column_name")


# ---------------------------------------------------------------- transforms

@query(f"with {GAPS_SQL} select {KEYS}, round(ln(1 + l_extendedprice), 6) as l_extendedprice, l_discount, l_quantity from gaps")
def log_transform(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_extendedprice", "l_discount", "l_quantity")
    fit = transform.fit_transformer(df, apply_log=True, exclude=KEYS.split(", "))
    return rounded(fit.transform(df), 6, "l_extendedprice")


@query(f"with {GAPS_SQL} select {KEYS}, round(sqrt(l_extendedprice), 6) as l_extendedprice, round(sqrt(l_discount), 6) as l_discount, l_quantity from gaps")
def sqrt_transform(spark, d):
    df = gaps(spark, d).select(*KEYS.split(", "), "l_extendedprice", "l_discount", "l_quantity")
    fit = transform.fit_transformer(df, apply_sqrt=True, exclude=KEYS.split(", "))
    return rounded(fit.transform(df), 6, "l_extendedprice", "l_discount")


@query("""with x as (select event_id, value - 30 as v from events)
select event_id, round(case when v >= 0 then (pow(v + 1, 0.25) - 1) / 0.25::double else -(pow(1 - v, 1.75) - 1) / 1.75::double end, 6) as value from x""")
def power_transform_fixed(spark, d):
    df = table(spark, d, "events").select("event_id", (F.col("value") - 30).alias("value"))
    return df.select("event_id", F.round(transform.yeo_johnson(F.col("value"), 0.25), 6).alias("value"))


@query()
def power_transform_fitted(spark, d):
    df = table(spark, d, "events").select("event_id", "value", F.col("event_type"))
    fit = transform.fit_transformer(df, exclude=["event_id"])
    return fit.transform(df).select("event_id", "value", F.lit(round(fit.powers["value"], 4)).alias("power"))


@query("""with grid as (select unnest(range(-200, 201)) / 100.0::double as p), base as (select value as x from events),
ys as (select p, var_pop(case when p = 0 then ln(1 + x) else (pow(x + 1, p) - 1) / p end) as v from base, grid group by p),
scores as (select p, -n / 2.0 * ln(v) + (p - 1) * l as score from ys, (select count(*) as n, sum(ln(1 + x)) as l from base))
select 'value' as column_name, 'yeo_johnson' as method, arg_max(p, score) as power from scores""")
def fitted_power(spark, d):
    """The exponent to two digits; the values are positive, so the SQL needs one branch."""
    df = table(spark, d, "events").select("value")
    return transform.fit_transformer(df).params(spark).withColumn("power", F.round("power", 2))


# ---------------------------------------------------------------- selection

VARIANCE_COLUMNS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query(f"with {GAPS_SQL} " + " union all ".join(
    f"select '{c}' as column_name, round(var_pop(coalesce({c}, 0)::double), 6) as variance, var_pop(coalesce({c}, 0)::double) <= 0.01 as dropped from gaps"
    for c in VARIANCE_COLUMNS))
def variance_filter(spark, d):
    df = gaps(spark, d).select(*VARIANCE_COLUMNS)
    fit = select.fit_selection(df, "variance")
    return select.variances(df).select(
        "column_name", F.round("variance", 6).alias("variance"), F.col("column_name").isin(*fit.dropped).alias("dropped"))


CORR = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "net": "l_extendedprice * (1 - l_discount)",
        "l_discount": "l_discount", "taxed": "l_extendedprice * (1 + l_tax)"}
CORR_PAIRS = [(a, b) for i, a in enumerate(CORR) for j, b in enumerate(CORR) if i < j]
CORR_SQL = f"with {GAPS_SQL}, w as (select " + ", ".join(f"{e} as {c}" for c, e in CORR.items()) + " from gaps), r as (" + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as correlation from w" for a, b in CORR_PAIRS) + ") "


def correlated(spark, d):
    return gaps(spark, d).selectExpr(*[f"{e} as {c}" for c, e in CORR.items()])


@query(CORR_SQL + "select col_a, col_b, round(correlation, 6) as correlation from r")
def correlations(spark, d):
    return rounded(select.correlations(correlated(spark, d)), 6, "correlation")


@query(CORR_SQL + ", hit as (select distinct col_b from r where abs(correlation) > 0.95) select " + ", ".join(
    f"(select round(sum({c}), 0) from w) as {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + """
  , (select count(*) from hit) as dropped_count""")
def correlation_filter(spark, d):
    df = correlated(spark, d)
    fit = select.fit_selection(df, "correlation")
    kept = fit.transform(df)
    return kept.agg(*[F.round(F.sum(c), 0).alias(c) for c in kept.columns],
                    F.lit(len(fit.dropped)).cast("long").alias("dropped_count"))


SCORED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def anova_sql(c):
    return f"""select '{c}' as column_name, (b / (g - 1)) / (w / (n - g)) as f from (
  select sum(k * (m - mu) * (m - mu)) as b, sum(k * v) as w, count(*) as g, sum(k) as n from (
    select l_returnflag, count(*) as k, avg(coalesce({c}, 0)) as m, var_pop(coalesce({c}, 0)) as v from lineitem group by 1),
    (select avg(coalesce({c}, 0)) as mu from lineitem))"""


@query(" union all ".join(f"select column_name, round(f, 4) as f_score from ({anova_sql(c)})" for c in SCORED))
def anova_scores(spark, d):
    df = table(spark, d, "lineitem", heavy=True).select(*SCORED, "l_returnflag")
    return rounded(select.anova_scores(df, "l_returnflag"), 4, "f_score")


@query(f"""with f as ({" union all ".join(anova_sql(c) for c in SCORED)})
select column_name, row_number() over (order by f desc) <= 2 as kept from f""")
def kbest_filter(spark, d):
    df = table(spark, d, "lineitem", heavy=True).select(*SCORED, "l_returnflag")
    fit = select.fit_selection(df, "kbest", "l_returnflag", k_best=2)
    return select.anova_scores(df, "l_returnflag").select("column_name", (~F.col("column_name").isin(*fit.dropped)).alias("kept"))


def mi_sql(c):
    edges = "[" + ", ".join(f"quantile_cont({c}, {i}/16.0::double)" for i in range(1, 16)) + "]"
    return f"""select '{c}' as column_name, sum(n / t * ln(n * t / (nx * ny))) as mi from (
  select n::double as n, sum(n) over (partition by b)::double as nx, sum(n) over (partition by y)::double as ny, sum(n) over ()::double as t from (
    select len(list_filter(e, lambda q: {c} > q)) as b, l_linestatus as y, count(*) as n
    from lineitem, (select {edges} as e from lineitem) group by 1, 2))"""


@query(" union all ".join(f"select column_name, round(mi, 6) as mutual_information from ({mi_sql(c)})" for c in SCORED))
def mutual_information(spark, d):
    df = table(spark, d, "lineitem", heavy=True).select(*SCORED, "l_linestatus")
    return rounded(select.mutual_information(df, "l_linestatus"), 6, "mutual_information")


# ---------------------------------------------------------------- whole run

@query(f"""with {GAPS_SQL}, f as (select median(l_quantity) as q from gaps),
  m as (select l_returnflag as m from gaps where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1),
  g as (select coalesce(l_quantity, q) as l_quantity, l_extendedprice, coalesce(l_returnflag, m) as r, l_linestatus from gaps, f, m),
  s as (select quantile_cont(l_quantity, 0.25) as qa, median(l_quantity) as qm, quantile_cont(l_quantity, 0.75) as qb,
    quantile_cont(l_extendedprice, 0.25) as pa, median(l_extendedprice) as pm, quantile_cont(l_extendedprice, 0.75) as pb from g),
  h as (select r, avg((r = 'A')::int) over () as a, avg((r = 'N')::int) over () as n, l_linestatus, l_quantity, l_extendedprice from g)
select round((l_quantity - qm) / (qb - qa), 6) as l_quantity, round((l_extendedprice - pm) / (pb - pa), 6) as l_extendedprice, l_linestatus
from h, s""")
def preprocess_run(spark, d):
    df = gaps(spark, d).select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    settings = preprocessing.Settings(
        target="l_linestatus",
        drop_columns=["l_orderkey"],
        generation={"extract_text_length": False},
        encoding={"strategy": "label"},
        selection={"strategy": "variance", "variance_threshold": 0.2},
    )
    fit = preprocessing.fit_preprocessing(df, settings).whole()
    return rounded(fit.transform(df).drop("l_returnflag"), 6, "l_quantity", "l_extendedprice")


@query()
def preprocess_report(spark, d):
    df = gaps(spark, d)
    settings = preprocessing.Settings(target="l_linestatus", drop_columns=["l_orderkey", "l_partkey", "l_suppkey"])
    fit = preprocessing.fit_preprocessing(df, settings).whole()
    kept = fit.transform(df)
    return kept.groupBy("l_linestatus").agg(F.count("*").alias("row_count"), F.lit(len(kept.columns)).alias("column_count"))


@query("""with reports as (select o_custkey as dataset_id, o_orderdate as created_at, case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as status from orders)
select c_custkey as dataset_id from customer where exists (select 1 from reports where status = 'completed' and dataset_id = c_custkey)""")
def preprocess_gate(spark, d):
    datasets = table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    reports = table(spark, d, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"))
    return preprocessing.ready_for_preprocessing(datasets, reports)
