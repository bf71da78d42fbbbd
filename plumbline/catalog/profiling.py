"""Profiling and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import profile, quality, validate
from plumbline.plans import validation

# lineitem with gaps: three columns lose a value each, so that missing-value work has
# something to find. Used by both sides of the check.
GAPS_SQL = """gaps as (
  select l_orderkey, l_partkey, l_suppkey, nullif(l_linenumber, 1) as l_linenumber,
         nullif(l_quantity, 10.0) as l_quantity, l_extendedprice, l_discount, l_tax,
         nullif(l_returnflag, 'R') as l_returnflag, l_linestatus,
         case when l_linenumber = 7 then null else l_shipdate end as l_shipdate
  from lineitem)"""
TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
NUMERIC = [c for c, t in TYPES.items() if t in ("bigint", "int", "double")]
TEXT = [c for c, t in TYPES.items() if t == "string"]
EXPECTED = {
    "l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "float64",
    "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64",
    "l_returnflag": "object", "l_linestatus": "object", "l_shipdate": "datetime64[ns]", "l_comment": "object",
}


def gaps(spark, d):
    df = table(spark, d, "lineitem", heavy=True)
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.nullif(F.col("l_linenumber"), F.lit(1)).alias("l_linenumber"),
        F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        F.nullif(F.col("l_returnflag"), F.lit("R")).alias("l_returnflag"),
        "l_linestatus",
        F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("l_shipdate"),
    )


def each(columns, template: str) -> str:
    return " union all ".join(template.format(c=c, t=TYPES.get(c, "")) for c in columns)


DUPLICATES_SQL = (
    "select sum(k)::bigint as total_rows, sum(k - 1)::bigint as duplicate_rows, "
    "round(sum(k - 1) * 100.0::double / sum(k), 2) as duplicate_pct from "
    "(select count(*) as k from {t} group by {c})"
)


@query(f"with {GAPS_SQL} " + each(TYPES, """
select '{c}' as column_name, '{t}' as dtype, count(*) - count({c}) as null_count,
       round((count(*) - count({c})) * 100.0::double / count(*), 2) as null_pct,
       count(distinct {c}) as unique_count from gaps"""))
def schema_report(spark, d):
    return profile.schema_report(gaps(spark, d))


@query(f"""with {GAPS_SQL},
cells as (select count(*) as n, sum({" + ".join(f"({c} is null)::int" for c in TYPES)})::bigint as m,
  sum(69 + coalesce(octet_length(encode(l_returnflag)), 0) + coalesce(octet_length(encode(l_linestatus)), 0))::bigint as b from gaps),
dups as (select sum(k - 1)::bigint as k from (select count(*) as k from gaps group by {", ".join(TYPES)}))
select n as total_rows, 11::bigint as total_columns, n * 11 as total_cells, m as missing_cells,
  round(m * 100.0::double / (n * 11), 2) as missing_pct, k as duplicate_rows,
  round(k * 100.0::double / n, 2) as duplicate_pct, b - 1 * n as data_bytes
from cells, dups""")
def table_summary(spark, d):
    return profile.table_summary(gaps(spark, d))


@query(f"with {GAPS_SQL} " + each(NUMERIC, """
select '{c}' as column_name, count({c}) as value_count, round(avg({c}::double), 4) as mean,
  round(stddev_samp({c}::double), 4) as std, min({c})::double as min, max({c})::double as max,
  round(quantile_cont({c}::double, 0.25), 4) as p25, round(quantile_cont({c}::double, 0.5), 4) as p50,
  round(quantile_cont({c}::double, 0.75), 4) as p75 from gaps"""))
def numeric_profile(spark, d):
    return profile.numeric_profile(gaps(spark, d), digits=4)


@query(f"with {GAPS_SQL} select 'l_shipdate' as column_name, min(l_shipdate) as min_value, max(l_shipdate) as max_value from gaps")
def datetime_profile(spark, d):
    return profile.datetime_profile(gaps(spark, d))


@query("with v as (" + " union all ".join(
    f"select '{c}' as column_name, {c} as value, count(*) as cnt from part where {c} is not null group by {c}"
    for c in ("p_name", "p_brand", "p_type")) + """), r as (
  select *, row_number() over (partition by column_name order by cnt desc, value) as place from v)
select column_name, place, value, cnt from r where place <= 10""")
def top_values(spark, d):
    return profile.top_values(table(spark, d, "part"))


@query("select o_orderpriority as value, count(*) as cnt from orders group by 1")
def value_distribution(spark, d):
    return profile.value_distribution(table(spark, d, "orders"), "o_orderpriority")


@query(DUPLICATES_SQL.format(t="documents", c="text, lang, source"))
def duplicate_summary(spark, d):
    return profile.duplicate_summary(table(spark, d, "documents").select("text", "lang", "source"))


@query("""select doc_id, lang, source, n_chars from (
  select *, row_number() over (partition by text order by doc_id) as k from documents) where k > 1""")
def duplicate_rows(spark, d):
    docs = table(spark, d, "documents")
    return validate.duplicate_rows(docs, ["doc_id"], ["doc_id", "lang", "source"]).drop("text")


LONG = {**TYPES, "price_copy": "double", "order_copy": "bigint", "flag_copy": "string"}
LONG_PAIRS = [(a, b) for i, a in enumerate(LONG) for j, b in enumerate(LONG) if i < j and LONG[a] == LONG[b]]


@query(f"""with {GAPS_SQL}, wide as (select *, l_extendedprice as price_copy, l_orderkey as order_copy,
  coalesce(l_returnflag, 'R') as flag_copy from gaps) select col_a, col_b from (""" + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, count(*) filter (where {a} is distinct from {b}) as k from wide"
    for a, b in LONG_PAIRS) + ") where k = 0")
def identical_columns(spark, d):
    wide = gaps(spark, d).withColumns({
        "price_copy": F.col("l_extendedprice"),
        "order_copy": F.col("l_orderkey"),
        "flag_copy": F.coalesce("l_returnflag", F.lit("R")),
    })
    return validate.identical_columns(wide)


@query(f"with {GAPS_SQL}, m as (" + " union all ".join(f"""
select '{c}' as column_name, {i} as pos, count(*) - count({c}) as missing_count,
  round((count(*) - count({c})) * 100.0::double / count(*), 2) as missing_pct,
  '{"mean_or_median_imputation" if c in NUMERIC else "mode_or_constant_imputation" if c in TEXT else "forward_fill_or_interpolation"}' as way
from gaps""" for i, c in enumerate(TYPES)) + """)
select column_name, missing_count, missing_pct,
  case when missing_pct = 0 then 'none' when missing_pct > 50 then 'consider_dropping_column' else way end as suggestion,
  case when missing_count > 0 then row_number() over (partition by missing_count > 0 order by missing_count desc, pos) end as rank
from m""")
def missing_report(spark, d):
    return validate.missing_report(gaps(spark, d))


MISSING_SUM = "(" + " + ".join(f"count(*) - count({c})" for c in TYPES) + ")"


@query(f"""with {GAPS_SQL} select {MISSING_SUM} as total_missing_cells,
  round({MISSING_SUM} * 100.0::double / (count(*) * 11), 2) as total_missing_pct,
  {" + ".join(f"(count(*) > count({c}))::bigint" for c in TYPES)} as columns_with_missing from gaps""")
def missing_summary(spark, d):
    return validate.missing_summary(gaps(spark, d))


# Texts in five shapes, derived from orders: numbers, dates, a mixture, few and many values.
SHAPES_SQL = """shapes as (select cast(o_orderkey as varchar) as number_text,
  strftime(o_orderdate, '%Y-%m-%d') as date_text,
  case when o_orderstatus = 'P' then cast(o_custkey as varchar) else o_orderstatus end as mixed_text,
  o_orderpriority as level, 'order ' || o_orderkey as label, o_totalprice, o_orderdate from orders)"""
NUMBER_SQL = r"'^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$'"


def shapes(spark, d):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return table(spark, d, "orders").select(
        key.alias("number_text"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"),
        F.when(F.col("o_orderstatus") == "P", cust).otherwise(F.col("o_orderstatus")).alias("mixed_text"),
        F.col("o_orderpriority").alias("level"),
        F.concat(F.lit("order "), key).alias("label"),
        "o_totalprice", "o_orderdate",
    )


@query(f"with {SHAPES_SQL} " + " union all ".join(f"""
select '{c}' as column_name, 'string' as raw_dtype, case when mixed then 'mixed' else 'string' end as category,
  case when mixed then null when nums = n then 'convert_to_numeric' when dates = n then 'convert_to_datetime'
       when uniq / greatest(total, 1) < 0.05 then 'convert_to_category' end as suggestion
from (select *, ((nums > 0)::int + (dates > 0)::int + (n - nums - dates > 0)::int) > 1 as mixed from (
  select count(*) as total, count({c}) as n, count(distinct {c})::double as uniq,
    count(*) filter (where regexp_matches({c}, {NUMBER_SQL})) as nums,
    count(*) filter (where regexp_matches({c}, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_cast({c} as timestamp) is not null) as dates
  from shapes))""" for c in ("number_text", "date_text", "mixed_text", "level", "label")) + """
union all select 'o_totalprice', 'double', 'float', null
union all select 'o_orderdate', 'timestamp_ntz', 'datetime', null""")
def dtype_report(spark, d):
    return validate.dtype_report(shapes(spark, d))


@query(f"with {GAPS_SQL} select case column_type when 'INTEGER' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'float' when 'VARCHAR' then 'string' else 'datetime' end as category, count(*) as column_count from (select unnest(" + "[" + ", ".join("typeof(any_value(" + c + "))" for c in TYPES) + "]) as column_type from gaps) group by 1")
def type_summary(spark, d):
    return validate.type_summary(gaps(spark, d))


STATS_SQL = """
select '{c}' as column_name, count({c}) as value_count, round(avg({c}), 4) as mean, round(median({c}), 4) as median,
  round((select {c} from {t} where {c} is not null group by {c} order by count(*) desc, {c} limit 1), 4) as mode,
  round(stddev_samp({c}), 4) as std, round(var_samp({c}), 4) as variance, round(min({c}), 4) as min, round(max({c}), 4) as max,
  round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis,
  round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) as iqr,
  round(quantile_cont({c}, 0.05), 4) as p5, round(quantile_cont({c}, 0.95), 4) as p95 from {t}"""


@query(f"with {GAPS_SQL}" + " union all ".join(STATS_SQL.format(c=c, t="gaps") for c in ("l_quantity", "l_discount", "l_tax")))
def numeric_statistics(spark, d):
    return validate.numeric_statistics(gaps(spark, d), digits=4, names=["l_quantity", "l_discount", "l_tax"])


@query(STATS_SQL.format(c="value", t="events"))
def numeric_statistics_skewed(spark, d):
    return validate.numeric_statistics(table(spark, d, "events").select("value"), digits=4)


EVENT_COUNTS = "v as (" + " union all ".join(
    f"select '{c}' as column_name, {c} as value, count(*) as cnt, (select count(*) from events) as total from events where {c} is not null group by {c}"
    for c in ("event_type", "props")) + "), r as (select *, cnt < greatest(1.0, total * 0.01::double) as rare from v)"


@query(f"""with {EVENT_COUNTS} select column_name, count(*) as unique_count,
  round(count(*) / max(total)::double, 4) as cardinality_ratio, count(*) filter (where rare) as rare_count,
  count(*) = max(total) as all_unique, count(*) filter (where rare) > count(*) * 0.5 as many_rare
from r group by column_name""")
def categorical_report(spark, d):
    return validate.categorical_report(table(spark, d, "events"))


@query(f"""with {EVENT_COUNTS} select column_name, place, value, cnt from (
  select *, row_number() over (partition by column_name order by cnt desc, value) as place from r where rare) where place <= 20""")
def rare_values(spark, d):
    return validate.rare_values(table(spark, d, "events"))


DATES_SQL = """dated as (select o_orderdate,
  case when o_orderstatus = 'P' then 'unknown' when o_orderstatus = 'F' then null else strftime(o_orderdate, '%Y-%m-%d') end as date_text
  from orders)"""


@query(f"with {DATES_SQL} " + " union all ".join(f"""
select '{c}' as column_name, count({e}) as valid_count, count(*) filter (where {c} is not null and {e} is null) as invalid_count,
  count(*) filter (where {e} > timestamp '2000-01-01') as future_dates,
  count({e}) - count(distinct {e}) as duplicate_timestamps, min({e}) as min_date, max({e}) as max_date from dated"""
    for c, e in (("o_orderdate", "o_orderdate"), ("date_text", "try_cast(date_text as timestamp)"))))
def date_report(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", "unknown").when(
        F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, d, "orders").select("o_orderdate", text.alias("date_text"))
    return validate.date_report(df, now="2000-01-01 00:00:00", names=["o_orderdate", "date_text"])


OUTLIER_SQL = """
select '{c}' as column_name, round(q1, 4) as q1, round(q3, 4) as q3, round(q3 - q1, 4) as iqr,
  round(q1 - (q3 - q1) * 1.5::double, 4) as lower_fence, round(q3 + (q3 - q1) * 1.5::double, 4) as upper_fence,
  i as iqr_outliers, round(i * 100.0::double / n, 2) as iqr_outlier_pct, z as z_outliers, round(z * 100.0::double / n, 2) as z_outlier_pct
from (select any_value(q1) as q1, any_value(q3) as q3, count({c}) as n,
  count(*) filter (where {c} < q1 - (q3 - q1) * 1.5::double or {c} > q3 + (q3 - q1) * 1.5::double) as i,
  count(*) filter (where sd > 0 and abs(({c} - mu) / sd) > 3) as z
  from {t}, (select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3, avg({c}::double) as mu,
    stddev_samp({c}::double) as sd from {t}))"""


@query(OUTLIER_SQL.format(c="event_id", t="events") + " union all " + OUTLIER_SQL.format(c="user_id", t="events")
       + " union all " + OUTLIER_SQL.format(c="value", t="events"))
def outlier_report(spark, d):
    return validate.outlier_report(table(spark, d, "events"))


SCORE_SQL = f"""with {GAPS_SQL},
missing as (select greatest(0.0::double, 100.0::double - round({MISSING_SUM} * 100.0::double / (count(*) * 11), 2)) as s from gaps),
dup as (select greatest(0.0::double, 100.0::double - 2 * round(sum(k - 1) * 100.0::double / sum(k), 2)) as s
  from (select count(*) as k from gaps group by {", ".join(TYPES)})),
outlier as (select greatest(0.0::double, 100.0::double - avg(iqr_outlier_pct)) as s from (
  {" union all ".join("select * from (" + OUTLIER_SQL.format(c=c, t="gaps") + ")" for c in NUMERIC)})),
scores as (select 'completeness' as dimension, s, 0.30::double as weight from missing
  union all select 'validity', 65.0::double, 0.25::double union all select 'uniqueness', s, 0.20::double from dup
  union all select 'consistency', s, 0.20::double from outlier union all select 'accuracy', 85.0::double, 0.05::double),
total as (select round(sum(s * weight), 2) as overall_score from scores)
"""


@query(SCORE_SQL + """select dimension, round(s, 2) as score, weight, overall_score,
  case when overall_score >= 90 then 'A' when overall_score >= 80 then 'B' when overall_score >= 70 then 'C'
       when overall_score >= 60 then 'D' else 'F' end as grade from scores, total""")
def quality_score(spark, d):
    return quality.quality_score(gaps(spark, d), EXPECTED)


@query("""with hollow as (select case when o_orderstatus = 'P' then null else o_orderstatus end as state,
    case when o_orderpriority in ('1-URGENT', '2-HIGH') then null else o_orderpriority end as level from orders),
m as (select (100.0::double * sum((state is null)::int + (level is null)::int) / (2 * count(*))) as pct,
    avg((state is null)::int) * 100 as p1, avg((level is null)::int) * 100 as p2, count(*) - count(state) as m1, count(*) - count(level) as m2 from hollow),
u as (select greatest(0, 100 - 2 * round(sum(k - 1) * 100.0::double / sum(k), 2)) as s from (select count(*) as k from hollow group by state, level))
select (row_number() over (order by pos) - 1) as place, recommendation from (
  select 1 as pos, 'Impute or drop columns with high missing values: ' || case
     when p1 > 10 and p2 > 10 then 'state, level' when p1 > 10 then 'state' else 'level' end as recommendation
  from m where 100 - round(pct, 2) < 90 and (p1 > 10 or p2 > 10)
  union all select 2, 'Remove or investigate duplicate rows before training.' from u where s < 90)""")
def recommendations(spark, d):
    hollow = table(spark, d, "orders").select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("state"),
        F.when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).alias("level"),
    )
    return quality.recommendations(hollow)


@query(f"""with {GAPS_SQL}, m as (select {MISSING_SUM} as m, count(*) as n from gaps),
k as (select sum(k - 1)::bigint as k from (select count(*) as k from gaps group by {", ".join(TYPES)}))
select 'lineitem' as dataset, n as total_rows, 11::bigint as total_columns, 'failed' as schema_status, 1::bigint as missing_columns,
  1::bigint as type_mismatches, m as missing_cells, k as duplicate_rows, '' as errors from m, k""")
def validation_summary(spark, d):
    return validation.run_validation(gaps(spark, d), "lineitem", EXPECTED)["summary"]


@query(f"""with {GAPS_SQL},
o as (select * from ({" union all ".join("select * from (" + OUTLIER_SQL.format(c=c, t="gaps") + ")" for c in NUMERIC)}))
select 'schema' as stage, 'Missing expected columns: l_comment' as warning
union all select 'schema', '1 column(s) have type mismatches'
union all select 'missing', 'Columns with >30% missing values: l_returnflag' from gaps having (count(*) - count(l_returnflag)) * 100.0 / count(*) > 30
union all select 'duplicates', k || ' duplicate rows' from (select sum(k - 1)::bigint as k from (select count(*) as k from gaps group by {", ".join(TYPES)})) where k > 0
union all select 'dates', 'Column ''l_shipdate'': ' || (count(l_shipdate) - count(distinct l_shipdate)) || ' duplicate timestamp(s)' from gaps
union all select 'outliers', 'Column ''' || column_name || ''': ' || iqr_outliers || ' IQR outliers' from o where iqr_outliers > 0""")
def validation_warnings(spark, d):
    return validation.run_validation(gaps(spark, d), "lineitem", EXPECTED, now="2030-01-01 00:00:00")["warnings"]
