"""Splits, models and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import metrics, models
from plumbline.session import work_path

HASH_SQL = "('0x' || substr(md5({k} || '|42'), 1, 8))::bigint"


def rounded(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- splits

@query(f"select o_orderkey, case when {HASH_SQL.format(k='o_orderkey')} < floor(0.2 * 4294967296) then 'test' else 'train' end as side from orders")
def random_split(spark, d):
    train, test = models.train_test_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(f"""with h as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by {HASH_SQL.format(k='o_orderkey')}, o_orderkey) as place,
  count(*) over (partition by o_orderpriority) as n from orders)
select o_orderkey, o_orderpriority, case when place <= floor(n * 0.2::double + 0.5) then 'test' else 'train' end as side from h""")
def stratified_split(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    train, test = models.stratified_split(df, ["o_orderkey"], "o_orderpriority")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(f"""select o_orderkey, ((row_number() over (partition by o_orderstatus order by {HASH_SQL.format(k='o_orderkey')}, o_orderkey) - 1) % 5)::int as fold from orders""")
def stratified_folds(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return models.folds(df, ["o_orderkey"], 5, "o_orderstatus").drop("o_orderstatus")


# ---------------------------------------------------------------- classification metrics

@query("select quality::varchar as actual, toxic::varchar as predicted, count(*) as cnt from labels group by 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(table(spark, d, "labels"), "quality", "toxic")


BINARY_SQL = """with c as (select count(*) filter (where a = 1 and p = 1)::double as tp, count(*) filter (where a = 0 and p = 0)::double as tn,
  count(*) filter (where a = 0 and p = 1)::double as fp, count(*) filter (where a = 1 and p = 0)::double as fn, count(*)::double as n
  from (select quality as a, 1 - toxic as p from labels))
select round((tp + tn) / n, 6) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy, round(tp / (tp + fp), 6) as precision,
  round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1_score,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc,
  round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)), 6) as kappa,
  round(tn / (tn + fp), 6) as specificity, round(tp / (tp + fn), 6) as sensitivity from c"""


@query(BINARY_SQL)
def binary_metrics(spark, d):
    df = table(spark, d, "labels").select("quality", (1 - F.col("toxic")).alias("guess"))
    return rounded(metrics.classification_metrics(df, "quality", "guess"))


GUESS = "case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end"


@query(f"""with g as (select l_returnflag as a, {GUESS} as p from lineitem),
k as (select c, (select count(*) from g where a = c)::double as t, (select count(*) from g where p = c)::double as q,
  (select count(*) from g where a = c and p = c)::double as tp from (values ('A'), ('N'), ('R')) v(c)),
s as (select sum(t) as s, sum(tp) as c, sum(q * t) as pt, sum(q * q) as pp, sum(t * t) as tt, avg(tp / t) as bal,
  sum(tp / q * t) as wp, sum(tp) as wr, sum(2 * tp / (t + q) * t) as wf from k)
select round(c / s, 6) as accuracy, round(bal, 6) as balanced_accuracy, round(wp / s, 6) as precision, round(wr / s, 6) as recall, round(wf / s, 6) as f1_score,
  round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) as mcc, round((c / s - pt / (s * s)) / (1 - pt / (s * s)), 6) as kappa,
  null::double as specificity, null::double as sensitivity from s""")
def multiclass_metrics(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", F.expr(GUESS).alias("guess"))
    return rounded(metrics.classification_metrics(df, "l_returnflag", "guess"))


SCORED = "scored as (select quality as y, n_chars::double as s from labels join documents using (doc_id))"
POINTS = SCORED + """, c as (select s, sum(y)::double as pos, sum(1 - y)::double as neg from scored group by s),
pts as (select *, sum(pos) over (order by s desc) as tp, sum(neg) over (order by s desc) as fp, sum(pos) over () as p, sum(neg) over () as n from c)"""


def scored_labels(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query(f"with {POINTS} select s as threshold, round(tp / p, 9) as tpr, round(fp / n, 9) as fpr from pts")
def roc_points(spark, d):
    points = metrics.roc_points(scored_labels(spark, d), "quality", "n_chars")
    return points.select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"with {POINTS} select round(sum(neg * (tp - pos / 2)) / max(p * n), 9) as roc_auc, round(sum(pos / p * tp / (tp + fp)), 9) as pr_auc from pts")
def ranking_metrics(spark, d):
    return rounded(metrics.ranking_metrics(scored_labels(spark, d), "quality", "n_chars"), 9)


@query("""with r as (select l_returnflag as y, l_quantity as sa, l_discount as sn, l_tax as sr from lineitem),
longs as (select 'A' as k, (y = 'A')::int as h, sa as s from r union all select 'N', (y = 'N')::int, sn from r union all select 'R', (y = 'R')::int, sr from r),
c as (select k, s, sum(h)::double as pos, sum(1 - h)::double as neg from longs group by 1, 2),
pts as (select *, sum(pos) over (partition by k order by s desc) as tp, sum(pos) over (partition by k) as p, sum(neg) over (partition by k) as n from c),
auc as (select k, sum(neg * (tp - pos / 2)) / max(p * n) as a from pts group by k)
select round(avg(a), 9) as roc_auc from auc""")
def multiclass_auc(spark, d):
    df = table(spark, d, "lineitem")
    return rounded(metrics.roc_auc_one_vs_rest(df, "l_returnflag", {"A": "l_quantity", "N": "l_discount", "R": "l_tax"}), 9)


# ---------------------------------------------------------------- regression and clustering metrics

REGRESSION = """select {k} round(avg(e * e), 2) as mse, round(sqrt(avg(e * e)), 4) as rmse, round(avg(abs(e)), 4) as mae, round(1 - avg(e * e) / var_pop(y), 6) as r2,
  round(avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)), 6) as mape, round(median(abs(e)), 4) as median_ae, round(1 - var_pop(e) / var_pop(y), 6) as explained_variance
  from (select *, l_extendedprice as y, l_extendedprice - l_quantity * 1500 as e from lineitem)"""


def regression_rounded(df):
    digits = {"mse": 2, "rmse": 4, "mae": 4, "median_ae": 4}
    return df.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(REGRESSION.format(k=""))
def regression_metrics(spark, d):
    df = table(spark, d, "lineitem", heavy=True).select("l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return regression_rounded(metrics.regression_metrics(df, "l_extendedprice", "guess"))


@query(REGRESSION.format(k="l_returnflag,") + " group by l_returnflag")
def regression_metrics_by(spark, d):
    df = table(spark, d, "lineitem", heavy=True).select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return regression_rounded(metrics.regression_metrics(df, "l_extendedprice", "guess", ["l_returnflag"]))


@query("select l_orderkey, l_linenumber, l_extendedprice, l_quantity * 1500 as guess, l_extendedprice - l_quantity * 1500 as residual from lineitem")
def residuals(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return metrics.residuals(df, "l_extendedprice", "guess")


@query("""with parts as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
c as (select label, i, avg(x) as m, count(*) as n from parts group by 1, 2), g as (select i, avg(x) as m from parts group by 1),
dist as (select vec_id, label, sum((x - m) * (x - m)) as d2 from parts join c using (label, i) group by 1, 2),
s as (select label, avg(sqrt(d2)) as s, sum(d2) as w, count(*) as n from dist group by 1),
pair as (select a.label as a, b.label as b, sqrt(sum((a.m - b.m) * (a.m - b.m))) as dd from c a join c b on a.i = b.i and a.label <> b.label group by 1, 2),
worst as (select a, max((x.s + y.s) / dd) as r from pair join s x on x.label = a join s y on y.label = b group by 1),
b as (select sum(c.n * (c.m - g.m) * (c.m - g.m)) as b from c join g using (i)), w as (select sum(w) as w, sum(n) as n, count(*) as k from s)
select round((select avg(r) from worst), 6) as davies_bouldin, round((b / (k - 1)) / (w / (n - k)), 6) as calinski_harabasz from b, w""")
def cluster_scores(spark, d):
    return rounded(metrics.cluster_scores(table(spark, d, "embeddings"), "label", "embedding"))


# ---------------------------------------------------------------- models

def labelled(spark, d):
    """Text statistics of labelled documents."""
    t = F.col("text")
    docs = table(spark, d, "documents").select(
        "doc_id", F.log1p("n_chars").alias("size"), F.regexp_count(t, F.lit(r"\n")).alias("lines"),
        (F.regexp_count(t, F.lit(r"\d")) / F.greatest(F.length(t), F.lit(1))).alias("digit_share"),
        (F.regexp_count(t, F.lit(r"[^\w\s]")) / F.greatest(F.length(t), F.lit(1))).alias("mark_share"))
    return table(spark, d, "labels").join(docs, "doc_id")


FEATURES = ["size", "lines", "digit_share", "mark_share"]


@query()
def classifier_search(spark, d):
    board = models.search(labelled(spark, d), "classification", FEATURES, "quality", ["doc_id"], fold_count=3)
    return board.drop("seconds")


@query()
def regressor_search(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 1000).alias("code"))
    board = models.search(df, "regression", ["p_size", "code"], "p_retailprice", ["p_partkey"],
                          ["linear_regression", "lasso", "ridge", "decision_tree"], fold_count=3)
    return board.drop("seconds")


@query()
def cluster_search(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return models.search(df, "clustering", ["c_acctbal", "c_nationkey"], params={"kmeans": {"k": 4}}).drop("seconds")


@query()
def boosted_scores(spark, d):
    df = labelled(spark, d)
    train, test = models.stratified_split(df, ["doc_id"], "quality")
    model = models.train(train, "classification", "gradient_boosting", FEATURES, "quality", maxIter=5)
    return models.score(model, test).select("doc_id", "quality", "result", F.round("confidence", 6).alias("confidence"))


@query()
def network_scores(spark, d):
    df = labelled(spark, d)
    model = models.train(df, "classification", "neural_network", FEATURES, "quality", maxIter=20)
    return models.score(model, df).select("doc_id", "quality", "result", F.round("confidence", 4).alias("confidence"))


@query()
def forest_prediction_log(spark, d):
    """Scores appended to a log by day and model, and read back newest first."""
    df = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    model = models.train(df, "regression", "random_forest", ["p_size", "p_partkey"], "p_retailprice", numTrees=5)
    path = work_path(spark, "predictions")
    scored = models.score(model, df)
    models.write_log(models.prediction_log(scored, "price", "1", ["p_size", "p_partkey"], "2024-01-01 00:00:00"), path)
    return spark.read.parquet(path).where("model_name = 'price'").select("input_payload", "prediction_result", "model_version")


FIT_SQL = """fit as (select regr_slope(y, x) as w, regr_intercept(y, x) as b from (select p_size::double as x, p_retailprice as y from part where p_partkey % 7 <> 0))"""


@query(f"""with {FIT_SQL} select p_partkey, case when p_partkey % 7 <> 0 then round(b + w * p_size, 4) end as result,
  case when p_partkey % 7 = 0 then 'missing features: size' end as reason from part, fit""")
def score_with_gaps(spark, d):
    """Rows with a missing feature come back without a result, and are not trained on."""
    size = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double"))
    df = table(spark, d, "part").select("p_partkey", size.alias("size"), "p_retailprice")
    model = models.train(df, "regression", "linear_regression", ["size"], "p_retailprice", solver="normal")
    return models.score(model, df).select("p_partkey", F.round("result", 4).alias("result"), "reason")


@query("""with s as (select count(*)::double as n, avg(l_quantity) as mx, avg(l_extendedprice) as my, covar_pop(l_extendedprice, l_quantity) as c, var_pop(l_quantity) as v from lineitem),
w as (select 'linear_regression' as algorithm, c / v as w, mx, my from s
  union all select 'ridge', n * c / (n * v + 5000), mx, my from s
  union all select 'lasso', sign(c) * greatest(abs(c) - 1, 0) / v, mx, my from s)
select algorithm, round(w, 4) as slope, round(my - w * mx, 2) as intercept from w""")
def penalised_slopes(spark, d):
    """Least squares, plus alpha times the squared weight, or with a lasso penalty."""
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    rows = []
    for name, params in (("linear_regression", {"solver": "normal"}), ("ridge", {"alpha": 5000.0, "solver": "normal"}), ("lasso", {"maxIter": 500, "tol": 1e-12})):
        fitted = models.train(df, "regression", name, ["l_quantity"], "l_extendedprice", **params).stages[-1]
        rows.append((name, float(fitted.coefficients[0]), float(fitted.intercept)))
    out = spark.createDataFrame(rows, "algorithm string, slope double, intercept double")
    return out.select("algorithm", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("""with f as (select regr_slope(l_extendedprice, l_quantity) as w, regr_intercept(l_extendedprice, l_quantity) as b, avg(l_quantity) as m from lineitem)
select l_orderkey, l_linenumber, l_quantity, round(b + w * m, 2) as base_value, round(w * (l_quantity - m), 2) as l_quantity__contribution from lineitem, f""")
def linear_explanations(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = models.train(df, "regression", "linear_regression", ["l_quantity"], "l_extendedprice", solver="normal")
    out = models.explain_linear(model, df, df.drop("l_extendedprice"))
    return out.withColumns({c: F.round(c, 2) for c in ("base_value", "l_quantity__contribution")})
