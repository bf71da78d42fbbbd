import math
import random

import pytest

from plumbline.operators import metrics, models, tables

TRUE, PRED, PROB = [0, 1, 0, 1, 0, 0, 1, 1], [0, 1, 0, 0, 0, 1, 1, 1], [0.1, 0.9, 0.2, 0.4, 0.3, 0.6, 0.8, 0.9]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(list(zip(TRUE, PRED, PROB)), "y int, p int, s double")


def test_binary_metrics(scored):
    row = metrics.classification_metrics(scored, "y", "p").first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (0.75, 0.75, 0.75, 0.75)
    assert (row.balanced_accuracy, row.mcc, row.kappa, row.specificity, row.sensitivity) == (0.75, 0.5, 0.5, 0.75, 0.75)


def test_ranking_metrics_against_all_pairs(spark, scored):
    def by_pairs(pairs):
        pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))

    assert metrics.ranking_metrics(scored, "y", "s").first().roc_auc == pytest.approx(by_pairs(list(zip(TRUE, PROB))))
    rng = random.Random(4)
    pairs = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(500)]
    df = spark.createDataFrame(pairs, "y int, s double").repartition(5)
    row = metrics.ranking_metrics(df, "y", "s").first()
    assert row.roc_auc == pytest.approx(by_pairs(pairs))
    total = sum(y for y, _ in pairs)
    precision, last = 0.0, 0
    for cut in sorted({s for _, s in pairs}, reverse=True):
        taken = [y for y, s in pairs if s >= cut]
        precision += (sum(taken) - last) / total * sum(taken) / len(taken)
        last = sum(taken)
    assert row.pr_auc == pytest.approx(precision)


def test_degenerate_classes(spark):
    row = metrics.classification_metrics(spark.createDataFrame([("a", "a")] * 3, "y string, p string"), "y", "p").first()
    assert row.accuracy == 1.0 and row.mcc == 0.0 and row.kappa is None and row.specificity is None
    none_found = metrics.classification_metrics(spark.createDataFrame([(1, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert (none_found.precision, none_found.recall, none_found.f1_score, none_found.mcc) == (0.0, 0.0, 0.0, 0.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-0.5, 0.0), (2.0, 2.0), (7.0, 8.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert row.mse == pytest.approx(0.375) and row.mae == pytest.approx(0.5) and row.median_ae == pytest.approx(0.5)
    assert row.r2 == pytest.approx(0.9486081) and row.explained_variance == pytest.approx(0.95717344)
    zero = metrics.regression_metrics(spark.createDataFrame([(0.0, 1.0), (0.0, 1.0)], df.schema), "y", "p").first()
    assert zero.mape > 1e15 and zero.r2 == 0.0


def test_cluster_scores(spark, monkeypatch):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [0.0, 2.0]), (1, [10.0, 0.0]), (1, [10.0, 2.0])], "k int, v array<double>")
    row = metrics.cluster_scores(df, "k", "v").first()
    assert row.davies_bouldin == pytest.approx(0.2) and row.calinski_harabasz == pytest.approx(50.0)
    one = metrics.cluster_scores(df.where("k = 0"), "k", "v").first()
    assert tuple(one) == (0.0, 0.0)
    monkeypatch.setattr(metrics, "CLUSTER_BLOCK", 1)
    assert metrics.cluster_scores(df, "k", "v").first().davies_bouldin == pytest.approx(0.2)
    same = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], "k int, v array<double>")
    assert tuple(metrics.cluster_scores(same, "k", "v").first()) == (0.0, 1.0)


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(900)], "id int, c string")
    sides = []
    for parts in (1, 7):
        train, test = models.stratified_split(df.repartition(parts), ["id"], "c")
        assert {r.c: r["count"] for r in test.groupBy("c").count().collect()} == {"big": 120, "small": 60}
        assert train.count() == 720
        sides.append({r.id for r in test.collect()})
    assert sides[0] == sides[1]
    counts = [r["count"] for r in models.folds(df, ["id"], 5, "c").groupBy("fold").count().collect()]
    assert counts == [180] * 5


def test_training_and_scoring(spark):
    rng = random.Random(2)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame([(i, a, b, "yes" if a + b > 0 else "no", 3 * a - b + 1) for i, a, b in data], "id int, a double, b double, y string, t double")
    model = models.train(df, "classification", "logistic_regression", ["a", "b"], "y")
    out = models.score(model, df.drop("y")).collect()
    assert {r.result for r in out} == {"yes", "no"} and all(0.5 <= r.confidence <= 1 for r in out)
    assert sum(r.result == ("yes" if r.a + r.b > 0 else "no") for r in out) > 190
    linear = models.train(df, "regression", "linear_regression", ["a", "b"], "t")
    explained = models.explain_linear(linear, df, df).first()
    total = explained.base_value + explained["a__contribution"] + explained["b__contribution"]
    assert total == pytest.approx(explained.t, abs=1e-6)
    with pytest.raises(ValueError):
        models.create("regression", "nope")
    models.register_algorithm("regression", "stub", lambda **p: models.LinearRegression(**p))
    assert models.create("regression", " Stub ")
    board = models.search(df, "regression", ["a", "b"], "t", ["id"], ["linear_regression", "nope", "lasso"], 2)
    assert [(r.algorithm, r["rank"]) for r in board.orderBy("rank").collect()] == [("linear_regression", 1), ("lasso", 2)]


def test_leaderboard_directions(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, None), ("c", 0.5, 0.9)], "algorithm string, rmse double, f1_score double")
    def order(**kw):
        return [r.algorithm for r in tables.leaderboard(df, **kw).orderBy("rank").collect()]
    assert order(metric="rmse") == ["c", "a", "b"] and order() == ["c", "a", "b"] and order(metric="absent") == ["a", "b", "c"]


def test_nan_free_auc_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert metrics.ranking_metrics(df, "y", "s").first().roc_auc is None
    assert math.isclose(metrics.ranking_metrics(df, "y", "s").first().pr_auc, 1.0)
