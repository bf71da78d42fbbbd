import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.operators import encode, generate, impute, scale, select, transform
from plumbline.plans import preprocessing


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "z")], "a double, b string")


def test_constant_imputation_leaves_no_nulls(ab):
    out = impute.fit_imputer(ab, "constant").transform(ab).collect()
    assert [(r.a, r.b) for r in out] == [(1.0, "x"), (0.0, "0"), (3.0, "z")]


def test_drop_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert impute.fit_imputer(df, "drop_rows").transform(df).count() == 2


def test_mean_falls_back_to_the_mode_for_text(ab):
    fit = impute.fit_imputer(ab, "mean")
    assert fit.fills == {"a": 2.0, "b": "x"}


def test_empty_text_column_is_filled_with_unknown(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "s string, n int")
    assert impute.fit_imputer(df, "mode").transform(df).first().s == "unknown"


def test_drop_columns_threshold(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, None, 2), (3, 3, 3)], "a int, b int, c int")
    assert impute.fit_imputer(df, "drop_columns").dropped_columns == ["a", "b"]
    assert impute.fit_imputer(df, "drop_columns", threshold_strict=True).dropped_columns == ["a"]
    auto = impute.fit_imputer(df, "auto")
    assert auto.dropped_columns == ["a"] and auto.fills == {"b": 2.0}


def test_ordered_fill_needs_an_order(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "o int, v int")
    fit = impute.fit_imputer(df, "ffill")
    with pytest.raises(ValueError):
        fit.transform(df)
    assert [r.v for r in fit.transform(df, ["o"]).orderBy("o").collect()] == [1, 1]


def test_one_hot_names_nulls_and_drop_first(spark):
    df = spark.createDataFrame([("b", True), ("a", None), (None, False)], "c string, f boolean")
    out = encode.fit_encoder(df, "onehot").transform(df)
    assert out.columns == ["c_a", "c_b", "f_False", "f_True"]
    assert [tuple(r) for r in out.collect()] == [(0, 1, 0, 1), (1, 0, 0, 0), (0, 0, 1, 0)]
    assert encode.fit_encoder(df, "onehot", drop_first=True).transform(df).columns == ["c_b", "f_True"]


def test_label_ordinal_and_frequency(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert [r.c for r in encode.fit_encoder(df, "label").transform(df).collect()] == [1, 0, 2, 1]
    shares = [r.c for r in encode.fit_encoder(df, "frequency").transform(df).collect()]
    assert shares == pytest.approx([2 / 3, 1 / 3, 0.0, 2 / 3])
    with pytest.raises(ValueError):
        encode.fit_encoder(df, "ordinal")
    fit = encode.fit_encoder(df.dropna(), "ordinal")
    unseen = spark.createDataFrame([("a",), ("q",)], "c string")
    assert [r.c for r in fit.transform(unseen).collect()] == [0, -1]


def test_large_code_tables_are_written(spark, monkeypatch):
    monkeypatch.setattr(encode, "LITERAL_ROWS", 20)
    words = [f"w{i:03d}" for i in range(100)]
    df = spark.createDataFrame([(w,) for w in reversed(words)], "c string")
    out = encode.fit_encoder(df, "label").transform(df.withColumn("o", df.c)).collect()
    assert len(out) == 100 and all(words.index(r.o) == r.c for r in out)


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (6.0, 7.0)], "x double, k double")
    standard = [r.x for r in scale.fit_scaler(df, "standard").transform(df).collect()]
    assert sum(standard) == pytest.approx(0) and sum(v * v for v in standard) / 3 == pytest.approx(1)
    ranged = scale.fit_scaler(df, "minmax").transform(df).collect()
    assert [r.x for r in ranged] == [0.0, 0.2, 1.0] and {r.k for r in ranged} == {0.0}
    robust = [r.x for r in scale.fit_scaler(df).transform(df).collect()]
    assert robust == pytest.approx([-0.4, 0.0, 1.6])
    unit = scale.fit_scaler(df, "normalizer").transform(df).first()
    assert unit.x**2 + unit.k**2 == pytest.approx(1)
    with pytest.raises(ValueError):
        scale.fit_scaler(spark.createDataFrame([(None, 1.0)], "x double, k double"), "normalizer")


def test_log_needs_positive_and_complete_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (2.0, 1.0, 2.0), (3.0, 2.0, 3.0)], "p double, z double, n double")
    assert transform.fit_transformer(df, apply_log=True).methods == {"p": "log1p"}
    assert transform.fit_transformer(df, apply_log=True, apply_sqrt=True).methods == {"p": "log1p"}
    assert transform.fit_transformer(df, apply_sqrt=True).methods == {"p": "sqrt", "z": "sqrt"}


def likelihood(values, power):
    def one(x):
        if x >= 0:
            return math.log1p(x) if abs(power) < 1e-12 else ((x + 1) ** power - 1) / power
        rest = 2 - power
        return -math.log1p(-x) if abs(rest) < 1e-12 else -((1 - x) ** rest - 1) / rest

    ys = [one(x) for x in values]
    mean = sum(ys) / len(ys)
    spread = sum((y - mean) ** 2 for y in ys) / len(ys)
    return -len(ys) / 2 * math.log(spread) + (power - 1) * sum(math.copysign(math.log1p(abs(x)), x) for x in values)


@pytest.mark.parametrize("draw", [lambda r: r.expovariate(0.1), lambda r: -r.expovariate(1), lambda r: r.gauss(0, 3), lambda r: r.random() ** 9 * 5])
def test_fitted_exponent_is_the_best_one(spark, draw):
    rng = random.Random(11)
    values = [draw(rng) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    power = transform.fit_powers(df, ["x"])["x"]
    best = likelihood(values, power)
    assert all(best >= likelihood(values, power + d) - 1e-6 for d in (-1, -0.1, -1e-3, 1e-3, 0.1, 1))


def test_transformer_reduces_skew(spark, small):
    df = spark.read.parquet(f"{small}/events.parquet").select("value")
    fit = transform.fit_transformer(df)
    assert fit.methods == {"value": "yeo_johnson"}
    from plumbline.operators.validate import numeric_statistics

    assert abs(numeric_statistics(fit.transform(df)).first().skewness) < abs(numeric_statistics(df).first().skewness) / 4


def test_polynomial_names(spark):
    df = spark.createDataFrame([(2.0, 3.0, None)], "a double, b double, c double")
    out = generate.polynomial_terms(df, 3)
    assert out.columns[3:] == ["a^2", "a b", "a c", "b^2", "b c", "c^2", "a^3", "a^2 b", "a^2 c", "a b^2", "a b c", "a c^2", "b^3", "b^2 c", "b c^2", "c^3"]
    assert out.first()["a^2 b"] == 12.0 and out.first()["a c"] == 0.0
    assert generate.polynomial_terms(df, 3, True).columns[3:] == ["a b", "a c", "b c", "a b c"]


def test_constant_column_is_dropped_and_useful_kept(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(10)], "constant double, useful double")
    assert select.fit_selection(df, "variance").transform(df).columns == ["useful"]


def test_correlation_drops_later_columns_pairwise_complete(spark):
    data = [(float(i), float(-2 * i) if i % 3 else None, float((i * 7) % 11), "t") for i in range(40)]
    df = spark.createDataFrame(data, "a double, b double, c double, y string")
    fit = select.fit_selection(df, "auto", target="y")
    assert fit.dropped == ["b"] and fit.transform(df).columns == ["a", "c", "y"]


def test_kbest_keeps_other_columns_and_target_last(spark):
    data = [("k" if i % 2 else "l", float(i % 2) + i / 100, float(i % 5), "s", float(i)) for i in range(40)]
    df = spark.createDataFrame(data, "y string, good double, noise double, text string, more double")
    fit = select.fit_selection(df, "kbest", "y", k_best=1)
    assert fit.transform(df).columns == ["good", "text", "y"]
    assert select.fit_selection(df, "mutual_info", "y", k_best=1).transform(df).columns[-1] == "y"


def test_preprocessing_isolates_failures_and_applies_to_new_rows(spark, small):
    df = spark.read.parquet(f"{small}/customer.parquet").drop("c_name")
    settings = preprocessing.Settings(target="c_mktsegment", missing={"strategy": "nonsense"}, scaling={"strategy": "standard"})
    fit = preprocessing.fit_preprocessing(df, settings)
    assert [e.split(":")[0] for e in fit.errors] == ["missing"]
    assert fit.output_columns[-1] == "c_mktsegment"
    assert fit.transform(df.limit(3)).columns == fit.output_columns
    report = {r.step: r.state for r in fit.report(spark).collect()}
    assert report["missing"] == "failed" and report["scaling"] == "ok"


def test_preprocessing_failures_are_no_results(spark, small, monkeypatch):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, y string")
    fit = preprocessing.fit_preprocessing(df, preprocessing.Settings(target="y", scaling={"strategy": "nonsense"}))
    with pytest.raises(RuntimeError, match="scaling"):
        fit.whole()

    def lost(x, **options):
        return x.select(F.raise_error(F.lit("task lost")).cast("double")).collect()

    def refused(x, **options):
        raise ValueError("refused")

    monkeypatch.setattr(preprocessing, "fit_scaler", lost)
    with pytest.raises(Exception, match="task lost"):
        preprocessing.fit_preprocessing(df, preprocessing.Settings(target="y"))
    monkeypatch.setattr(preprocessing, "fit_scaler", refused)
    catalog.load()
    for name in ("preprocess_report", "preprocess_run"):
        with pytest.raises(RuntimeError, match="scaling: refused"):
            catalog.QUERIES[name](spark, small)
