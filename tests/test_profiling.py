import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, quality, validate
from plumbline.operators.ordered import exact_quantiles
from plumbline.plans.validation import run_validation


def rows(df, key="column_name"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    data = [
        (25, 50000.0, "A", "2024-01-01", True),
        (30, float("nan"), "B", "2024-01-02", False),
        (30, 60000.0, None, "2024-01-02", None),
        (None, 80000.0, "A", None, True),
        (25, 50000.0, "A", "2024-01-01", True),
    ]
    return spark.createDataFrame(data, "age int, income double, grade string, day string, flag boolean")


def test_schema_report_counts_nan_as_missing(people):
    found = rows(profile.schema_report(people))
    assert found["income"]["null_count"] == 1 and found["income"]["unique_count"] == 3
    assert found["age"]["null_pct"] == 20.0
    assert found["flag"]["unique_count"] == 2


def test_approximate_distinct_counts_agree_on_small_data(people):
    exact, approx = rows(profile.schema_report(people)), rows(profile.schema_report(people, approx=True))
    assert {c: r["unique_count"] for c, r in exact.items()} == {c: r["unique_count"] for c, r in approx.items()}


def test_table_summary(people):
    row = profile.table_summary(people).first()
    assert (row.total_rows, row.total_columns, row.total_cells) == (5, 5, 25)
    assert (row.missing_cells, row.missing_pct) == (5, 20.0)
    assert (row.duplicate_rows, row.duplicate_pct) == (1, 20.0)


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, None)], "a int, b string")
    assert profile.duplicate_summary(df).first().duplicate_rows == 2


def test_duplicate_rows_keep_the_first_by_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "a")], "id int, v string")
    assert sorted(r.id for r in validate.duplicate_rows(df, ["id"], ["id"]).collect()) == [3, 5]


def test_identical_columns_need_the_same_type(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (2, 2, 2.0, None)], "a int, b int, c double, d string")
    assert [tuple(r) for r in validate.identical_columns(df).collect()] == [("a", "b")]


def test_missing_report_suggestions_and_rank(spark):
    df = spark.createDataFrame(
        [(None, None, None, 1), (None, "x", None, 2), (3, "y", None, 3)], "n int, s string, t timestamp, k int"
    )
    found = rows(validate.missing_report(df))
    assert found["n"]["suggestion"] == "consider_dropping_column" and found["n"]["missing_pct"] == 66.67
    assert found["s"]["suggestion"] == "mode_or_constant_imputation"
    assert found["k"]["suggestion"] == "none" and found["k"]["rank"] is None
    assert [found[c]["rank"] for c in ("t", "n", "s")] == [1, 2, 3]


def test_numeric_statistics_match_the_formulas(spark):
    values = [2.0, 4.0, 4.0, 5.0, 7.0, 30.0]
    row = validate.numeric_statistics(spark.createDataFrame([(v,) for v in values], "x double")).first()
    n, mean = len(values), sum(values) / len(values)
    m2, m3, m4 = (sum((v - mean) ** k for v in values) / n for k in (2, 3, 4))
    assert row["mode"] == 4.0 and row["median"] == 4.5 and row["q1"] == 4.0 and row["q3"] == 6.5
    assert row["skewness"] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5, abs=1e-6)
    g2 = m4 / m2**2 - 3
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), abs=1e-6)


def test_constant_column_has_no_skew(spark):
    row = validate.numeric_statistics(spark.createDataFrame([(5.0,)] * 4, "x double")).first()
    assert (row["skewness"], row["kurtosis"], row["std"]) == (0.0, 0.0, 0.0)


def test_categorical_report(spark):
    data = [("a",)] * 150 + [("b",)] * 49 + [("c",)]
    df = spark.createDataFrame(data, "v string")
    row = validate.categorical_report(df).first()
    assert (row.unique_count, row.cardinality_ratio, row.rare_count, row.all_unique) == (3, 0.015, 1, False)
    assert [tuple(r) for r in validate.rare_values(df).collect()] == [("v", 1, "c", 1)]


def test_dtype_report_kinds(spark):
    data = [(str(i), f"2024-01-{i % 28 + 1:02d}", str(i) if i % 2 else "x", "lo" if i % 2 else "hi") for i in range(100)]
    found = rows(validate.dtype_report(spark.createDataFrame(data, "n string, d string, m string, c string")))
    assert found["n"]["suggestion"] == "convert_to_numeric"
    assert found["d"]["suggestion"] == "convert_to_datetime"
    assert found["m"]["category"] == "mixed" and found["m"]["suggestion"] is None
    assert found["c"]["suggestion"] == "convert_to_category"


def test_schema_check_states(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "a long, b string, extra double")
    found = rows(validate.schema_check(df, {"a": "int64", "b": "float64", "c": "object"}))
    assert {c: r["state"] for c, r in found.items()} == {"a": "ok", "b": "type_mismatch", "c": "missing", "extra": "unexpected"}
    assert validate.schema_issues(df, {"a": "int"})["status"] == "passed"
    assert validate.schema_issues(df, {"a": "float"})["status"] == "failed"


def test_date_columns_and_report(spark):
    data = [("2024-01-01", "x", datetime.datetime(2024, 1, 1)), ("2024-13-01", "y", datetime.datetime(2030, 1, 1)), ("2024-01-01", None, None)]
    df = spark.createDataFrame(data, "d string, s string, t timestamp_ntz")
    assert validate.date_columns(df, min_share=0.6) == ["t", "d"]
    found = rows(validate.date_report(df, "2025-01-01", ["d", "t"]))
    assert (found["d"]["valid_count"], found["d"]["invalid_count"], found["d"]["duplicate_timestamps"]) == (2, 1, 1)
    assert found["t"]["future_dates"] == 1


def test_outliers_need_ten_values(spark):
    df = spark.createDataFrame([(float(i), float(i)) if i < 9 else (float(i), None) for i in range(12)] + [(500.0, None)], "a double, b double")
    found = rows(validate.outlier_report(df))
    assert set(found) == {"a"} and found["a"]["iqr_outliers"] == 1 and found["a"]["z_outliers"] == 1


def test_quality_score_of_clean_and_bad_data(spark):
    clean = spark.createDataFrame([(float(i), f"v{i}") for i in range(50)], "a double, b string")
    row = quality.quality_score(clean).first()
    assert row.overall_score == pytest.approx(99.25) and row.grade == "A"
    bad = spark.createDataFrame([(None, "v")] * 50, "a double, b string")
    scores = {r.dimension: r.score for r in quality.quality_score(bad, {"a": "string", "z": "int"}).collect()}
    assert scores == {"completeness": 50.0, "validity": 65.0, "uniqueness": 0.0, "consistency": 100.0, "accuracy": 85.0}
    advice = [r.recommendation for r in quality.recommendations(bad, {"a": "string", "z": "int"}).orderBy("place").collect()]
    assert advice[0].endswith(": a") and "duplicate" in advice[1] and advice[2].endswith(": a")
    assert [r.recommendation for r in quality.recommendations(clean).collect()] == [quality.GOOD]


def test_validation_run_survives_tables_without_some_kinds(spark):
    reports = run_validation(spark.createDataFrame([("a",), ("b",)], "s string"), "letters")
    assert reports["summary"].first().errors == ""
    assert reports["numeric"].count() == 0 and reports["outliers"].count() == 0 and reports["dates"].count() == 0
    assert {r.warning for r in reports["warnings"].collect()} >= {"Column 's': 100% unique values"}


def test_rows_a_microsecond_apart_are_no_duplicates(spark):
    rows = spark.sql(
        "select * from values (1, timestamp'2024-01-01 00:00:00.000001', 0.0D, 'a', cast(null as string)),"
        " (2, timestamp'2024-01-01 00:00:00.000002', 0.0D, 'a', null), (3, timestamp'2024-01-01 00:00:00.000001', -0.0D, 'a', null),"
        " (4, timestamp'2024-01-01 00:00:00.000001', 0.0D, null, 'a'), (5, timestamp'2024-01-01 00:00:00.000001', 0.0D, 'a', '') as t(id, ts, x, s, u)"
    )
    found = validate.duplicate_rows(rows, ["id"], ["id"])
    assert [r.id for r in found.collect()] == [3]
    assert profile.duplicate_summary(rows.drop("id")).first().duplicate_rows == 1


def test_warnings_compute_no_modes(spark):
    data = [(float(i % 5), 1000.0 if i == 0 else 1.0, i % 2) for i in range(40)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(data, "a double, b double, c int")
    whole = {r["column_name"]: r["skewness"] for r in validate.numeric_statistics(df).collect()}
    assert {r["column_name"]: r["skewness"] for r in validate.skewness_report(df).collect()} == whole
    warnings = run_validation(df)["warnings"]
    assert "min_by" not in warnings._jdf.queryExecution().optimizedPlan().toString()
    assert "Column 'b': highly skewed" in [r["warning"] for r in warnings.collect()]


def test_only_columns_of_many_values_are_bracketed(spark, monkeypatch):
    """Flags and codes have their quantiles from counts; no row of theirs goes through sketch and brackets."""
    df = spark.range(30_000).select(
        F.col("id").alias("many"), (F.col("id") % 7).cast("int").alias("code"), F.when(F.col("id") % 3 > 0, F.lit(0.0)).alias("few"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 3).alias("c0"), F.lit(None).cast("double").alias("none"),
    )
    bracketed = []

    def watched(rows, *options):
        bracketed.append(rows)
        return exact_quantiles(rows, *options)

    monkeypatch.setattr(profile, "exact_quantiles", watched)
    shares = {"a": 0.1, "b": 0.5, "c": 0.87}
    got = {r.column_name: [r.a, r.b, r.c] for r in profile.quantile_columns(df, df.columns, shares).collect()}
    ids = np.arange(30_000)
    want = {"many": ids, "code": ids % 7, "few": np.zeros(20_000), "c0": ids[1::2] / 3}
    assert set(got) == set(want)
    for name, values in want.items():
        assert got[name] == pytest.approx(list(np.quantile(values, list(shares.values()))))
    assert {r.column_name for r in bracketed[0].select("column_name").distinct().collect()} == {"many", "c0"}
