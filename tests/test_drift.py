import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame

from plumbline.operators import drift
from plumbline.plans import monitoring


def frame(spark, values, name="x"):
    return spark.createDataFrame([(name, float(v)) for v in values], "feature string, value double")


@pytest.fixture(scope="module")
def normal():
    rng = np.random.default_rng(42)
    return lambda mean, std, n=1000: rng.normal(mean, std, n)


def psi_by_hand(a, b):
    edges = np.linspace(a.min(), a.max(), 11)
    shares = []
    for side in (a, b):
        counts = np.histogram(side, edges)[0].astype(float)
        counts[counts == 0] = 0.0001
        shares.append(counts / counts.sum())
    return float(((shares[1] - shares[0]) * np.log(shares[1] / shares[0])).sum())


def test_psi(spark, normal):
    base, moved = normal(50, 10), normal(60, 10)
    same = drift.psi_scores(drift.histograms(frame(spark, base), frame(spark, base))).first().psi
    shifted = drift.psi_scores(drift.histograms(frame(spark, base), frame(spark, moved))).first().psi
    assert same < 0.05 and shifted > 0.2
    assert shifted == pytest.approx(psi_by_hand(base, moved))


def test_histogram_edges_are_numpy_edges(spark):
    base = np.array([0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.7, 0.9, 1.0])
    bins = drift.histograms(frame(spark, base), frame(spark, [-1.0, 0.3, 1.0, 2.0])).orderBy("bin").collect()
    edges = np.linspace(0, 1, 11)
    assert [r.base for r in bins] == list(np.histogram(base, edges)[0])
    assert [r.cur for r in bins] == list(np.histogram([-1.0, 0.3, 1.0, 2.0], edges)[0])


def test_js_of_disjoint_samples(spark):
    bins = drift.histograms(frame(spark, [0, 1, 2, 3, 10]), frame(spark, [6, 7, 8]))
    assert drift.js_distances(bins).first().js_distance == pytest.approx(math.sqrt(math.log(2)))


def test_ks_against_brute_force(spark, normal):
    a, b = normal(0, 1, 400).round(1), normal(0.4, 1, 300).round(1)
    got = drift.ks_tests(frame(spark, a), frame(spark, b)).first()
    points = np.unique(np.concatenate([a, b]))
    gap = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    t = gap * math.sqrt(400 * 300 / 700)
    p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * t * t) for j in range(1, 101))
    assert got.ks_statistic == pytest.approx(gap) and got.ks_p_value == pytest.approx(p, abs=1e-12)
    assert drift.ks_tests(frame(spark, normal(0, 1)), frame(spark, normal(1, 1))).first().ks_drift
    same = drift.ks_tests(frame(spark, a), frame(spark, a)).first()
    assert (same.ks_statistic, same.ks_p_value, same.ks_drift) == (0.0, 1.0, False)


def test_chi_square(spark):
    def side(**counts):
        return spark.createDataFrame([("c", k) for k, n in counts.items() for _ in range(n)], "feature string, value string")

    row = drift.chi_square_tests(side(A=500, B=500), side(A=800, B=200)).first()
    assert row.chi2_statistic == pytest.approx(360) and row.chi2_drift and not row.sums_differ
    close = drift.chi_square_tests(side(A=500, B=300, C=200), side(A=51, B=29, C=20)).first()
    assert close.chi2_p_value == pytest.approx(math.exp(-close.chi2_statistic / 2))
    assert drift.chi_square_tests(side(A=5), side(A=3, B=2)).first().sums_differ


def test_chi_square_tail_values():
    # Upper 5% points of the chi-square distribution, from printed tables.
    for degrees, point in {1: 3.841, 2: 5.991, 5: 11.070, 10: 18.307, 30: 43.773, 100: 124.342}.items():
        assert drift._upper_gamma(degrees / 2, point / 2) == pytest.approx(0.05, abs=2e-5)


def test_report_over_several_features(spark, normal):
    base = spark.createDataFrame([(float(x), float(y), "A") for x, y in zip(normal(100, 15), normal(0, 1))], "x double, y double, c string")
    cur = spark.createDataFrame([(float(x), float(y), "B") for x, y in zip(normal(120, 15), normal(0, 1))], "x double, y double, c string")
    report = monitoring.drift_report(base, cur, ["x", "y"], ["c"])
    rows = {r.feature: r for r in report.collect()}
    assert rows["x"].has_drift and rows["x"].psi > 0.2 and not rows["y"].has_drift
    overall = monitoring.overall_drift(report).first()
    assert overall.features == 3 and overall.has_data_drift == (overall.overall_drift_score >= 0.3)
    event = monitoring.drift_events(monitoring.overall_drift(report), "m1", "r1").first()
    assert event.event_type == "HIGH_DRIFT_DETECTED" and '"model_version_id":"m1"' in event.payload


def test_snapshot_gives_the_same_scores(spark, normal):
    base, cur = normal(50, 10), normal(55, 10)
    wide = spark.createDataFrame([(float(v),) for v in base], "x double")
    now = spark.createDataFrame([(float(v),) for v in cur], "x double")
    stored = monitoring.baseline_snapshot(wide, ["x"])
    assert stored.first().sample_size == 1000
    direct = drift.psi_scores(drift.histograms(frame(spark, base), frame(spark, cur))).first().psi
    assert monitoring.drift_against_snapshot(stored, now, ["x"]).first().psi == pytest.approx(direct)


def test_merged_baselines_equal_one_over_all_rows(spark, normal):
    rng = np.random.default_rng(3)
    days = [rng.normal(50, 10, 4000), rng.normal(70, 5, 9000), np.array([]), rng.integers(0, 5, 3000).astype(float)]
    frames = [spark.createDataFrame([(float(x), None) for x in day], "x double, y double") for day in days]
    parts = reduce(DataFrame.unionByName, [monitoring.baseline_sketch(f, ["x", "y"]) for f in frames])
    merged, whole = monitoring.merge_baselines(parts), np.concatenate(days)
    [got] = merged.collect()
    assert (got.sample_size, got.low, got.high) == (len(whole), whole.min(), whole.max())
    assert got.mean == pytest.approx(whole.mean()) and got.deviations == pytest.approx(whole.var() * len(whole))

    for shift in (0.0, 3.0):
        now = np.concatenate([rng.choice(whole, 6000) + shift, np.full(3000, 60.0) if shift else []])
        frame = spark.createDataFrame([(float(x),) for x in now], "x double")
        [test] = monitoring.drift_against_sketch(merged, frame, ["x"]).collect()
        points = np.unique(np.r_[whole, now])
        exact = np.abs(np.searchsorted(np.sort(whole), points, "right") / len(whole) - np.searchsorted(np.sort(now), points, "right") / len(now)).max()
        assert abs(test.ks_statistic - exact) <= test.ks_error == pytest.approx(monitoring.sketch_error())
        assert test.has_drift == (shift > 0)


def test_category_snapshots_merge_and_test_like_the_rows(spark):
    one = spark.createDataFrame([("a", "u")] * 300 + [("b", None)] * 200 + [(None, "v")], "k string, g string")
    two = spark.createDataFrame([("a", "v")] * 200 + [("c", "u")] * 300, "k string, g string")
    now = spark.createDataFrame([("a", "u")] * 800 + [("d", "v")] * 200, "k string, g string")
    parts = [monitoring.category_snapshot(f, ["k", "g"]) for f in (one, two)]
    merged = monitoring.merge_category_snapshots(parts[0].unionByName(parts[1]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, monitoring.category_snapshot(one.unionByName(two), ["k", "g"]).collect()))
    got = {r.feature: r for r in monitoring.category_drift_against_snapshot(merged, now, ["k", "g"]).collect()}
    direct = drift.category_verdicts(drift.category_rows(one.unionByName(two), ["k", "g"]), drift.category_rows(now, ["k", "g"]))
    for want in direct.collect():
        assert got[want.feature].chi2_statistic == pytest.approx(want.chi2_statistic) and got[want.feature].has_drift == want.has_drift
    assert set(got) == {"k", "g"}
    assert [r.feature for r in monitoring.category_drift_against_snapshot(merged, now, ["g"]).collect()] == ["g"]
    assert monitoring.category_drift_against_snapshot(merged.limit(0), now.limit(0), ["k"]).count() == 0
