"""Ordered building blocks against brute force, on any partitioning."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.joins import lookup_join
from plumbline.operators.ordered import carry_forward, dense_index, exact_quantiles, in_ranges, quantiles_of_counts, range_count, running_totals

LIGHT = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@LIGHT
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_quantiles_are_numpy_quantiles(spark, values, shares):
    df = spark.createDataFrame([("k", float(v)) for v in values], "key string, value double")
    got = exact_quantiles(df, ["key"], shares).first().quantiles
    assert got == pytest.approx(list(np.quantile(values, shares)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("accuracy", [100, 20_000])
def test_quantiles_with_ties_and_a_coarse_sketch(spark, accuracy):
    rng = random.Random(5)
    values = [rng.choice([0.0, 0.0, 0.0, 1.0, rng.gauss(0, 50)]) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "key int, value double").repartition(7)
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for row in exact_quantiles(df, ["key"], shares, accuracy=accuracy).collect():
        assert row.quantiles == pytest.approx(list(np.quantile(values[row.key::2], shares)))
    whole = exact_quantiles(df, [], shares, accuracy=accuracy).first()
    assert whole.n == 20_000 and whole.quantiles == pytest.approx(list(np.quantile(values, shares)))


def test_quantiles_of_counts_are_those_of_the_rows(spark):
    rng = random.Random(8)
    values = [rng.choice([0.0, -0.0, 0.0, 1.0, None, rng.randint(-9, 9) / 4]) for _ in range(3_000)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(7, None), (8, 2.5)], "key int, value double").repartition(7)
    shares = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    got = {r.key: (r.n, r.quantiles) for r in quantiles_of_counts(df, ["key"], shares).collect()}
    assert got == {r.key: (r.n, r.quantiles) for r in exact_quantiles(df, ["key"], shares).collect()}
    assert set(got) == {0, 1, 8} and got[8] == (1, [2.5] * 6)
    for key in (0, 1):
        known = [v for v in values[key::2] if v is not None]
        assert got[key][0] == len(known) and got[key][1] == pytest.approx(list(np.quantile(known, shares)))
    whole = [v for v in values if v is not None] + [2.5]
    assert quantiles_of_counts(df, [], shares).first().quantiles == pytest.approx(list(np.quantile(whole, shares)))
    assert quantiles_of_counts(df.limit(0), [], shares).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 16])
def test_running_totals_with_a_hot_group(spark, parts):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 37) % 1009, i) for i in range(1009)] + [(None, 5000 + i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(parts)
    got = {(r.g, r.o): r.total for r in running_totals(df, ["o"], {"total": "x"}, ["g"]).collect()}
    sums, want = {}, {}
    for g, o, x in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + x
        want[(g, o)] = sums[g]
    assert got == want


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("parts", [1, 2, 16])
def test_carry_forward(spark, parts, backward):
    rng = random.Random(3)
    rows = [(i % 3 if i % 4 else None, i, rng.choice([None, None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(parts)
    got = {r.o: r.v for r in carry_forward(df, ["v"], ["o"], ["g"], backward).collect()}
    last, want = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1], reverse=backward):
        if v is not None:
            last[g] = v
        want[o] = last.get(g)
    assert got == want


def test_dense_index_sorts_by_code_point(spark):
    words = ["b", "a", "É", "ab", "Z", "z", "0", "ä", "中", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.position for r in dense_index(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def skewed_rows(kind, count=6000):
    """A third of the order values NULL, or equal; the others and the ids all differ."""
    rng = random.Random(7)
    odd = {"null": None, "equal": 500.0, "even": -1.0}[kind]
    return [(odd if i % 3 == 0 and kind != "even" else rng.uniform(0, 1000), i, "hot" if i % 5 else f"g{i % 7}", rng.choice([None, i])) for i in range(count)]


@pytest.mark.parametrize("kind", ["null", "equal", "even"])
def test_ranges_are_even_and_hold_every_row_once(spark, kind):
    rows = skewed_rows(kind)
    df = spark.createDataFrame(rows, "v double, id int, g string, x int").repartition(5)
    cut = in_ranges(df, ["v"], per_range=300)
    sizes = sorted(r["count"] for r in cut.groupBy("_bucket").count().collect())
    assert len(sizes) == 20 and sum(sizes) == len(rows)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    edges = cut.groupBy("_bucket").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("_bucket").collect()
    known = [(r.low, r.high) for r in edges if r.low is not None]
    assert all(a[1] <= b[0] for a, b in zip(known, known[1:]))


@pytest.mark.parametrize("kind", ["null", "equal"])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_running_totals_over_many_ranges_of_skewed_values(spark, kind, groups):
    rows = skewed_rows(kind, 2000)
    df = spark.createDataFrame(rows, "v double, id int, g string, x int").repartition(3)
    out = running_totals(df.withColumn("one", F.lit(1)), ["v", "id"], {"place": "one", "total": "x"}, groups, per_range=90)
    got = {r.id: (r.place, r.total) for r in out.collect()}
    seen, sums, want = {}, {}, {}
    for v, i, g, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        k = g if groups else None
        seen[k] = seen.get(k, 0) + 1
        sums[k] = sums.get(k, 0) + (x or 0)
        want[i] = (seen[k], sums[k])
    # a range without a value adds nothing, as a sum of NULLs
    assert {i: (p, t or 0) for i, (p, t) in got.items()} == want


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("kind", ["null", "equal"])
def test_carry_forward_over_many_ranges_of_skewed_values(spark, kind, backward):
    rows = skewed_rows(kind, 1500)
    df = spark.createDataFrame(rows, "v double, id int, g string, x int").repartition(4)
    got = {r.id: r.x for r in carry_forward(df, ["x"], ["v", "id"], ["g"], backward, per_range=70).collect()}
    last, want = {}, {}
    for v, i, g, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=backward):
        last[g] = x if x is not None else last.get(g)
        want[i] = last[g]
    assert got == want


def test_ranges_of_no_rows_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "v double, x int")
    assert running_totals(empty, ["v"], {"t": "x"}).count() == 0
    same = spark.createDataFrame([(1.0, 2)] * 500, "v double, x int")
    out = running_totals(same, ["v"], {"t": "x"}, per_range=40).collect()
    assert sorted(r.t for r in out) == [2 * n for n in range(1, 501)]
    assert range_count(10**12, 10**6, 200) == 10**6 and range_count(30_000, 10**6, 8) == 2 and range_count(0, 10, 8) == 1


def test_lookup_join_beyond_the_broadcast_limit(spark):
    rows = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [("unknown", 1)]
    table = [("hot", 300, "H")] + [(f"k{i}", 1, f"v{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int")
    lookup = spark.createDataFrame(table, "k string, cnt int, v string")
    want = sorted((k, i, dict((a, c) for a, _, c in table).get(k) or "") for k, i in rows)
    for limit in (1000, 10):
        out = lookup_join(df, lookup, ["k"], "left", weight="cnt", limit=limit)
        assert sorted((r.k, r.i, r.v or "") for r in out.collect()) == want
