import math
import tracemalloc

import numpy as np
import pytest

from plumbline.llm import search, vectors
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id bigint, embedding array<float>, n_links int, node string")


def odd_rows():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + rng.normal(scale=0.03, size=8)]) for i in range(60)]
    rows += [(60, rows[0][1]), (61, rows[0][1]), (61, rows[0][1]), (None, rows[1][1]), (None, [1.0, 0.0, 0.0])]
    rows += [(62, None), (63, []), (64, [0.0] * 8), (65, [NAN] * 8), (66, [INF] + [0.0] * 7), (67, [1.0, None]), (68, [3.0, 0.0])]
    return rows


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def padded(v, n=8):
    return np.array([*v, *[0.0] * (n - len(v))], np.float64)


def links_by_hand(rows, threshold):
    n = len(rows)
    good = [bool(usable(v) and any(v)) for _, v in rows]
    units = [padded(v) / np.linalg.norm(padded(v)) if g else None for (_, v), g in zip(rows, good)]
    link = [[i != j and good[i] and good[j] and float(units[i] @ units[j]) >= threshold - 1e-12 for j in range(n)] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        for j in range(n):
            if link[i][j] and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, (key, _) in enumerate(rows):
        count = sum(link[i])
        ids = [k for (k, _), c in zip(rows, label) if c == label[i] and k is not None]
        lowest = min(ids) if ids else None
        out.append((str(key), count, str(lowest), count == 0 or (key is not None and key == lowest)))
    return sorted(out)


@pytest.mark.parametrize("groups", [4096, 3])
def test_links_match_brute_force(spark, monkeypatch, groups):
    monkeypatch.setattr(vectors, "BASES_PER_GROUP", groups)
    monkeypatch.setattr(vectors, "ROWS_PER_CELL", 4)
    rows = odd_rows()
    got = vectors.near_duplicates(table(spark, rows), threshold=0.95, target_recall=1.0).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == links_by_hand(rows, 0.95)


def test_lower_recall_finds_only_true_links(spark):
    rows = [r for r in odd_rows() if usable(r[1]) and r[0] is not None]
    exact = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(table(spark, rows), target_recall=1.0).collect()}
    less = vectors.near_duplicates(table(spark, rows), target_recall=0.9).collect()
    assert all(r["n_links"] <= exact[r["vec_id"]] for r in less)
    assert sum(r["n_links"] for r in less) >= 0.8 * sum(exact.values())


def test_no_vectors(spark):
    assert vectors.near_duplicates(table(spark, [])).count() == 0
    rows = vectors.near_duplicates(table(spark, [(1, None), (2, [0.0])])).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True)]


def top_by_hand(rows, every, k):
    good = sorted({(i, tuple(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}, key=str)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    out = []
    for i, v in whole:
        if i is None or i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for j, w in whole if j != i]
        out += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows,leaf", [(8192, 64), (10, 2)])
def test_top_k_matches_brute_force(spark, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(search, "ROWS_PER_SHARD", shard_rows)
    monkeypatch.setattr(search.BallTree.__init__, "__defaults__", (leaf,))
    rows = odd_rows()
    got = search.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=5).collect()
    # id 61 holds one vector twice: equal rows are one row
    assert sorted((tuple(r) for r in got), key=str) == top_by_hand(rows, 10, 5)


def test_scores_beyond_doubles(spark):
    big = [3.0e4, 1.0]
    rows = [(0, [1.0e9, 1.0]), (1, big), (2, [2.0e9, 0.0]), (3, [-3.0e38, 0.0])]
    got = search.top_k(table(spark, rows), F.col("vec_id") == 0, k=5).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1, 3]
    assert got and min(r["score"] for r in got) == -(1 << 63)


def test_few_rows_and_none(spark):
    assert search.top_k(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert search.top_k(table(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    got = search.top_k(table(spark, [(0, [1.0]), (1, [1.0]), (2, [])]), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 65536), (0, 2, 2, 0)]


def test_ids_beyond_doubles_beside_a_null_id(spark):
    big = 1 << 60
    rows = [(big + i, [float(i), 1.0]) for i in range(9)] + [(None, [7.5, 1.0])]
    got = search.top_k(table(spark, rows), F.col("vec_id") == big + 8, k=4).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, None), (2, big + 7), (3, big + 6), (4, big + 5)]
    assert {r["query_id"] for r in got} == {big + 8}
    named = table(spark, rows).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id") - big))
    texts = search.top_k(named, F.col("vec_id") == "v8", k=2).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in texts) == [(1, None), (2, "v7")]


def budget_by_hand(grid, sample, threshold, recall):
    """The same rule with every near pair at hand."""
    near = sample @ sample.T >= threshold
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    homes = grid.home(sample)
    needed = np.minimum(grid.bound_to(sample[a], homes[b]), grid.bound_to(sample[b], homes[a]))
    weights = 1 / near.sum(1)[a]
    order = np.argsort(needed)
    passed = np.cumsum(weights[order]) / weights.sum()
    return needed[order][np.searchsorted(passed, recall)]


def test_budget_of_many_near_pairs_in_bounded_memory():
    rng = np.random.default_rng(5)
    mixed = vectors.unit(np.repeat(rng.normal(size=(40, 16)), 12, axis=0) + rng.normal(scale=0.08, size=(480, 16)))
    grid = vectors.Grid(mixed, 12)
    exact = 2 - 2 * 0.95
    want = min(exact, max(exact * (1 - 0.1 ** (2 / 14)), budget_by_hand(grid, mixed, 0.95, 0.9)))
    assert want <= vectors.budget_for(grid, mixed, 0.95, 0.9) <= want + 2 * exact / vectors.BUDGET_STEPS

    copies = vectors.unit(np.ones(32) + rng.normal(scale=1e-3, size=(8192, 32)))  # 67 million near pairs
    grid = vectors.Grid(copies, 8)
    tracemalloc.start()
    budget = vectors.budget_for(grid, copies, 0.95, 0.99)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert 0 < budget <= exact + vectors.SLACK


def test_near_copies_take_bounds_per_vector_not_per_pair(spark, monkeypatch):
    whole = vectors.Grid.bounds

    def bounds(self, points):
        assert len(points) <= 1000, "bounds of pairs are held"
        return whole(self, points)

    monkeypatch.setattr(vectors.Grid, "bounds", bounds)
    monkeypatch.setattr(vectors, "ROWS_SENT_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    near = np.ones(16) + rng.normal(scale=0.02, size=(300, 16))  # 89,700 links in a few cells
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(near)]
    got = vectors.near_duplicates(table(spark, rows), target_recall=1.0).collect()
    assert {tuple(r)[1:] for r in got} == {(299, 0, True), (299, 0, False)}
