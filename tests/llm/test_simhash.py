import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.common import merge_labels
from plumbline.llm.components import components
from tests.llm.rows import documents, none, prose


def print_by_hand(text, words):
    parts = [p for p in (text or "").encode().lower().split()]
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(prints, distance):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= distance:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("text", ["", None, "One", "a B c", prose(3, 50), "\x0bA\x1cB\x85C D É é"])
def test_fingerprint(text):
    for words in (1, 4, 5):
        assert int(simhash.sketch(text, words)[0]) == print_by_hand(text, words)


def test_blocks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert int(simhash.sketch(prose(2, 100), 4, 4)[0]) == print_by_hand(prose(2, 100), 4)


@pytest.mark.parametrize("blocks,check_bits,distance", [(3, 4, 4), (7, 0, 13), (4, 3, 5), (2, 4, 4)])
def test_every_near_pair_meets_at_both_homes(blocks, check_bits, distance):
    rng = np.random.default_rng(0)
    for _ in range(60):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        flips = rng.choice(64, rng.integers(0, distance + 1), replace=False)
        b = a ^ np.uint64(sum(1 << int(f) for f in flips))
        met = [False, False]
        for block in simhash.covering_blocks(distance, blocks, check_bits):
            row, anchor, home = block.reach(np.array([a, b], np.uint64))
            sets = [set(anchor[row == i].tolist()) for i in (0, 1)]
            homes = [anchor[(row == i) & home].tolist() for i in (0, 1)]
            assert [len(h) for h in homes] == [1, 1]
            met[0] |= homes[0][0] in sets[1]
            met[1] |= homes[1][0] in sets[0]
        assert all(met)


@pytest.mark.parametrize("pairs", [8, 1 << 19])
def test_classes_within_cells(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", pairs)
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 12, 60, dtype=np.uint64)
    cells = np.repeat([1, 2, 5], [10, 35, 15])
    label = simhash.cell_classes(cells, np.ones(60, bool), words, 2)
    for c in (1, 2, 5):
        at = np.flatnonzero(cells == c)
        assert (label[at] - at[0]).tolist() == classes_by_hand([int(w) for w in words[at]], 2)


def test_merged_labels():
    label = np.arange(6)
    merge_labels(label, np.array([5, 3, 1]), np.array([3, 1, 4]))
    assert label.tolist() == [0, 1, 2, 1, 1, 1]


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, n) for n in range(101, 150)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"))[0].collect()}
    assert got == {**{n: 1 for n in range(1, 41)}, **{n: 100 for n in range(100, 150)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint"))[0].count() == 0


def test_near_duplicates_match_brute_force(spark):
    df = documents(spark)
    rows = df.select("doc_id", "text").collect()
    prints = [print_by_hand(r["text"], 4) for r in rows]
    label = classes_by_hand(prints, 4)
    lowest = {}
    for c, r in zip(label, rows):
        if r["doc_id"] is not None:
            lowest[c] = min(lowest.get(c, 1 << 60), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{p:016x}", str(lowest.get(c))) for r, p, c in zip(rows, prints, label))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    df = documents(spark)
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.keep_one(none(spark)).count() == 0
    rows = df.select("doc_id", "text").collect()
    label = classes_by_hand([print_by_hand(r["text"], 4) for r in rows], 4)
    ids = {}
    for c, r in zip(label, rows):
        ids.setdefault(c, []).append(r["doc_id"])
    want = sorted(str(min((i for i in found if i is not None), default=None)) for found in ids.values())
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(df).collect()) == want


def test_kept_documents_are_those_of_all_pairs_of_fingerprints(spark):
    rng = np.random.default_rng(5)
    texts = []
    for group in range(40):  # texts that differ in none to many words, so in few or many bits
        parts = [f"w{n}" for n in rng.integers(0, 1 << 40, 150)]
        for changed in (0, 0, 1, 2, 4, 12, 40):
            other = list(parts)
            for at in rng.choice(150, changed, replace=False):
                other[at] = f"v{rng.integers(0, 1 << 40)}"
            texts.append(" ".join(other))
    df = spark.createDataFrame([(5000 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    label = classes_by_hand([print_by_hand(t, 4) for t in texts], 4)
    last = {}
    for i, c in enumerate(label):
        last[c] = 5000 - i
    assert 40 < len(last) < len(texts)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(last.values())
