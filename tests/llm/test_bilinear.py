"""The language model's counts, normalisation and scores against plain recomputation."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bilinear, language
from tests.llm.rows import documents, none


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x20\\x09-\\x0D]+", lowered) + [None]


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


@pytest.mark.parametrize("most_common", [1, 500, 1 << 20])
def test_scores_are_those_of_the_model_token_by_token(spark, small, most_common):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = [(9001, None), (9002, ""), (9003, "\x0b\x0c \t"), (9004, "NEVER Seenbefore Seenbefore x   É é"), (9004, "NEVER again")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    training = docs.where(language.fold("doc_id", 5) != 1)
    counts = bilinear.Written(bilinear.token_counts(training, "text"), "counts").df
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    assert {r["token"]: r["c"] for r in counts.collect()} == {bilinear.END if t is None else t: n for t, n in c.items()}
    n, v = sum(c.values()), len(c)
    classes = bilinear.classes_of(counts, most_common=most_common)
    model = bilinear.fit(training, F.xxhash64("doc_id"), "text", classes)
    # the tokens' shares within their classes, the unknown token's included, sum to 1
    inside = Counter()
    for t, k in c.items():
        inside[classes.of(bilinear.END if t is None else t)] += (k + 0.5) / (n + 0.5 * (v + 1))
    inside[classes.rest] += 0.5 / (n + 0.5 * (v + 1))
    assert np.allclose([inside[k] for k in range(len(classes.mass))], classes.mass, atol=1e-12)
    _, before = model.contexts([np.arange(30) % len(classes.mass)])
    assert np.allclose(np.exp(model.log_probabilities(before).astype(float)).sum(1), 1, atol=1e-4)
    got = {}
    for r in bilinear.score(docs, counts, classes, model).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], r["base_score"], r["score"]))
    want = {}
    for i, x in rows:
        ts = tokens(x)
        named = [bilinear.END if t is None else t for t in ts]
        cls, ctx = model.contexts([np.array([classes.of(t) for t in named])])
        logs = model.log_probabilities(ctx)
        base = [math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts]
        real = [k if t in c else classes.rest for t, k in zip(ts, cls)]
        full = sum(b + logs[j, k] / math.log(10) - math.log10(classes.mass[k]) for j, (b, k) in enumerate(zip(base, real)))
        want.setdefault(i, []).append((len(ts), sum(t in c for t in ts), sum(base), full))
    assert got.keys() == want.keys()
    for i in got:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-4, atol=1e-3)


def test_held_out_texts_are_likelier_than_by_shares_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = bilinear.held_out_scores(docs, language.fold("doc_id", 5) == 1).where("held_out")
    base, score = out.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_every_training_document_teaches(spark):
    for key in range(4):
        one = spark.createDataFrame([(key, f"one two three one two {key}")], "doc_id bigint, text string")
        counts = bilinear.Written(bilinear.token_counts(one, "text"), "counts").df
        classes = bilinear.classes_of(counts)
        model = bilinear.fit(one, F.xxhash64("doc_id"), "text", classes)
        assert not np.array_equal(model.flat, bilinear.Model(classes.mass).flat)


def test_scores_beyond_what_exp_holds(spark):
    model = bilinear.Model(np.array([0.5, 0.3, 0.2]))
    model.parts[3] = np.array([300, -300, 290], np.float32)
    target, before = model.contexts([np.array([0, 1, 2, 2])])
    logs = model.log_probabilities(before).astype(float)
    own, other = model.chosen(before, target, 1)
    assert np.allclose(own, logs[np.arange(4), target], rtol=1e-4) and np.allclose(other, logs[:, 1], rtol=1e-4)


def test_odd_and_empty_tables(spark):
    docs = documents(spark)
    rows = bilinear.held_out_scores(docs, language.fold("doc_id", 5) == 1).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert all(math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in rows)
    untaught = bilinear.held_out_scores(docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in untaught)
    assert bilinear.held_out_scores(none(spark), F.lit(False)).count() == 0


def test_training_steps_are_those_of_plain_sums():
    rng = np.random.default_rng(5)
    mass = rng.dirichlet(np.ones(9))
    model, noise, batch, rate = bilinear.Model(mass, width=3, context=2), 4, 8, 0.15
    target, before = rng.integers(0, 9, 29), rng.integers(0, 10, (29, 2))
    vectors, places, outputs, bias = (p.astype(float) for p in model.parts)
    parts = [vectors, places, outputs, bias]
    squares = [np.full(p.shape, 1e-2) for p in parts]
    random = np.random.default_rng(11)
    order, upto = random.permutation(29), np.cumsum(mass / mass.sum())
    for at in range(0, 29, batch):
        rows, slopes = order[at : at + batch], [np.zeros(p.shape) for p in parts]
        drawn = np.minimum(np.searchsorted(upto, random.random(noise)), 8)
        for i in rows:
            h = sum(vectors[before[i, k]] * places[k] for k in range(2))
            g_h = np.zeros(3)
            for c, real in [(target[i], True), *((d, False) for d in drawn)]:
                likely = 1 / (1 + np.exp(-(h @ outputs[c] + bias[c] - np.log(noise * mass[c]))))
                slope = likely - real
                slopes[2][c] += slope * h
                slopes[3][c] += slope
                g_h += slope * outputs[c]
            for k in range(2):
                slopes[0][before[i, k]] += g_h * places[k]
                slopes[1][k] += g_h * vectors[before[i, k]]
        for p, g, s in zip(parts, slopes, squares):
            s += (g / len(rows)) ** 2
            p -= rate * g / len(rows) / np.sqrt(s)
    model.train(target, before, 11, noise, batch, rate)
    for got, want in zip(model.parts, parts):
        assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("bias", [0, 100])
def test_many_scores_by_products_or_one_by_one(bias):
    rng = np.random.default_rng(3)
    model = bilinear.Model(rng.dirichlet(np.ones(12)), width=3, context=3)
    model.parts = [p + rng.normal(0, 0.7, p.shape).astype(np.float32) for p in model.parts]
    model.parts[3][5] += bias
    target, before = model.contexts([rng.integers(0, 12, n) for n in (900, 1, 400)])
    assert len(target) > 2 * bilinear.TOKENS_AT_ONCE and (model.powers() is None) == (bias > bilinear.HIGHEST)
    logs = model.log_probabilities(before).astype(float)
    own, other = model.chosen(before, target, 11)
    assert np.allclose(own, logs[np.arange(len(target)), target], atol=1e-4) and np.allclose(other, logs[:, 11], atol=1e-4)


def test_tokens_are_split_at_ascii_white_space_only():
    texts = ["  A\tb\x0b\x0cC\r\n", None, "", " \n ", "É x y\x1cZ\x85 <0>\x00", "one"]
    found, sizes = bilinear.tokens_of(pa.array(["cut off", *texts]).slice(1))
    assert found.to_pylist() == [bilinear.END if t is None else t for x in texts for t in tokens(x)]
    assert sizes.tolist() == [len(tokens(x)) for x in texts]


def test_places_of_common_and_other_tokens():
    classes = bilinear.Classes({"the": 0}, {b"ng": 1, "é".encode(): 2, b"x": 3}, np.full(5, 0.2), {"the": 0, "king": 1}, np.array([9, 5]), 20, 9)
    place, found = classes.places(pa.array(["king", "the", "ring", "café", "x", "xx", bilinear.END]))
    assert place.tolist() == [1, 0, -1, -1, -1, -1, -1] and found.tolist() == [1, 0, 1, 2, 3, 4, 4]
    assert [classes.of(t) for t in ("king", "the", "ring", "café", "x", "xx", bilinear.END)] == found.tolist()


def test_counts_flushed_and_merged_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "FLUSH_AT", 8)
    monkeypatch.setattr(bilinear.bpe, "TEXT_BYTES_AT_ONCE", 12)
    texts = [f"a b w{i % 5} v{i}" for i in range(60)]
    counts = bilinear.token_counts(spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1), "text")
    want = Counter(bilinear.END if t is None else t for x in texts for t in tokens(x))
    assert {r["token"]: r["c"] for r in counts.collect()} == want
