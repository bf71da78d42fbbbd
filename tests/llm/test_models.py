import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import language, mixing, toxicity
from tests.llm.rows import documents, none

EN = "the house and the river with every tree that they have seen there before "
DE = "das haus und der fluss mit jedem baum den sie dort vorher gesehen haben "


def longest_match_phrases(text: bytes, reference: bytes) -> int:
    """Cross parse by plain substring search, from the first byte to the last."""
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in reference:
            n += 1
        count += 1
        at += n
    return count


@pytest.mark.parametrize("segment", [1, 7, 40, 512])
def test_phrases_match_substring_search(monkeypatch, segment):
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "SEGMENTS_AT_ONCE", 100)
    rng = np.random.default_rng(0)
    noise = bytes(rng.integers(97, 105, 3000).astype(np.uint8))
    refs = {"a": EN.encode() * 2, "b": DE.encode() + noise}
    parser = language.Parser(refs)
    texts = [bytes(rng.integers(97, 107, rng.integers(1, 1500)).astype(np.uint8)) for _ in range(40)]
    texts += [EN.encode(), b"zzzz", b"t", DE[:13].encode(), b"z" * 1100, EN.encode() * 40]
    # phrases of several segments: copies of the reference, from its start and from within
    texts += [(EN * 6).encode() * 9, (EN.encode() * 2 + b"~") * 9, noise, noise[100:2900] + b"~" + noise[5:1500], noise[:600] + b"z" * 600 + noise[600:]]
    got = parser.phrases(texts)
    for row, text in zip(got, texts):
        # a phrase that fits no reference at all still takes one byte
        assert row.tolist() == [longest_match_phrases(text, refs[n]) for n in parser.names]


def test_spare_bits_and_draws(spark):
    rng = np.random.default_rng(1)
    refs = {"en": EN.encode() * 3, "de": DE.encode() * 3, "zz": EN.encode() * 3}
    parser = language.Parser(refs)
    noise = " ".join("".join(chr(c) for c in rng.integers(97, 123, 5)) for _ in range(300))
    names, score, spare = parser.judge([EN * 2, noise, "1 2", None])
    # of languages that draw, the first by name
    assert names == ["en", names[1], "und", "und"] and score[0] == 0.5
    assert spare[0] > 0 > spare[1] and spare[2] == spare[3] == 0


def test_languages(spark):
    rows = [(i, (EN if i % 2 else DE) * (1 + i % 3), "en" if i % 2 else "de", "s", "x") for i in range(40)]
    rows += [(40, None, "en", "s", "x"), (41, "", None, "s", "x"), (42, "12 345", "en", "s", "x"), (None, EN, None, "s", "x"), (43, EN * 9000, None, "s", "x"), (1, EN, "en", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string, _judged string")
    got = language.held_out_predictions(df).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 4 == 2)
        if r["doc_id"] in (40, 41, 42):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == ("en" if r["doc_id"] in (None, 43) or r["doc_id"] % 2 else "de")
            assert 0.5 <= r["score"] <= 1
    kept = language.predict(df, language.fit(df), "text", "lang_pred", "score")
    assert kept.count() == len(rows) and kept.columns == [*df.columns, "lang_pred"]
    assert language.held_out_predictions(none(spark)).count() == 0


def test_one_or_no_language(spark):
    df = spark.createDataFrame([(1, EN, "en"), (3, "x y", "en")], "doc_id bigint, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.predict(df, language.fit(df)).collect()} == {("en", 1.0)}
    assert {r["lang_pred"] for r in language.predict(df, language.fit(df.limit(0))).collect()} == {"und"}


def toxic_table(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        words = [f"w{rng.integers(0, 3000)}" for _ in range(60)]
        if bad:
            words[int(rng.integers(0, 60))] = str(rng.choice(["vile", "rotten", "nasty"]))
        rows.append((i, " ".join(words), "x", [1.0]))
        labels.append((i, int(bad)))
    rows += [(300, None, "x", None), (301, "", "x", None), (None, "vile", "x", None), (302, "a nasty " + "word " * 50_000, "x", None)]
    labels += [(None, 1), (303, 1), (5, None), (7, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, near_ids array<double>")
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def cosines_by_hand(index, text):
    bag = Counter(w for w in toxicity.words(text) if w in index.terms)
    t, v = index.vector(bag)
    return dict(zip(t.tolist(), v.tolist()))


def test_block_max_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "LEAST_ASSOCIATION", 0.0)
    monkeypatch.setattr(toxicity, "LEAST_ROWS", 2)
    docs, labels = toxic_table(spark)
    index = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    vectors = [cosines_by_hand(index, texts[k]) for k in index.keys]
    for key in list(texts)[:40]:
        q = cosines_by_hand(index, texts[key])
        t, v = np.array(list(q), np.int64), np.array(list(q.values()))
        want = sorted(((-sum(x * o.get(k, 0.0) for k, x in q.items()), n) for n, o in enumerate(vectors)))
        want = [(round(-s, 9), n) for s, n in want if s < 0][:7]
        got = index.nearest(t, v, 7)
        assert [round(s, 9) for s, _ in got] == [s for s, _ in want]


def test_toxic_texts_score_high(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.held_out_scores(docs, labels).collect()
    assert len(got) == 304
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
        bad = r["doc_id"] in (None, 302) or r["doc_id"] < 300 and r["doc_id"] % 6 == 0
        assert r["predicted"] == int(bad) == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        if bad:
            assert len(r["near_ids"]) == len(r["near_cosines"]) > 0 and 1 in r["near_labels"]


def test_copies_of_examples_without_telling_terms(spark):
    docs, labels = toxic_table(spark)
    rare, calm = (" ".join(f"{c}{n}" for n in range(50)) for c in "rc")
    more = [(901, rare, "x", None), (902, rare, "x", None), (911, calm, "x", None), (912, calm, "x", None), (920, "nothing known", "x", None), (921, "nasty " + calm, "x", None)]
    index = toxicity.fit(docs.unionByName(spark.createDataFrame(more, docs.schema)), labels.unionByName(spark.createDataFrame([(901, 1), (911, 0)], labels.schema)))
    assert not {*toxicity.words(rare), *toxicity.words(calm)} & index.terms.keys()
    score, keys, cosines, found = index.judge(rare)
    assert score >= 0.5 and keys[0] == 901 and found[0] == 1 and cosines[0] == pytest.approx(1, abs=1e-6)
    score, keys, cosines, found = index.judge(calm)
    assert score < 0.5 and keys[0] == 911 and found[0] == 0
    assert index.judge("nothing known")[1] == [] and index.judge("nothing known")[0] == index.judge(None)[0] < 0.5
    # evidence has the cosines over all terms, not those of the one telling term
    assert max(index.judge("nasty " + calm)[2]) < 0.5


def test_cosines_over_all_terms(spark):
    docs, labels = toxic_table(spark)
    index = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = index.all

    def vector(text):
        bag = Counter(toxicity.words(text))
        raw = {w: (1 + np.log(n)) * every.idf[every.terms.get(w, -1)] for w, n in bag.items()}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors = [vector(texts[k]) for k in index.keys]
    for text in [*list(texts.values())[:20], "nasty unseen words w1 w2 w1"]:
        q = vector(text)
        want = [sum(x * v.get(w, 0.0) for w, x in q.items()) for v in vectors]
        assert np.allclose(every.cosines(Counter(toxicity.words(text))), want, atol=1e-6)


def test_no_examples_or_rows(spark):
    docs, labels = toxic_table(spark)
    assert {(r["score"], r["predicted"]) for r in toxicity.held_out_scores(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.held_out_scores(docs.limit(0), labels).count() == 0
    only = toxicity.held_out_scores(docs, labels.where("toxic = 0")).collect()
    assert all(r["predicted"] == 0 for r in only)


def mixed(spark):
    rows = [(i, "WORD WORD WORD " * (5 + i % 7) if i % 4 == 0 else f"some calm text number{i} with other words {i}", 1, [1]) for i in range(200)]
    rows += [(200, None, 1, None), (201, "", 1, None), (None, "calm words", 1, None), (8, rows[8][1], 1, None)]
    labels = [(i, int(i % 4 != 0)) for i in range(0, 200, 3)] + [(None, 1), (1, None), (999, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _tokens int, _bins array<int>"), spark.createDataFrame(labels, "doc_id bigint, quality int")


@pytest.mark.parametrize("share", [0.2, 0.5, 0.95])
def test_expected_tokens_match_the_targets(spark, share):
    docs, labels = mixed(spark)
    rows = mixing.rates(docs, labels, {"1": share, "0": 1 - share}).collect()
    assert len(rows) == 204
    weight = np.array([r["tokens"] * r["rate"] for r in rows])
    total = weight @ np.array([r["posterior"] for r in rows])
    assert np.allclose(total / sum(r["tokens"] for r in rows), [1 - share, share], atol=1e-3)
    assert min(r["rate"] for r in rows) >= 0
    for r in rows:
        draw = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) / 2**32
        assert r["copies"] == int(np.floor(r["rate"] + draw))


def test_mix_takes_rows_by_their_copies(spark):
    docs, labels = mixed(spark)
    targets = {"1": 0.4, "0": 0.6}
    want = Counter({r["doc_id"]: 0 for r in docs.collect()})
    for r in mixing.rates(docs, labels, targets).collect():
        want[r["doc_id"]] += r["copies"]
    out = mixing.mix(docs, labels, targets)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +want


@pytest.mark.parametrize("held", [None, 7])
@pytest.mark.parametrize("same_text", [False, True])
def test_mixed_tokens_meet_the_rates_when_a_third_shares_an_id(spark, held, same_text):
    docs, labels = mixed(spark)
    one = docs.where("doc_id = 1").first()["text"]
    texts = [one if same_text else f"some calm text number{n} with other words {n}" for n in range(400)]
    docs = docs.unionByName(spark.createDataFrame([(held, t, 1, None) for t in texts], docs.schema)).repartition(3)
    # rates below 1 for these rows, and no whole number
    targets = {"1": 0.4, "0": 0.6}
    rows = mixing.rates(docs, labels, targets, by_row=True).collect()
    there = [r for r in rows if r["doc_id"] == held]
    assert len(there) >= 400 and 0.1 < there[0]["rate"] % 1 < 0.9
    for part in (rows, there):
        assert sum(r["tokens"] * r["copies"] for r in part) == pytest.approx(sum(r["tokens"] * r["rate"] for r in part), rel=0.1)
    out = mixing.mix(docs, labels, targets, by_row=True)
    assert out.columns == docs.columns
    assert out.count() == pytest.approx(sum(r["rate"] for r in rows), rel=0.1)


def test_mixing_without_labels_or_rows(spark):
    docs, labels = mixed(spark)
    assert {r["rate"] for r in mixing.rates(docs, labels.limit(0), {"1": 1.0, "0": 1.0}).collect()} == {1.0}
    assert mixing.rates(none(spark), labels, {"1": 1.0}).count() == 0
    for bad in ({}, {"1": -1.0}, {"1": 0.0}):
        with pytest.raises(ValueError):
            mixing.rates(docs, labels, bad)


def test_documents_with_everything_odd(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(3, 1, 0), (9, 0, 1), (10, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert language.held_out_predictions(df).count() == 15
    assert toxicity.held_out_scores(df, labels).count() == 15
    assert mixing.rates(df, labels, {"1": 1.0, "0": 1.0}).count() == 15


def test_fit_holds_the_words_of_its_examples_as_numbers():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{n}" for n in rng.choice(5000, 400, replace=False)) + " vile" * (i % 2) for i in range(600)]
    tracemalloc.start()
    index = toxicity.Index(texts, list(range(600)), np.arange(600) % 2, {0: 3000, 1: 600})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * 600 * 400  # bytes a word and text; a dictionary for each text takes more
    assert index.judge("word1 vile")[0] > 0.5 > index.judge("word1 word2")[0]
