"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import variants
from tests.llm.rows import documents, none


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(counts, times):
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = [form, w, n, len(close), counts[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def edited(word, letters):
    i = random.randrange(len(word) + 1)
    kind = random.randrange(3)
    c = random.choice(letters)
    return word[:i] + c + word[i:] if kind == 0 else word[:i] + (c if kind == 1 else "") + word[i + 1 :]


@pytest.mark.parametrize("long", [None, 3])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, long):
    if long:
        monkeypatch.setattr(variants, "LONG", long)  # words beyond it take one edge for all that is left
    random.seed(11)
    counts = {}
    for _ in range(120):
        base = "".join(random.choices("abàÿ" if _ % 2 else "aab", k=random.randrange(1, 11)))
        counts[base] = random.randrange(1, 2000)
        for _ in range(4):
            word = edited(base, "abàÿ")
            if word:
                counts.setdefault(word, random.randrange(1, 300))
    far = "".join(random.choices("abc", k=90))
    for at in (0, 30, 44, 45, 60, 89):
        counts[far[:at] + "z" + far[at + 1 :]] = at + 3
        counts[far[:at] + "y" + far[at:]] = at + 4
    edge = "ab" * 20
    counts |= {far: 5000, far + "q": 9, edge: 700, edge + "a": 3, edge + "aa": 2, "q": 1, "a": 4, "b": 90}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    rows = variants.group_variants(df, 5).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(rows) == len(counts)
    assert got == brute(counts, 5)


def test_words_of_texts(spark):
    letters = re.compile("[A-Za-zÀ-ÿ]+")
    docs = documents(spark)
    want = Counter()
    for r in docs.collect():
        for run in letters.findall(r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = variants.words_of(docs, "doc_id", "text", 4, 2, 3)
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 4 and n >= 2}
    tricky = spark.createDataFrame([(1, "ÀÉÎ× Éàabcd ABCDEF abcdefÿ xĀabcdef¿ghijkl")] * 2, "doc_id int, text string")
    got = variants.words_of(tricky, "doc_id", "text", 4, 2, None)
    assert {r["word"]: r["n"] for r in got.collect()} == {"ÀÉÎ×": 2, "Éàabcd": 2, "abcdef": 4, "abcdefÿ": 2, "ghijkl": 2}


def test_odd_and_empty_tables(spark):
    assert variants.spelling_variants(none(spark)).count() == 0
    rows = variants.spelling_variants(documents(spark), least_letters=4).collect()
    assert rows and len({r["word"] for r in rows}) == len(rows)
    one = spark.createDataFrame([("word", 7)], "word string, n bigint")
    assert [tuple(r) for r in variants.group_variants(one).collect()] == [("word", None, "word", 7, 0, None)]
