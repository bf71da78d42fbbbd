"""Alignment of two tokenizers against whole texts encoded by the libraries alone."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import align, queries
from tests.llm.rows import documents, none, prose

ODD = [
    " leading and  double   blanks ", "\n new line first", "a\n\n b\tc", "É déjà-vu, naïve; coöperate!", "日本語 text 漢字。",
    "emoji 👩‍👩‍👧 and ﬁne ½", "<|endoftext|> is <s> text </s>", "holds ▁ itself", "x\x00y \x07", "1,234.50 or 3:15?! ...", "it's we'll O'Neil's",
    "tail\n", "tail ", "don’t “quote” — dash", "ſtraße ǅ ɏɐ word,", "A,B.C;D", "é combining",
]


def brute(texts):
    a_model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_bytes = align.byte_level_tokens(P.path("byte_bpe_50k.json"))
    rows, docs = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
        parts_a = [a_bytes[i] for i in a]
        parts_b = [bytes([int(b_model.id_to_piece(i)[3:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            rows.append(None)
            continue

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(parts_a), spans(parts_b)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        in_group = [[[], []] for _ in ends]
        for side, (ids, where) in enumerate(((a, sa), (b, sb))):
            for i, span in zip(ids, where):
                in_group[bisect_left(ends, span[1])][side].append(str(i))
        groups = [",".join(x) + "|" + ",".join(y) for x, y in in_group]
        at_a = {k: n for n, (low, high) in enumerate(sa) for k in range(low, high)}
        links = [(a[n], j) for j, (low, high) in zip(b, sb) for n in sorted({at_a[k] for k in range(low, high)})]
        docs.update(set(links))
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = r
            best = sum(docs[p] == most[p[0]] for p in links)
            out.append((n_a, n_b, len(groups), len(links), best, sum(docs[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df, **options):
    kept = df.select("doc_id", "text", F.lit("mine").alias("pairs_of"), F.lit(7).alias("n_a"))
    aligned = align.alignments(kept).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))).drop("groups")
    out = align.with_pair_counts(aligned, **options)
    assert sorted(out.columns) == sorted(["doc_id", "pairs_of", *COLUMNS])
    return out


@pytest.mark.parametrize("most_common", [0, 40, 1 << 18])
def test_counts_and_groups_of_odd_texts(spark, most_common):
    random.seed(3)
    texts = [*ODD, None, "", *[prose(k, 60) for k in range(6)], prose(2, 60), *["".join(random.choices("ab é,.\n 1'", k=40)) for _ in range(60)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found(df, most_common=most_common).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_small_memory_gives_the_same(monkeypatch):
    import pyarrow as pa

    texts = pa.array([prose(k, 50) + ODD[k % len(ODD)] for k in range(40)])
    whole = align.Aligner(align.BYTE_LEVEL, align.WITH_FALLBACK).batch(texts)
    monkeypatch.setattr(align, "MOST_PIECES", 5)
    small = align.Aligner(align.BYTE_LEVEL, align.WITH_FALLBACK)
    for n in (7, 40):
        got = small.batch(texts.slice(0, n))
        assert all(got[k].equals(v.slice(0, n)) for k, v in whole.items())
    assert len(small.code) == len(small.written)


def test_repeats_nulls_and_empty_tables(spark):
    docs = documents(spark)
    rows = found(docs).collect()
    texts = [r["text"] for r in docs.collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(brute(texts))
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert found(none(spark)).count() == 0


def test_whole_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_alignment"](spark, small).collect()}
    short = [i for i, r in enumerate(docs) if len(r["text"] or "") < 6000]
    want = brute([r["text"] if len(r["text"] or "") < 6000 else None for r in docs])
    for i in short:  # counts over the corpus need the long texts too, so only what is a text's own
        assert got[docs[i]["doc_id"]][:4] == want[i][:4] and got[docs[i]["doc_id"]][6] == want[i][6]
