"""Queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import language, queries
from plumbline.llm.common import Written
from tests.llm.rows import documents, none, prose
from tools.check import TABLES, rows_of

CONTRACT = {
    1: {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    2: {"doc_id", "fingerprint", "component_id"},
    3: {"doc_id", "held_out", "score", "predicted"},
    4: {"doc_id", "start", "n_tokens", "ids_crc32"},
    5: {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    6: {"doc_id", "held_out", "lang_pred", "score"},
    7: {"query_id", "rank", "vec_id", "score"},
    8: {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    9: {"doc_id", "rate", "copies"},
    10: {"vec_id", "n_links", "component_id", "kept"},
    11: {"word", "form", "root", "n", "n_near", "form_n"},
    12: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    13: {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == sorted(CONTRACT)
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert CONTRACT[int(name[2:].split("_")[0])] <= set(df.columns)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in queries.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{os.path.join(small, t)}.parquet')")
        cursor = con.execute(queries.SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


def test_stages_keep_columns_and_decide(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Written(stage(spark, docs, small), name).df
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.collect()} <= ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_odd_and_empty_documents(spark, small):
    for make in (documents, none):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            docs = Written(stage(spark, docs, small), name).df
        assert docs.count() == 0 if make is none else docs.count() > 0


def test_language_stage_without_labels_or_with_long_ones(spark, small):
    docs = documents(spark)
    known = lambda df: sorted(str(r["doc_id"]) for r in corpus_pipeline.language_id(spark, df, small).collect())
    lettered = sorted(["3", "4", "4", "5", "6", "7", "None", "None", "9", "11", "11"])
    assert known(docs.withColumn("lang", F.lit(None).cast("string"))) == lettered
    # every label is on a text beyond the sample's size
    long = docs.withColumn("lang", F.when(F.octet_length("text") > 60_000, F.lit("en")))
    assert language.fit(long).names == ["en"]
    assert known(long) == lettered


def test_language_stage_drops_what_no_language_tells(spark, small):
    docs = documents(spark)
    rng = np.random.default_rng(2)
    noise = " ".join("".join(chr(c) for c in rng.integers(97, 123, 6)) for _ in range(200))
    other = docs.where("doc_id = 9")
    rows = docs
    for key, text in ((70, noise), (71, "Qx vj"), (72, noise[:40] + " " + prose(3, 200))):
        rows = rows.unionByName(other.withColumn("doc_id", F.lit(key).cast("long")).withColumn("text", F.lit(text)).withColumn("lang", F.lit(None).cast("string")))
    kept = sorted(str(r["doc_id"]) for r in corpus_pipeline.language_id(spark, rows, small).collect())
    assert kept == sorted(["3", "4", "4", "5", "6", "7", "None", "None", "9", "11", "11", "71", "72"])
