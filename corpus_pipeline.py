"""From raw documents to packed training sequences, one operator per stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last keep the columns of
``docs``. Nulls, empty tables, repeated rows and further columns are handled as the
operators' docstrings state; a document without any letter, or of letters that no language
helps to tell, leaves at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, mixing, packing, simhash, toxicity
from plumbline.llm.common import Written, fresh

TARGETS = {"1": 0.9, "0": 0.1}  # shares of tokens by labelled quality
LEAST_SPARE = 64.0  # bits against every language before a text counts as none of them


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Those of no language (``und``) go, and those whose
    shortest parse takes ``LEAST_SPARE`` bits more than bytes drawn alike from the alphabet:
    no learned language helps to tell them. Short texts can't fall that far behind and stay.
    Where no label teaches a language, only documents without a letter go."""
    parser = language.fit(docs.where(language.fold("doc_id", 4) != 2))
    if not parser.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found, score, spare = (fresh(docs, name) for name in ("_found", "_sure", "_spare"))
    judged = language.predict(docs, parser, "text", found, score, spare)
    told = (F.col(found) != language.UNKNOWN) & (F.col(spare) >= -LEAST_SPARE)
    return judged.where(told).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't call them toxic."""
    labels = _labels(spark, sf_dir).where(toxicity.fold("doc_id", 5) != 0)
    index = toxicity.fit(docs, labels)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    judged = docs.withColumn(doc := fresh(docs, "_doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select(doc, F.col("text").alias("_text"))
    scored = toxicity.with_scores(judged, index, "_text", key_type)
    return scored.where("predicted = 0").select(f"{doc}.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near copies: that of the smallest id."""
    return simhash.keep_one(docs, words=4, distance=4)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the tokens to the target shares."""
    return mixing.mix(docs, _labels(spark, sf_dir), TARGETS, by_row=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 2048 ids."""
    return packing.pack(docs, most_pieces=packing.SIZE)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

# Models, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = Written(stage(spark, out, sf_dir), name).df
    return STAGES[-1][1](spark, out, sf_dir)
