"""Document tables: checksums and repeated uploads, admission, re-indexing and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.joins import lookup_join
from plumbline.functions.text import suffix
from plumbline.session import materialize

# Fixed values of the admission rule.
FORMATS = ("csv", "data", "xlsx", "xls", "json", "parquet")
MAX_MEGABYTES = 500
EMPTY_TEXT = "empty after cleaning"


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def admission(uploads: DataFrame, name: str, size: str, formats: Sequence[str] = FORMATS, megabytes: int = MAX_MEGABYTES) -> DataFrame:
    """Add ``admitted`` and ``reason`` by format and size."""
    listed = F.substring(suffix(F.col(name)), 2, 100).isin(*formats)
    small = F.col(size) <= megabytes * 1024 * 1024
    reason = F.when(~listed, "unsupported format").when(~small, "file too large")
    return uploads.withColumn("admitted", listed & small).withColumn("reason", reason)


def new_uploads(uploads: DataFrame, known: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Uploads whose ``key`` (project and checksum) is not known yet, the first of a batch only.

    The first of each group is a partial minimum, so a third of the batch being one file
    costs one row per task; contents are not shuffled.
    """
    key = list(key)
    first = uploads.groupBy(*key).agg(F.min(order).alias(order))
    fresh = first.join(known.select(*key).distinct(), key, "left_anti")
    return uploads.join(fresh, [*key, order], "left_semi")


def repeated_uploads(uploads: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Uploads that repeat an earlier one of the batch, with the id of the first."""
    groups = uploads.groupBy(*key).agg(F.min(order).alias("first_id"), F.count("*").alias("_copies")).where("_copies > 1")
    groups = materialize(groups, "copies")
    matched = lookup_join(uploads, groups, key, "inner", weight="_copies")
    return matched.where(F.col(order) > F.col("first_id")).select(*uploads.columns, "first_id")


def replace_chunks(old: DataFrame, new: DataFrame, ingested: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Chunk table after re-ingesting documents: their old chunks go, the new ones come."""
    return old.join(ingested.select(doc_id).distinct(), doc_id, "left_anti").unionByName(new)


def ingest_status(cleaned: DataFrame, text: str = "text") -> DataFrame:
    """Add ``status`` and ``error``: a document without text after cleaning has failed."""
    empty = F.coalesce(F.length(F.col(text)), F.lit(0)) == 0
    return cleaned.withColumn("status", F.when(empty, "failed").otherwise("indexed")).withColumn(
        "error", F.when(empty, EMPTY_TEXT)
    )


def ingest_report(documents: DataFrame) -> DataFrame:
    return documents.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def corpus_totals(
    documents: DataFrame, chunks: DataFrame, base: str, doc_id: str = "doc_id", vectors: DataFrame | None = None, vector: str = "embedding"
) -> DataFrame:
    """Documents and chunks per knowledge base, recomputed from the tables; with the table of
    embedded chunks also their number of vectors, and whether all chunks have one."""
    def per_base(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    counts = chunks.groupBy(doc_id).agg(F.count("*").alias("n"))
    joined = documents.select(base, doc_id).join(counts, doc_id, "left")
    totals = [F.count("*").alias("documents"), per_base("n").alias("chunks"), F.count("n").alias("documents_with_chunks")]
    if vectors is not None:
        joined = joined.join(vectors.groupBy(doc_id).agg(F.count(vector).alias("_vectors")), doc_id, "left")
        totals += [per_base("_vectors").alias("vectors"), (per_base("n") == per_base("_vectors")).alias("is_indexed")]
    return joined.groupBy(base).agg(*totals)
