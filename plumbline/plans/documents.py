"""Document preparation end to end: clean, chunk, re-index, search and assemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import clean_text
from plumbline.operators import chunking, corpus, retrieval


@dataclass
class Indexed:
    documents: DataFrame
    chunks: DataFrame
    report: DataFrame


def index_documents(
    documents: DataFrame, strategy: str = "recursive", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, doc_id: str = "doc_id"
) -> Indexed:
    """Clean and chunk a table of ``(doc_id, text, ...)``; an empty document fails alone."""
    cleaned = corpus.ingest_status(documents.withColumn("text", clean_text(F.col("text"))))
    usable = cleaned.where(F.col("status") == "indexed").select(doc_id, "text")
    chunks = chunking.chunk(usable, strategy, "text", size, overlap)
    return Indexed(cleaned.drop("text"), chunks, corpus.ingest_report(cleaned))


def reindex(old_chunks: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """Chunk table with the chunks of ``documents`` replaced."""
    fresh = index_documents(documents, **options)
    return corpus.replace_chunks(old_chunks, fresh.chunks, documents)


def answer_contexts(vectors: DataFrame, queries: DataFrame, texts: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Citations and cited contexts for a table of query vectors.

    ``vectors`` has ``(id, vector)``, ``queries`` ``(query_id, vector)`` and ``texts``
    ``(id, text, source)``.
    """
    found = retrieval.search_results(retrieval.top_k(vectors, queries, k), texts)
    cited = retrieval.citations(found)
    return cited, retrieval.cited_context(cited)
