"""Vectors and retrieval: normalisation, exact top-k, context and citations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.text import file_name, strip

# Fixed values.
HIGH, MEDIUM = 0.80, 0.60
MAX_CITATIONS = 5
EXCERPT_CHARS = 500
CONTEXT_CHARS = 4000
CITED_CONTEXT_CHARS = 6000
DIVIDER = "\n\n---\n\n"
DIMENSIONS = 384

# A task compares so many vectors with so many queries, some of them at a time.
ROWS_PER_PART = 50_000
QUERIES_PER_BLOCK = 10_000
QUERIES_AT_ONCE = 256
ROWS_AT_ONCE = 4096
SCORE_DIGITS = 9


def unit_vector(vector: Column) -> Column:
    """L2-normalised copy; a zero vector stays as it is."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def embed_text(df: DataFrame, text: str = "text", output: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """Unit vectors of hashed word counts, all in the JVM; the stand-in for a model."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+").transform(df.where(F.col(text).isNotNull()))
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counts)
    return unit.select(*df.columns, vector_to_array("_unit", "float32").alias(output))


def embed_with(df: DataFrame, model: Callable[[list[str]], np.ndarray], text: str = "text", output: str = "embedding") -> DataFrame:
    """Unit vectors from any function of a list of texts, called once per Arrow batch."""
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        found = np.asarray(model(texts.fillna("").tolist()), dtype="float32")
        norms = np.linalg.norm(found, axis=1, keepdims=True)
        return pd.Series(list(found / np.where(norms == 0, 1, norms)))

    return df.withColumn(output, vectors(F.col(text)))


def _best(query: np.ndarray, order: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the top ``k`` per query by score, then ``order``."""
    sorted_ = np.lexsort((order, -scores, query))
    of = query[sorted_]
    starts = np.r_[0, np.flatnonzero(np.diff(of)) + 1] if len(of) else np.array([], dtype=int)
    place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
    return sorted_[place < k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"Vectors of different lengths: {sorted(lengths)}")
    flat = pc.list_flatten(column).to_numpy().astype(np.float64)
    return flat.reshape(len(column), lengths[0])


def _cell_top_k(side: pa.Table, asked: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The best ``k`` of one part of the corpus for each query of one block. Ids stay Arrow
    values of their own type; only their places in order are numbers."""
    if not len(side) or not len(asked):
        return schema.empty_table()
    lengths = sorted(pc.unique(pc.list_value_length(side["vector"])).to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"Vectors of different lengths: {lengths}")
    order = pc.rank(side["id"], sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
    blocks = [_matrix(asked.slice(at, QUERIES_AT_ONCE)["v"]) for at in range(0, len(asked), QUERIES_AT_ONCE)]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(blocks)
    for start in range(0, len(side), ROWS_AT_ONCE):
        vectors = _matrix(side.slice(start, ROWS_AT_ONCE)["vector"])
        for n, block in enumerate(blocks):
            scores = np.round(vectors @ block.T, SCORE_DIGITS)
            if len(scores) > k:  # everything from the k-th score up, ties included
                floor = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
                rows, cols = np.nonzero(scores >= floor)
            else:
                rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
            met = (rows + start, cols, scores[rows, cols])
            rows, cols, found = (np.concatenate(pair) for pair in zip(best[n], met))
            kept = _best(cols, order[rows], found, k)
            best[n] = rows[kept], cols[kept], found[kept]
    rows = np.concatenate([b[0] for b in best])
    of = np.concatenate([b[1] + n * QUERIES_AT_ONCE for n, b in enumerate(best)])
    columns = [asked["q"].take(pa.array(of)), asked["slot"].take(pa.array(of)), side["id"].take(pa.array(rows)), pa.chunked_array([np.concatenate([b[2] for b in best])])]
    return pa.table(columns, schema=schema)


def exact_top_k(side: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Every part of the corpus against every block of queries, as one job of bounded cells;
    only each cell's best meet in the shuffle, and nothing passes through the driver."""
    parts = max(1, -(-side.count() // ROWS_PER_PART))
    blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = side.withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int")).withColumn("block", every_block)
    right = asked.withColumn("slot", F.xxhash64("q", "v"))
    right = right.withColumn("block", F.pmod(F.col("slot"), F.lit(blocks)).cast("int")).withColumn("part", every_part)
    cells = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    result = T.StructType([
        T.StructField("query_id", asked.schema["q"].dataType), T.StructField("slot", T.LongType()),
        T.StructField("id", side.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(result)
    local = cells.applyInArrow(lambda a, b: _cell_top_k(a, b, k, schema), result)
    place = F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "id"))
    found = local.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
    return found.select("query_id", "id", "score", "rank")


# Ways to search, by name: functions of (id, vector), (q, v) and k.
STRATEGIES: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {"exact": exact_top_k}


def register_strategy(name: str, search: Callable[[DataFrame, DataFrame, int], DataFrame]) -> None:
    STRATEGIES[name] = search


def top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id: str = "id",
    vector: str = "vector",
    query_id: str = "query_id",
    strategy: str = "exact",
) -> DataFrame:
    """The ``k`` vectors of highest inner product per query, ties by id; equal queries are one.

    Ids and query ids may be null and of any type that sorts; they come back as they are.

    ``strategy`` names the search: ``exact`` compares all, others can be registered.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy}")
    side = corpus.select(F.col(id).alias("id"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull())
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    return STRATEGIES[strategy](side, asked.where(F.col("v").isNotNull()).distinct(), k)


def search_results(found: DataFrame, chunks: DataFrame, digits: int = 4) -> DataFrame:
    """Top-k ids with their chunk rows; ids without a chunk are left out.

    The found side has k rows per query, so Spark's own size estimate decides whether
    it is broadcast.
    """
    return found.withColumn("score", F.round("score", digits)).join(chunks, "id")


# ---------------------------------------------------------------- context and citations

def build_context(results: DataFrame, limit: int = CONTEXT_CHARS) -> DataFrame:
    """One context text per query: distinct, non-blank pieces by falling score, up to the
    first that would pass ``limit`` characters.

    ``results`` has ``(query_id, id, text, score, source)`` with k rows per query.
    """
    pieces = results.withColumn("_text", strip(F.col("text"))).where(F.col("_text") != "")
    by_score = [F.desc("score"), F.asc("id")]
    first = F.row_number().over(Window.partitionBy("query_id", F.sha2("_text", 256)).orderBy(*by_score))
    unique = pieces.withColumn("_copy", first).where("_copy = 1")
    along = Window.partitionBy("query_id").orderBy(*by_score).rowsBetween(Window.unboundedPreceding, 0)
    fitting = unique.withColumn("_upto", F.sum(F.length("_text")).over(along)).where(F.col("_upto") <= limit)
    block = F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("Unknown")), F.lit("]\n"), F.col("_text"))
    lists = fitting.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_upto", block.alias("b")))).alias("bs"))
    built = lists.select("query_id", F.array_join(F.transform("bs", lambda s: s["b"]), DIVIDER).alias("context"))
    return results.select("query_id").distinct().join(built, "query_id", "left").fillna("", ["context"])


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def citations(results: DataFrame, most: int = MAX_CITATIONS, excerpt_chars: int = EXCERPT_CHARS) -> DataFrame:
    """The best results per query as citations, with confidence, excerpt and document name."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    top = results.withColumn("place", place).where(F.col("place") <= most)
    page = F.col("page") if "page" in results.columns else F.lit(None).cast("int")
    return top.select(
        "query_id",
        F.col("place").cast("long").alias("place"),
        F.col("id").alias("chunk_id"),
        file_name(F.col("source")).alias("source_document"),
        page.alias("page_number"),
        F.substring(strip(F.col("text")), 1, excerpt_chars).alias("excerpt"),
        F.col("score").alias("similarity_score"),
        confidence(F.col("score")).alias("confidence"),
    )


def cited_context(cited: DataFrame, limit: int = CITED_CONTEXT_CHARS) -> DataFrame:
    """Numbered source headers with excerpts, up to ``limit`` characters of sections."""
    number = F.concat(F.lit("[Source "), F.col("place"), F.lit(": "), F.col("source_document"))
    page = F.when(F.coalesce("page_number", F.lit(0)) != 0, F.concat(F.lit(", Page "), F.col("page_number"))).otherwise("")
    sections = cited.withColumn("_section", F.concat(number, page, F.lit("]\n"), F.col("excerpt")))
    along = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fitting = sections.withColumn("_upto", F.sum(F.length("_section")).over(along)).where(F.col("_upto") <= limit)
    lists = fitting.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "_section"))).alias("ss"))
    return lists.select("query_id", F.array_join(F.transform("ss", lambda s: s["_section"]), DIVIDER).alias("context"))


def retrieval_log(found: DataFrame, k: int) -> DataFrame:
    """One row per query: how many results, and their ids by rank."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"])
    return found.groupBy("query_id").agg(F.lit(k).cast("long").alias("top_k"), F.count("*").alias("results_count"), ids.alias("result_ids"))
