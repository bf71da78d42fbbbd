"""Exact top-k by integer inner product: a ball tree per shard, searched by branch and bound.

No vector in a ball of centre ``c`` and radius ``r`` scores above ``q . c + |q| r``. A query
visits the nodes of a tree by this bound, largest first, and stops below its current k-th
score. Every query first searches its own shard; the k-th score found there bounds its
search of all the others, which only return what can still be among the best.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Written
from plumbline.llm.vectors import finite

ROWS_PER_SHARD = 8192
QUERIES_PER_GROUP = 4096
LEAF_ROWS = 64
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(vectors: pd.Series, size: int, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of every component as doubles, shorter vectors padded with zeros."""
    out = np.zeros((len(vectors), size))
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = vector
    return np.floor(scale * out)


class BallTree:
    """Balls over the rows of a matrix, split at the median between two far points."""

    def __init__(self, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(rows))
        centres, radii, self.children, self.spans = [], [], [], []
        todo = [(0, len(rows), -1)]
        while todo:
            low, high, parent = todo.pop()
            here = rows[self.order[low:high]]
            centre = here.mean(0)
            far = np.sqrt(((here - centre) ** 2).sum(1))
            at = len(centres)
            centres.append(centre)
            radii.append(far.max())
            self.children.append([])
            self.spans.append((low, high))
            if parent >= 0:
                self.children[parent].append(at)
            if high - low > leaf_rows and far.max() > 0:
                one = here[far.argmax()]
                two = here[((here - one) ** 2).sum(1).argmax()]
                middle = (high - low) // 2
                turn = np.argpartition(here @ (one - two), middle)
                self.order[low:high] = self.order[low:high][turn]
                todo += [(low, low + middle, at), (low + middle, high, at)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds per query and node, rounded up past the error of the sums."""
        length = np.sqrt((queries * queries).sum(1))[:, None]
        reach = np.sqrt((self.centres * self.centres).sum(1)) + self.radii
        return queries @ self.centres.T + length * self.radii + 1e-9 * length * reach


def scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact integer products: in doubles while every sum fits them, else in Python's integers."""
    if np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * rows.shape[1] < EXACT:
        return (rows @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [min(max(sum(int(x) * y for x, y in zip(row, whole)), LONG[0]), LONG[1]) for row in rows]


def branch_and_bound(tree: BallTree, rows: np.ndarray, ids: list, bounds: np.ndarray, query: np.ndarray, own, k: int, floor: int) -> list[tuple]:
    """The k best ``(score, id)`` by score, then smaller id (null ids last), none below ``floor``."""
    best: list[tuple] = []
    kth = floor
    todo = [(-bounds[0], 0)]
    while todo and -todo[0][0] >= kth:
        _, node = heapq.heappop(todo)
        if tree.children[node]:
            for child in tree.children[node]:
                if bounds[child] >= kth:
                    heapq.heappush(todo, (-bounds[child], child))
            continue
        at = tree.order[slice(*tree.spans[node])]
        for score, i in zip(scores(rows[at], query), at.tolist()):
            if score >= kth and ids[i] != own:
                best.append((-score, ids[i] is None, 0 if ids[i] is None else ids[i], i))
        best = sorted(best)[:k]
        if len(best) == k:
            kth = max(kth, -best[-1][0])
    return best


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` highest integer inner products of each query against all other rows:
    ``(query_id, rank, vec_id, score)``, ranks from 1, ties to the smaller id.

    Components count as ``floor(scale * x)``. ``is_query`` is a condition on ``df``; a null id
    is no query. Vectors that are null or hold null or non-finite components take no part.
    Shorter vectors count as padded with zeros; an empty vector scores 0. Rows equal in id and
    vector are one row. A query's own row is every row of its id. Scores past 64 bits stop at
    the largest or smallest long. With fewer other rows than ``k`` all are given; empty tables
    give no rows. Other columns are only read by ``is_query``.

    Rows are dealt into shards of about ``ROWS_PER_SHARD`` by hash and queries into groups of
    ``QUERIES_PER_GROUP``; a task holds one shard and one group.
    """
    rows = df.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"))
    rows = Written(rows.groupBy("id", "vector").agg(F.max("asks").alias("asks")), "search").df
    count, asked, size = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vector"))).first()
    id_type, vector_type = (rows.schema[c].dataType.simpleString() for c in ("id", "vector"))
    out = f"query {vector_type}, query_id {id_type}, id {id_type}, score bigint"
    shards, groups = max(1, -(-count // ROWS_PER_SHARD)), max(1, -(-(asked or 0) // QUERIES_PER_GROUP))
    size = size or 0

    def dealt(seed: int, n: int):
        return F.pmod(F.xxhash64("id", "vector", F.lit(seed)), F.lit(n)).cast("int")

    # pandas holds a long column with nulls as doubles, so no column sent to it has nulls
    some_id = F.coalesce("id", F.lit(0).cast(id_type))
    base = rows.select(some_id.alias("id"), F.col("id").isNull().alias("nameless"), "vector", dealt(0, shards).alias("shard"))
    queries = rows.where("asks").select(F.col("id").alias("own"), F.col("vector").alias("asked"), dealt(0, shards).alias("home"), dealt(1, groups).alias("group"), F.lit(LONG[0]).alias("floor"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            table = scaled(left["vector"], size, scale)
            ids = [None if nameless else x for x, nameless in zip(left["id"].tolist(), left["nameless"])]
            tree = BallTree(table)
            wanted = scaled(right["asked"], size, scale)
            bounds = tree.bounds(wanted)
            for n, (own, vector, floor) in enumerate(zip(right["own"], right["asked"], right["floor"])):
                for score, _, _, i in branch_and_bound(tree, table, ids, bounds[n], wanted[n], own, k, int(floor)):
                    found.append((vector, own, ids[i], -score))
        out = pd.DataFrame(found, columns=["query", "query_id", "id", "score"], dtype=object)
        return out.astype({"query_id": "Int64", "id": "Int64"}) if id_type in ("bigint", "int") else out

    def against(asking: DataFrame, spread: DataFrame) -> DataFrame:
        return spread.groupBy("shard", "group").cogroup(asking.groupBy("shard", "group")).applyInPandas(search, out)

    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    spread = base.withColumn("group", every_group)
    first = Written(against(queries.withColumn("shard", F.col("home")), spread), "search-first").df
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    known = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    known = known.select(F.col("query_id").alias("_id"), F.col("query").alias("_query"), F.col("score").alias("_kth"))
    others = queries.join(known, F.expr("own = _id and asked = _query"), "left")
    others = others.select("own", "asked", "home", "group", F.coalesce("_kth", "floor").alias("floor")).withColumn("shard", every_shard).where("shard <> home")
    merged = first.unionByName(against(others, spread)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
