"""Near-duplicate vectors by an inverted multi-index.

Two independent codebooks, one for each half of the unit vectors, form a product grid of
cells. Every vector is filed in one cell and traverses the cells around it by two sequences,
one per half, sorted by a lower bound on the distance to the codewords' regions. The sum of
both bounds grows along the traversal, which stops where it passes the budget. The vectors
of the visited cells are then compared in double precision.

A bound is the distance from the vector to the plane midway between its nearest codeword
and the cell's, so no vector of the cell can be closer. With the budget ``2 - 2 * threshold``,
the squared distance of the least similar pair that links, every link would be found, at the
price of nearly all cells; ``target_recall`` below 1 stops earlier (``budget_for``). A link is
found if either of its vectors visits the other's cell, and then counts for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Written, group_starts, merge_labels
from plumbline.llm.components import components

SAMPLE_ROWS = 8192
ROWS_PER_CELL = 64
MOST_CODEWORDS = 512
BASES_PER_GROUP = 4096
SLACK = 1e-9
PAIRS_AT_ONCE = 1 << 20
PROBES_AT_ONCE = 256
VISITS_AT_ONCE = 1 << 22
ROWS_SENT_AT_ONCE = 1 << 16
BUDGET_STEPS = 1 << 16
BUDGET_ROWS = 64


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; never null."""
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(whole, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter vectors padded with zeros."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for chunk in chunks:
        ends = np.asarray(chunk.offsets)
        flat = chunk.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(ends)
        if len(lengths) and (lengths == size).all():
            parts.append(flat[ends[0] : ends[-1]].reshape(-1, size).astype(np.float64))
            continue
        out = np.zeros((len(lengths), size))
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], lengths)
        out[row, at] = flat[ends[0] : ends[-1]]
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, size))


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means of a bounded sample; the first codewords are distinct sample points."""
    points_once = np.unique(points, axis=0)
    size = min(size, len(points_once))
    words = points_once[np.random.default_rng(0).permutation(len(points_once))[:size]].copy()
    for _ in range(rounds):
        near = nearest(points, words)
        count = np.bincount(near, minlength=size)
        total = np.zeros_like(words)
        np.add.at(total, near, points)
        used = count > 0
        words[used] = total[used] / count[used, None]
    return np.unique(words, axis=0)


def squared(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points * points).sum(1)[:, None] - 2 * points @ words.T + (words * words).sum(1)


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return squared(points, words).argmin(1)


class Grid:
    """The product grid: two codebooks and the bounds from a point to their regions."""

    def __init__(self, sample: np.ndarray, codewords: int) -> None:
        self.half = sample.shape[1] // 2
        self.books = [codebook(part, codewords) for part in self.halves(sample)]
        self.apart = [np.sqrt(np.maximum(squared(b, b), 0)) for b in self.books]

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, : self.half], points[:, self.half :]

    def home(self, points: np.ndarray) -> np.ndarray:
        a, b = (nearest(p, w) for p, w in zip(self.halves(points), self.books))
        return a * len(self.books[1]) + b

    def bounds(self, points: np.ndarray) -> list[np.ndarray]:
        """Per half and codeword, the squared distance to its region or less."""
        out = []
        for part, words, apart in zip(self.halves(points), self.books, self.apart):
            far = squared(part, words)
            own = far.argmin(1)
            gap = far - far[np.arange(len(part)), own][:, None]
            between = apart[own]
            plane = np.divide(gap, 2 * between, out=np.zeros_like(gap), where=between > 0)
            out.append(plane * plane)
        return out

    def bound_to(self, points: np.ndarray, cells: np.ndarray) -> np.ndarray:
        first, second = self.bounds(points)
        at = np.arange(len(points))
        return first[at, cells // len(self.books[1])] + second[at, cells % len(self.books[1])]

    def traverse(self, points: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell of every visit, by both sequences from the nearest codewords outward."""
        first, second = self.bounds(points)
        order = [np.argsort(b, axis=1, kind="stable") for b in (first, second)]
        first, second = (np.take_along_axis(b, o, 1) for b, o in zip((first, second), order))
        rows, cells = [], []
        for a in range(first.shape[1]):
            outer = np.flatnonzero(first[:, a] <= budget)
            if not len(outer):
                break
            for b in range(second.shape[1]):
                outer = outer[first[outer, a] + second[outer, b] <= budget]
                if not len(outer):
                    break
                rows.append(outer)
                cells.append(order[0][outer, a] * len(self.books[1]) + order[1][outer, b])
        return np.concatenate(rows), np.concatenate(cells)


def budget_for(grid: Grid, sample: np.ndarray, threshold: float, target_recall: float) -> float:
    """Where the traversal stops: the smallest budget that finds the target share of links.

    Of a step of squared length ``d`` in a random direction of ``n`` dimensions, the part along
    two directions, as the two bounds take, has a known distribution (beta, with parameters 1
    and ``n / 2 - 1``); ``d`` is taken for the least similar pair that links. The links within the
    sample, each vector's with equal weight, can only raise the budget. They are counted by the
    step of the budget they need, a few rows at a time, however many they are.
    """
    exact = 2 - 2 * threshold + SLACK
    if target_recall >= 1 or sample.shape[1] <= 2:
        return exact
    share = 1 - (1 - target_recall) ** (2 / (sample.shape[1] - 2))
    homes = grid.home(sample)
    cells = np.stack([homes // len(grid.books[1]), homes % len(grid.books[1])])
    first, second = grid.bounds(sample)
    weights = np.zeros(BUDGET_STEPS)
    for at in range(0, len(sample), BUDGET_ROWS):
        near = sample[at : at + BUDGET_ROWS] @ sample.T >= threshold
        near[np.arange(len(near)), at + np.arange(len(near))] = False
        a, b = np.nonzero(near)
        weight = 1 / near.sum(1)[a]
        a += at
        there = first[a, cells[0][b]] + second[a, cells[1][b]]
        back = first[b, cells[0][a]] + second[b, cells[1][a]]
        step = np.minimum(np.minimum(there, back) * (BUDGET_STEPS / exact), BUDGET_STEPS - 1).astype(np.int64)
        weights += np.bincount(step, weight, BUDGET_STEPS)
    seen = 0.0
    if weights.any():
        passed = np.cumsum(weights) / weights.sum()
        seen = (min(int(np.searchsorted(passed, target_recall)), BUDGET_STEPS - 1) + 1) * exact / BUDGET_STEPS
    return min(exact, max(exact * share, seen + SLACK))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, target_recall: float = 0.99) -> DataFrame:
    """One row ``(<id>, n_links, component_id, kept)`` per row of ``df``.

    Rows link if the cosine of their vectors is at least ``threshold`` (above 0).
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    that links reach, and ``kept`` says that it is the row's own. Equal vectors are compared
    once and counted as often as they occur. A vector that is null, empty or zero, or holds a
    null or a non-finite component links with nothing and is kept. Vectors of different
    length are compared as if padded with zeros. A null id takes part in links, is never the
    smallest, and is kept only where its vector links with nothing. Other columns are not
    read. Empty tables give no rows.

    Codebooks are fitted on at most ``SAMPLE_ROWS`` distinct vectors (those of smallest
    hash); every row is filed. A cell's vectors are split into groups of ``BASES_PER_GROUP``,
    and links leave as counts and spanning links, never as all pairs. A ``target_recall`` of 1
    finds every link.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    valid = rows.where(finite(F.col("_vector")) & F.exists("_vector", lambda x: x != 0))
    once = valid.groupBy("_vector").agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("first"))
    nodes = Written(once.withColumn("node", F.monotonically_increasing_id()), "vectors").df
    count, size = nodes.agg(F.count(F.lit(1)), F.max(F.size("_vector"))).first()
    id_type = df.schema[id_col].dataType.simpleString()
    if not count:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = nodes.select("_vector").orderBy(F.xxhash64("_vector"), "_vector").limit(SAMPLE_ROWS).toArrow()
    known = unit(matrix(sample.column(0), size))
    codewords = int(min(MOST_CODEWORDS, max(2, (count / ROWS_PER_CELL) ** 0.5)))
    grid = Grid(known, codewords)
    budget = budget_for(grid, known, threshold, target_recall)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = grid.home(unit(matrix(batch.column("_vector"), size)))
            yield batch.append_column("cell", pa.array(cells.astype(np.int64)))

    vector_type = nodes.schema["_vector"].dataType.simpleString()
    filed = Written(nodes.mapInArrow(file, f"_vector {vector_type}, copies bigint, first {id_type}, node bigint, cell bigint"), "cells").df
    # one row per cell of the grid, at most MOST_CODEWORDS ** 2 of them
    parts = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BASES_PER_GROUP).cast("int").alias("parts"))

    # a piece of probes may visit every cell
    at_once = max(1, min(PROBES_AT_ONCE, VISITS_AT_ONCE // (len(grid.books[0]) * len(grid.books[1]))))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                piece = batch.slice(at, at_once)
                rows, cells = grid.traverse(unit(matrix(piece.column("_vector"), size)), budget)
                for low in range(0, len(rows), ROWS_SENT_AT_ONCE):
                    sent = slice(low, low + ROWS_SENT_AT_ONCE)
                    out = piece.take(pa.array(rows[sent]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells[sent]), out.column("_vector"), out.column("copies"), out.column("node"), out.column("cell")], ["cell", "_vector", "copies", "node", "home"])

    probes = filed.mapInArrow(visit, f"cell bigint, _vector {vector_type}, copies bigint, node bigint, home bigint")
    probes = probes.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    based = filed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    both = probes.select("cell", "part", F.lit(1).alias("probe"), "_vector", "copies", "node", "home").unionByName(
        based.select("cell", "part", F.lit(0).alias("probe"), "_vector", "copies", "node", F.col("cell").alias("home"))
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        held: list[tuple] = []
        bases = weight = names = label = first_bounds = second_bounds = None
        for batch in batches:
            cells, part, probe = (batch.column(c).to_numpy() for c in ("cell", "part", "probe"))
            vectors = unit(matrix(batch.column("_vector"), size))
            copies, node, home = (batch.column(c).to_numpy() for c in ("copies", "node", "home"))
            first, length = group_starts((cells * (1 << 20) + part) * 2 + probe)
            for at, n in zip(first.tolist(), length.tolist()):
                here = slice(at, at + n)
                if key != (cells[at], part[at]):
                    key, held, bases = (cells[at], part[at]), [], None
                if not probe[at]:
                    held.append((vectors[here], copies[here], node[here]))
                    continue
                if bases is None:
                    if not held:
                        continue
                    bases, weight, names = (np.concatenate(x) for x in zip(*held))
                    label = np.arange(len(names))
                    # per base, not per pair: pairs are many more where vectors are near copies
                    first_bounds, second_bounds = grid.bounds(bases)
                step = max(1, PAIRS_AT_ONCE // len(names))
                for low in range(at, at + n, step):
                    sent = slice(low, min(low + step, at + n))
                    p, b = np.nonzero(vectors[sent] @ bases.T >= threshold)
                    ok = node[sent][p] != names[b]
                    p, b = p[ok], b[ok]
                    if not len(p):
                        continue
                    # a base that does not visit the probe's cell has its link counted here
                    theirs = home[sent][p]
                    blind = first_bounds[b, theirs // len(grid.books[1])] + second_bounds[b, theirs % len(grid.books[1])] > budget
                    other = np.bincount(b[blind], weights=copies[sent][p[blind]], minlength=len(names)).astype(np.int64)
                    met = np.flatnonzero(other)
                    hit, where = np.unique(p, return_index=True)
                    links = np.bincount(p, weights=weight[b])[hit].astype(np.int64)
                    lead = np.repeat(b[where], np.diff(np.append(where, len(p))))
                    before = label.copy()
                    merge_labels(label, lead, b)
                    moved = np.flatnonzero(label != before)
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(np.concatenate([node[sent][hit], names[moved], names[met]])),
                        "b": pa.array(np.concatenate([names[b[where]], names[label[moved]], names[met]])),
                        "links": pa.array(np.concatenate([links, np.zeros(len(moved), np.int64), other[met]])),
                    })

    found = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "probe").mapInArrow(link, "a bigint, b bigint, links bigint")
    found = Written(found, "vector-links").df
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots, _ = components(found.select("a", "b"))
    named = filed.select("node", "_vector", "copies", "first").join(roots, "node", "left").join(counts, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "root").select("_vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("_valid"))
    out = rows.join(named, "_vector", "left")
    alone = F.coalesce("n_links", F.lit(0)).cast("long")
    component = F.when(F.col("_valid"), F.col("component_id")).otherwise(F.col("_id"))
    kept = F.when(alone == 0, F.lit(True)).otherwise(F.coalesce(F.col("_id") == component, F.lit(False)))
    return out.select(F.col("_id").alias(id_col), alone.alias("n_links"), component.alias("component_id"), kept.alias("kept"))
