"""SimHash near-duplicates by anchor points.

The words of a covering code are the anchors. A fingerprint is sent to its home anchor,
which lies within the covering radius ``r``, and to every anchor within ``r`` plus the
threshold; two fingerprints within the threshold then meet at the home anchor of each, and
only there are they compared.

The code is a product over blocks of bits. If two fingerprints differ in at most ``d`` of
all bits, they differ in at most ``d // blocks`` bits of some block, so each block has a
code and a threshold of its own. A block's code is a Hamming code of ``2^m - 1`` bits
(radius 1) beside all words of its other bits (radius 0); ``check_bits=0`` takes all words
of the block, a code of radius 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Written, fresh, group_starts, merge_labels, whole_groups
from plumbline.llm.components import components

BITS = 64
SEED = 42
SHINGLES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 19
# Odd factors that spread one shingle hash into further independent words of a sketch.
SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a whole text, in blocks; repeats included."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(parts))
    first, last = starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        pairs = zip(first[at : at + SHINGLES_AT_ONCE], last[at : at + SHINGLES_AT_ONCE])
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)


def sketch(text: str | None, words: int, size: int = 1) -> np.ndarray:
    """``size`` 64-bit words; a bit is 1 if it is set in over half of the shingle hashes.
    The first word is the fingerprint; a text without words has all bits 0."""
    ones = np.zeros((size, BITS), np.int64)
    count = 0
    for hashes in shingle_hashes(text, words):
        count += len(hashes)
        for k in range(size):
            if k:
                mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(SPREAD[k - 1])
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(SPREAD[-k])
                mixed ^= mixed >> np.uint64(32)
            else:
                mixed = hashes
            bits = np.unpackbits(mixed.astype(">u8").view(np.uint8)).reshape(-1, BITS)
            ones[k] += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * ones > count, axis=1).view(">u8").ravel().astype(np.uint64)


def with_sketch(df: DataFrame, text: str, words: int, size: int, name: str) -> DataFrame:
    """``df`` and its sketches, an array of ``size`` longs. Null texts count as empty."""

    @F.pandas_udf("array<bigint>")
    def sketches(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, words, size).view(np.int64) for t in texts])

    return df.withColumn(name, sketches(F.col(text)))


def hex_digits(word) -> F.Column:
    return F.lpad(F.lower(F.hex(word)), 16, "0")


class Block:
    """One block of bits, its code and the anchors a word of it is sent to."""

    def __init__(self, shift: int, width: int, check_bits: int, threshold: int) -> None:
        self.shift, self.width = shift, width
        self.coded = (1 << check_bits) - 1 if check_bits else 0
        if self.coded > width:
            raise ValueError("the block is too narrow for this code")
        positions = np.arange(1 << self.coded, dtype=np.int64)
        self.syndrome = np.zeros(len(positions), np.int64)
        for k in range(self.coded):
            self.syndrome ^= np.where(positions >> k & 1, k + 1, 0)
        self.masks = [np.array(m, np.uint64) for m in self._masks(threshold)]

    def _masks(self, threshold: int) -> list[list[int]]:
        """For each syndrome the differences to the anchors in reach, that to the home anchor first."""
        free = range(self.coded, self.width)
        out: list[list[int]] = [[] for _ in range(self.coded + 1)]
        for weight in range(1 + threshold + 1 if self.coded else 1):
            used = max(0, weight - 1)
            for flipped in combinations(range(self.coded), weight):
                s = 0
                for k in flipped:
                    s ^= k + 1
                error = sum(1 << k for k in flipped)
                for more in range(threshold - used + 1):
                    out[s] += [error | sum(1 << k for k in rest) for rest in combinations(free, more)]
        return out

    def reach(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor and whether it is the row's home."""
        block = (words >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)
        kinds = self.syndrome[(block & np.uint64((1 << self.coded) - 1)).astype(np.int64)]
        rows, anchors, home = [], [], []
        for s, masks in enumerate(self.masks):
            at = np.flatnonzero(kinds == s)
            rows.append(np.repeat(at, len(masks)))
            anchors.append((block[at, None] ^ masks).ravel())
            first = np.zeros((len(at), len(masks)), bool)
            first[:, 0] = True
            home.append(first.ravel())
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def covering_blocks(distance: int, blocks: int, check_bits: int) -> list[Block]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return [Block(a, b - a, check_bits, distance // blocks) for a, b in zip(edges, edges[1:])]


def _linked(words: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return (np.bitwise_count(words[a] ^ words[b]) <= distance) & (a != b)


def cell_classes(cells: np.ndarray, home: np.ndarray, words: np.ndarray, distance: int) -> np.ndarray:
    """Each row's class by the links within its cell, as the class's first row.

    Homes are compared with all rows of their cell, a bounded number of pairs at a time. Only
    the classes leave: a cell of many mutual links gives one row per fingerprint, not all pairs.
    """
    label = np.arange(len(words))
    first, size = group_starts(cells)
    cell = np.repeat(np.arange(len(first)), size)
    homes = np.flatnonzero(home)
    span = size[cell[homes]]
    small = span <= PAIRS_AT_ONCE
    for at in homes[~small]:  # cells of millions: one home at a time, without its own class
        low, high = first[cell[at]], first[cell[at]] + size[cell[at]]
        for start in range(low, high, PAIRS_AT_ONCE):
            other = np.arange(start, min(start + PAIRS_AT_ONCE, high))
            other = other[label[other] != label[at]]
            mine = np.full(len(other), at)
            ok = _linked(words, mine, other, distance)
            merge_labels(label, mine[ok], other[ok])
    homes, span = homes[small], span[small]
    done = np.concatenate([[0], np.cumsum(span)])
    at = 0
    while at < len(homes):
        till = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1)
        mine, n = homes[at:till], span[at:till]
        a = np.repeat(mine, n)
        b = np.arange(n.sum()) + np.repeat(first[cell[mine]] - (done[at:till] - done[at]), n)
        ok = label[a] != label[b]
        a, b = a[ok], b[ok]
        ok = _linked(words, a, b, distance)
        merge_labels(label, a[ok], b[ok])
        at = till
    return label


def anchor_links(nodes: DataFrame, distance: int, blocks: int, check_bits: int) -> DataFrame:
    """Links ``(a, b)`` that join all nodes whose fingerprints differ in ``distance`` bits or
    fewer: per anchor a spanning set, not all pairs.

    ``nodes(node, sketch)`` has distinct rows, the fingerprint first in its sketch.
    """
    code = covering_blocks(distance, blocks, check_bits)
    sent = "cell bigint, home boolean, node bigint, word bigint"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            sketches = np.stack(batch.column("sketch").to_numpy(zero_copy_only=False)) if len(node) else np.zeros((0, 1), np.int64)
            word = sketches[:, 0]
            for k, block in enumerate(code):
                row, anchor, home = block.reach(word.view(np.uint64) if word.flags.c_contiguous else word.copy().view(np.uint64))
                out = {"cell": (np.int64(k) << np.int64(48)) | anchor.astype(np.int64), "home": home, "node": node[row], "word": word[row]}
                yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in out.items()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "cell"):
            words = group.column("word").to_numpy().view(np.uint64)
            label = cell_classes(group.column("cell").to_numpy(), group.column("home").to_numpy(), words, distance)
            joined = np.flatnonzero(label != np.arange(len(label)))
            node = group.column("node").to_numpy()
            yield pa.RecordBatch.from_pydict({"a": pa.array(node[joined]), "b": pa.array(node[label[joined]])})

    cells = nodes.mapInArrow(send, sent).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(compare, "a bigint, b bigint")


def named(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``prints(node, ...)``, its class ``root`` and ``component_id``, the smallest id
    ``_first`` of ``nodes(node, _first)`` that links reach."""
    roots, _ = components(links)
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    by_node = rooted.join(lowest, "root").select("node", "root", "component_id")
    # a fingerprint that a third of all rows share is one row on the right; adaptive
    # execution splits the left side
    return prints.join(by_node, "node")


def classes(prints: DataFrame, id_col: str, distance: int, blocks: int, check_bits: int) -> DataFrame:
    """``prints(<id>, node, sketch, ...)``, its class ``root`` and ``component_id``, the smallest
    id among all rows that links reach, the row's own included; null ids take part but are never the smallest
    (a class of null ids alone has a null ``component_id``). Equal sketches meet once."""
    nodes = prints.groupBy("node").agg(F.first("sketch").alias("sketch"), F.min(id_col).alias("_first"))
    links = anchor_links(nodes.select("node", "sketch"), distance, blocks, check_bits)
    return named(prints, nodes.select("node", "_first"), links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int = 3, check_bits: int = 4) -> DataFrame:
    """One row ``(<id>, fingerprint, component_id)`` per row of ``df``.

    Fingerprints link at ``distance`` differing bits or fewer; every such link is found.
    Whole texts; null and empty texts have fingerprint 0 and link like any other. Repeated
    rows stay rows of their own. Other columns of any name are not read. Empty tables give
    no rows. The default code sends a fingerprint to about 41 anchors.
    """
    ids = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prints = with_sketch(ids, "_text", words, 1, "sketch").select("_id", F.col("sketch")[0].alias("node"), "sketch")
    out = classes(Written(prints, "prints").df, "_id", distance, blocks, check_bits)
    return out.select(F.col("_id").alias(id_col), hex_digits(F.col("node")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int = 3, check_bits: int = 4) -> DataFrame:
    """``df`` with one document of each group of ``near_duplicates``: that with the smallest id.

    Documents link as there, by ``distance`` bits of their fingerprints or fewer. All columns
    stay. Null ids lose to any id; of equal ids the text of smaller hash stays; of rows equal
    in id and text one stays. Null and empty texts form one group.
    """
    narrow = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prints = with_sketch(narrow, "_text", words, 1, "sketch")
    prints = Written(prints.select("_id", F.xxhash64("_text").alias("_hash"), F.col("sketch")[0].alias("node"), "sketch"), "prints").df
    found = classes(prints, "_id", distance, blocks, check_bits)
    judged = found.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_rows"), F.first("root").alias("root"), F.first("component_id").alias("component_id"))
    judged = Written(judged, "rows").df
    smallest = judged.where(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_hash").alias("_best"))
    judged = judged.join(smallest, "root").withColumn("_stays", F.col("_id").eqNullSafe(F.col("component_id")) & (F.col("_hash") == F.col("_best")))
    judged = Written(judged.select(F.col("_id"), F.col("_hash"), "_rows", "_stays"), "judged").df
    mark = fresh(df, "_hash")
    hashed = df.withColumn(mark, F.xxhash64(text_col))

    def same(other: DataFrame):
        return hashed[id_col].eqNullSafe(other["_id"]) & (hashed[mark] == other["_hash"])

    gone = judged.where(~F.col("_stays"))
    again = judged.where("_stays and _rows > 1")
    if again.isEmpty():
        return hashed.join(gone, same(gone), "left_anti").drop(mark)
    more = judged.where("not _stays or _rows > 1")
    once = hashed.join(again, same(again), "left_semi").dropDuplicates([id_col, mark])
    return hashed.join(more, same(more), "left_anti").unionByName(once).drop(mark)
