"""Vector best-fit packing of token pieces into sequences, planned on counts by length.

A piece asks for three things: its tokens, one place among the documents of a sequence, and
its attention cost (the square of its length). Pieces of one length ask for the same, so
the plan needs only the number of pieces of each length: at most ``size`` numbers, whatever
the corpus. Lengths are placed from the longest down. Open sequences with equal residual
capacities form one bin class; a length goes to the best class in which it keeps every
constraint, and to new sequences if there is none. The plan says, for ranks within a length,
which sequences and which offset they get, and every piece finds its place by its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import bpe
from plumbline.llm.common import Written

SIZE = 2048
MOST_PIECES = 512
RULES = ("residual", "dot")


def capacities(size: int, most_pieces: int, most_cost: float) -> np.ndarray:
    return np.array([size, most_pieces, most_cost], np.float64)


def plan(counts: dict[int, int], size: int = SIZE, most_pieces: int = MOST_PIECES, most_cost: float | None = None, rule: str = "residual", weights: tuple[float, float, float] = (1.0, 0.1, 0.1)) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first_rank, pieces, first_sequence, per_sequence, offset)`` for all pieces.

    Rank ``r`` of a row goes to sequence ``first_sequence + (r - first_rank) // per_sequence``
    at ``offset + length * ((r - first_rank) % per_sequence)``. ``rule`` scores the classes a
    length fits in by shares of the capacities: ``residual`` takes the smallest weighted norm
    of what is left afterwards, ``dot`` the largest weighted dot product of the length's
    demand and the class's residual. Ties go to the smaller residual, then the older class.
    """
    whole = capacities(size, most_pieces, float(size * size) if most_cost is None else most_cost)
    weight = np.array(weights, np.float64)
    out: list[tuple[int, int, int, int, int, int]] = []
    classes: dict[tuple[float, float, float], list[list[int]]] = {}  # residual -> ranges (first, sequences, offset)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        ask = np.array([length, 1, float(length) ** 2])
        if (ask > whole).any():
            raise ValueError(f"a piece of {length} tokens is over the capacities of a sequence")
        while left:
            fitting = np.array([r for r in classes if r[0] >= length and r[1] >= 1 and r[2] >= ask[2]])
            if len(fitting):
                after = (fitting - ask) / whole
                if rule == "residual":
                    score = -np.sqrt((weight * after * after).sum(1))
                else:
                    score = (weight * (ask / whole) * (fitting / whole)).sum(1)
                best = np.lexsort((fitting[:, 2], fitting[:, 1], fitting[:, 0], -score))[0]
                residual = tuple(fitting[best])
                first, free, offset = classes[residual].pop()
                if not classes[residual]:
                    del classes[residual]
            else:
                residual, offset = tuple(whole), 0
                per = int(min((whole / ask).min(), left))
                first, free = opened, max(1, left // per)
                opened += free
            fits = int((np.array(residual) / ask).min())
            if left >= free:
                per = min(fits, left // free)
                bins = free
            else:
                per, bins = 1, left
            if bins < free:
                classes.setdefault(residual, []).append([first + bins, free - bins, offset])
            out.append((length, rank, bins * per, first, per, offset))
            rank, left = rank + bins * per, left - bins * per
            rest = tuple(np.array(residual) - per * ask)
            if rest[0] >= 1 and rest[1] >= 1 and rest[2] >= 1:
                classes.setdefault(rest, []).append([first, bins, offset + per * length])
    return out


def cut(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece, start and length of every piece; only documents over ``size`` are cut,
    and their first piece takes what is over whole pieces."""
    pieces = -(-counts // size)
    owner = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    opening = counts - (pieces - 1) * size
    start = np.where(number == 0, 0, opening[owner] + (number - 1) * size)
    return owner, number, start, np.where(number == 0, opening[owner], size)


def pieces_of(df: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str, end_id: int, ids: bool) -> DataFrame:
    """The pieces of all documents, each with its place among the pieces of its length that
    the same task made."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in bpe.split_batches(batches, "text"):
            all_ids, counts = bpe.with_end(*bpe.encode(batch.column("text"), vocabulary, names_as_text=False), end_id)
            owner, number, start, length = cut(counts, size)
            begin = (np.cumsum(counts) - counts)[owner] + start
            raw = memoryview(all_ids.astype("<u4").tobytes())
            spans = [raw[4 * b : 4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            run = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
            place = np.empty(len(ranked), np.int64)
            place[order] = seen[ranked] + run
            seen += np.bincount(length, minlength=size + 1)
            out = {
                "id": batch.column("id").take(pa.array(owner)),
                "piece": pa.array(number.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                "task": pa.array(np.full(len(owner), task, np.int32)),
                "place": pa.array(place),
            }
            if ids:
                out["ids"] = pa.array([all_ids[b : b + n].astype(np.int64) for b, n in zip(begin, length)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint" + ", ids array<bigint>" * ids
    return rows.mapInArrow(tokenize, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, most_pieces: int = MOST_PIECES, most_cost: float | None = None, rule: str = "residual", weights: tuple[float, float, float] = (1.0, 0.1, 0.1), vocabulary: str = bpe.VOCABULARY, end_id: int = bpe.END_ID, ids: bool = False) -> DataFrame:
    """``(<id>, piece, start, length, ids_crc32, sequence_id, offset)`` and, if asked for, the
    ``ids`` of every piece.

    A document is the ids of its whole text and ``end_id``; a null or empty text is
    ``end_id`` alone. Documents of more than ``size`` ids are cut. A sequence holds at most
    ``size`` ids, ``most_pieces`` pieces and attention cost ``most_cost`` (``size ** 2`` if
    None, which the ids alone never pass). Every row of ``df`` is packed, repeated rows and
    null ids too. Other columns are not read. Empty tables give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    pieces = Written(pieces_of(df, id_col, text_col, size, vocabulary, end_id, ids), "pieces").df
    counts = Written(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths").df
    # at most ``size`` rows reach the driver
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps: dict[int, np.ndarray] = {}
    rows = np.array(plan(totals, size, most_pieces, most_cost, rule, weights), np.int64).reshape(-1, 6)
    for length in np.unique(rows[:, 0]):
        steps[int(length)] = rows[rows[:, 0] == length][:, 1:]
    earlier = Window.partitionBy("length").orderBy("task")  # one row per task and length
    ahead = counts.select("length", "task", (F.sum("n").over(earlier) - F.col("n")).alias("ahead"))
    known = df.sparkSession.sparkContext.broadcast(steps)
    ranked = pieces.join(ahead, ["length", "task"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("place").to_numpy() + batch.column("ahead").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                part = known.value[n]
                row = part[np.searchsorted(part[:, 0], rank[at], "right") - 1]
                past = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + past // row[:, 3]
                offset[at] = row[:, 4] + n * (past % row[:, 3])
            columns = {c: batch.column(c) for c in kept}
            yield pa.RecordBatch.from_pydict({**columns, "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kept = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    fields = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.mapInArrow(settle, f"{fields}, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, ``(sequence_id, ids)``, from pieces with their ids; a
    sequence is at most ``size`` ids."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
