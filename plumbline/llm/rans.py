"""Token ids in files: static range asymmetric numeral system with shared frequency tables.

One frequency table, counted over all ids, serves every file. Ids are cut into independent
blocks, and the ids of a block are dealt over ``LANES`` interleaved coders. Every
``STEPS_PER_CHECKPOINT`` steps a block keeps the coders' states and its place in the stream,
so decoding starts at any checkpoint and many checkpoints are decoded side by side. Tables,
segment heads and blocks carry CRC-32 checksums.

A file is a row of segments; a segment holds whole documents:

    head    magic, table checksum, documents, ids, blocks, sizes, checksum
    body    lengths of the keys (-1: null), keys, ids per document
    blocks  ids, words, checksum | states | places | words
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from plumbline.llm import bpe
from plumbline.llm.common import Written, files, shuffle_parts
from plumbline.session import work_path

MAGIC = b"PLR1"
HEAD = "<4sIQQIQI"
BLOCK = "<III"
LANES = 32
STEPS = 2048
STEPS_PER_CHECKPOINT = 512
BLOCK_IDS = LANES * STEPS
SEGMENT_IDS = 32 * BLOCK_IDS
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Table:
    """Frequencies of the ids, scaled to a power of two; every counted id keeps at least one part."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.uint32), counts[order].astype(np.float64)
        self.bits = max(12, int(len(ids)).bit_length() + 2)
        whole = 1 << self.bits
        parts = np.maximum(1, np.floor(counts * whole / max(1.0, counts.sum()))).astype(np.int64)
        excess = int(parts.sum()) - whole
        largest = np.lexsort((self.ids, -parts))
        while excess and len(parts):
            # what is over or under goes to the largest parts, at most half of each at a time
            step = np.zeros(len(parts), np.int64)
            room = np.minimum(parts[largest] // 2, max(0, excess)) if excess > 0 else np.full(len(parts), 0)
            if excess > 0:
                step[largest] = np.minimum(room, np.maximum(0, excess - (np.cumsum(room) - room)))
            else:
                step[largest[0]] = excess
            parts -= step
            excess = int(parts.sum()) - whole
        self.parts = parts.astype(np.uint32)

    @property
    def data(self) -> bytes:
        return struct.pack("<BI", self.bits, len(self.ids)) + self.ids.tobytes() + self.parts.tobytes()

    @property
    def checksum(self) -> int:
        return zlib.crc32(self.data)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Parts and the sum of the parts before, by place in ``ids``."""
        parts = self.parts.astype(np.uint64)
        return parts, np.cumsum(parts) - parts


def read_table(data: bytes) -> Table:
    out = Table.__new__(Table)
    out.bits, n = struct.unpack_from("<BI", data)
    out.ids, out.parts = np.frombuffer(data, np.uint32, 2 * n, 5).reshape(2, n)
    return out


def encode_blocks(symbols: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States at the checkpoints, words and where words were put out, for ``symbols`` of shape
    (blocks, steps, lanes)."""
    parts, before = table.arrays()
    blocks, steps, lanes = symbols.shape
    shift = np.uint64(table.bits)
    limit = np.uint64(1 << (63 - table.bits))
    state = np.full((blocks, lanes), LOW)
    states = np.zeros((blocks, -(-steps // STEPS_PER_CHECKPOINT), lanes), np.uint64)
    words = np.zeros((blocks, steps, lanes), np.uint32)
    put = np.zeros((blocks, steps, lanes), bool)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t]
        f = parts[s]
        over = state >= limit * f
        words[:, t] = state.astype(np.uint32)
        put[:, t] = over
        state = np.where(over, state >> WORD, state)
        q = state // f
        state = (q << shift) + (state - q * f) + before[s]
        if t % STEPS_PER_CHECKPOINT == 0:
            states[:, t // STEPS_PER_CHECKPOINT] = state
    return states, words, put


def decode_runs(states: np.ndarray, places: np.ndarray, words: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Symbols of shape (runs, steps, lanes); a run starts at a checkpoint with its states and
    its place in ``words``."""
    parts, before = table.arrays()
    symbol = np.repeat(np.arange(len(parts), dtype=np.uint32), table.parts)
    mask, shift = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    state, place = states.copy(), places.astype(np.int64)
    words = np.append(words, np.zeros(states.shape[1] + 1, np.uint32)).astype(np.uint64)
    out = np.empty((states.shape[0], steps, states.shape[1]), np.uint32)
    for t in range(steps):
        slot = state & mask
        s = symbol[slot]
        out[:, t] = s
        state = parts[s] * (state >> shift) + slot - before[s]
        need = state < LOW
        taken = np.cumsum(need, axis=1)
        at = np.minimum(place[:, None] + taken - 1, len(words) - 1)
        state = np.where(need, (state << WORD) | words[at], state)
        place = np.minimum(place + taken[:, -1], len(words) - 1)
    return out


def pack_segment(keys: list[str | None], counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    raw = [None if k is None else k.encode() for k in keys]
    lengths = np.array([-1 if k is None else len(k) for k in raw], np.int32)
    body = lengths.tobytes() + b"".join(k or b"" for k in raw) + counts.astype(np.int64).tobytes()
    places = np.searchsorted(table.ids, ids).astype(np.uint32)
    blocks = -(-len(places) // BLOCK_IDS)
    out = []
    for full in (True, False):
        at = slice(0, len(places) // BLOCK_IDS * BLOCK_IDS) if full else slice(len(places) // BLOCK_IDS * BLOCK_IDS, None)
        part = places[at]
        if not len(part):
            continue
        steps = STEPS if full else -(-len(part) // LANES)
        padded = np.full(-(-len(part) // (steps * LANES)) * steps * LANES, table.parts.argmax(), np.uint32)
        padded[: len(part)] = part
        states, words, put = encode_blocks(padded.reshape(-1, steps, LANES), table)
        for b in range(len(states)):
            stream = words[b][put[b]]
            passed = np.concatenate([[0], np.cumsum(put[b].sum(1))])[:steps:STEPS_PER_CHECKPOINT].astype(np.uint32)
            payload = states[b].tobytes() + passed.tobytes() + stream.tobytes()
            count = BLOCK_IDS if full else len(part)
            out.append(struct.pack(BLOCK, count, len(stream), zlib.crc32(payload)) + payload)
    head = (MAGIC, table.checksum, len(keys), len(ids), blocks, len(body))
    return struct.pack(HEAD, *head, zlib.crc32(body)) + body + b"".join(out)


def unpack_segment(data: bytes, table: Table, first: int = 0, last: int | None = None) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Keys, ids per document, and the ids ``first`` to ``last`` of the segment; only the
    checkpoints that these need are decoded."""
    magic, checksum, docs, total, blocks, size, crc = struct.unpack_from(HEAD, data)
    body = data[struct.calcsize(HEAD) : struct.calcsize(HEAD) + size]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a segment, or a damaged one")
    if checksum != table.checksum:
        raise ValueError("the segment was written with another frequency table")
    lengths = np.frombuffer(body, np.int32, docs)
    ends = 4 * docs + np.cumsum(np.maximum(lengths, 0))
    keys = [None if n < 0 else body[e - n : e].decode() for n, e in zip(lengths.tolist(), ends.tolist())]
    counts = np.frombuffer(body, np.int64, docs, len(body) - 8 * docs)
    last = total if last is None else min(last, total)
    out = np.empty(total, np.uint32)
    runs: dict[int, list] = {}
    at, begin, per = struct.calcsize(HEAD) + size, 0, STEPS_PER_CHECKPOINT * LANES
    for _ in range(blocks):
        count, n_words, crc = struct.unpack_from(BLOCK, data, at)
        steps = -(-count // LANES)
        marks = -(-steps // STEPS_PER_CHECKPOINT)
        length = marks * (8 * LANES + 4) + 4 * n_words
        payload = data[at + struct.calcsize(BLOCK) : at + struct.calcsize(BLOCK) + length]
        at += struct.calcsize(BLOCK) + length
        if begin < last and begin + count > first:
            if zlib.crc32(payload) != crc:
                raise ValueError(f"the block at id {begin} is damaged")
            states = np.frombuffer(payload, np.uint64, marks * LANES).reshape(marks, LANES)
            places = np.frombuffer(payload, np.uint32, marks, 8 * marks * LANES)
            words = np.frombuffer(payload, np.uint32, n_words, marks * (8 * LANES + 4))
            for m in range(marks):
                low = begin + m * per
                if low < last and low + per > first:
                    stop = places[m + 1] if m + 1 < marks else n_words
                    runs.setdefault(min(STEPS_PER_CHECKPOINT, steps - m * STEPS_PER_CHECKPOINT), []).append((low, min(per, begin + count - low), states[m], words[places[m] : stop]))
        begin += count
    for steps, same in runs.items():
        words = np.concatenate([w for *_, w in same])
        starts = np.cumsum([0] + [len(w) for *_, w in same])[:-1]
        found = table.ids[decode_runs(np.stack([s for _, _, s, _ in same]), starts, words, steps, table)].reshape(len(same), -1)
        for (low, n, *_), row in zip(same, found):
            out[low : low + n] = row[:n]
    return keys, counts, out[first:last]


def write_ids(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY, end_id: int = bpe.END_ID) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids below ``folder`` in
    ascending order of the id. Returns the written index of segments:
    ``(path, offset, length, start, part, segment)``, where ``start`` counts all ids before.

    Null texts count as empty, null ids come first, rows of equal id follow each other in any
    order and all stay. Other columns are not read. An empty table writes a frequency table
    of no ids and no segments.
    """
    spark = df.sparkSession
    size = Tokenizer.from_file(vocabulary).get_vocab_size()
    kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    id_type = df.schema[id_col].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.split_batches(batches, "text"):
            ids, counts = bpe.with_end(*bpe.encode(batch.column("text"), vocabulary, names_as_text=False), end_id)
            data = ids.astype(kind)
            ends = np.concatenate([[0], np.cumsum(counts) * kind.itemsize]).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), packed.cast(pa.binary())], ["id", "row", "ids"])

    tokens = Written(rows.mapInArrow(tokenize, f"id {id_type}, row bigint, ids binary"), "ids", "zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    # one row per id of the vocabulary
    counted = tokens.df.select("ids").mapInArrow(count, "symbol int, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    table = Table(counted["symbol"].to_numpy(np.int64), counted["n"].to_numpy(np.int64))
    fs, root = files(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/table") as out:
        out.write(table.data)
    data = table.data

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_table(data)
        where = f"{folder}/{uuid.uuid4().hex}.ids"
        part, segment, at, start, held, out = TaskContext.get().partitionId(), 0, 0, 0, [], None
        ids_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, at, start, held, out, ids_held
            fs, name = files(where)
            out = out or fs.open_output_stream(name)
            ids = [np.frombuffer(d, kind) for _, d in held]
            packed = pack_segment([k for k, _ in held], np.array([len(i) for i in ids]), np.concatenate(ids), table)
            out.write(packed)
            row = {"path": where, "offset": at, "length": len(packed), "ids": ids_held, "before": start, "part": part, "segment": segment}
            segment, at, start, held, ids_held = segment + 1, at + len(packed), start + ids_held, [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.string() if k == "path" else pa.int64()) for k in row]))

        for batch in batches:
            for key, ids in zip(batch.column("id").to_pylist(), batch.column("ids")):
                held.append((None if key is None else str(key), ids.as_py()))
                ids_held += len(held[-1][1]) // kind.itemsize
                if ids_held >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()
        if out:
            out.close()

    order = [F.asc_nulls_first("id"), F.asc("row")]
    ordered = tokens.df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    index = Written(ordered.mapInArrow(write, "path string, offset bigint, length bigint, ids bigint, before bigint, part bigint, segment bigint"), "ids-index").df
    tokens.delete()
    # one row per written file
    ahead = index.groupBy("part").agg(F.sum("ids").alias("_ids"))
    ahead = ahead.select(F.col("part").alias("_part"), (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_ahead"))
    placed = index.join(ahead, F.col("part") == F.col("_part"))
    return placed.select("path", "offset", "length", (F.col("_ahead") + F.col("before")).alias("start"), "part", "segment")


def read_ids(index: DataFrame, folder: str, id_type: str = "bigint", ids: bool = False) -> DataFrame:
    """Every document from the files: ``(id, start, n_tokens, ids_crc32)`` and, if asked for,
    its ``ids``. ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    A segment is read by one task; damage is an error."""
    fs, root = files(folder)
    with fs.open_input_file(f"{root}/table") as file:
        data = file.read()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_table(data)
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = files(row["path"])
                with fs.open_input_file(name) as file:
                    keys, counts, found = unpack_segment(file.read_at(row["length"], row["offset"]), table)
                ends = np.cumsum(counts)
                raw = memoryview(found.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                out = [pa.array(keys, pa.string()), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                if ids:
                    out.append(pa.array([found[e - n : e].astype(np.int64) for e, n in zip(ends, counts)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = "id string, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    spread = index.select("path", "offset", "length", "start").repartition(shuffle_parts(index.sparkSession), "path", "offset")
    return spread.mapInArrow(read, schema).withColumn("id", F.col("id").cast(id_type))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of all texts written to the shared folder and read back."""
    folder = work_path(df.sparkSession, "token-files")
    index = write_ids(df, folder, id_col, text_col)
    return read_ids(index, folder, df.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
