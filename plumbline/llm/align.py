"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut a text into tokens whose bytes, one after another, are the text's. The
cumulative ends of each go into a dictionary from end to index. The ends both share, found by
intersecting the key sets, are sorted and slice both id lists into groups; within a slice the
tokens whose bytes overlap are linked.

Neither tokenizer has a token across a blank that stands between two words, and both cut at
every such blank. So a group never spans one, and each distinct piece after a blank is tokenized and
aligned once per worker and put together from memory. A text in which blanks stand
inside longer white space is aligned whole, by the same function.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from plumbline.llm import bpe
from plumbline.llm.common import Written, fresh, remembered

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
WITH_FALLBACK = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
MOST_PIECES = 300_000
MOST_COMMON = 1 << 18
COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def align(a_ends: list[int], b_ends: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Groups ``(first a, past a, first b, past b)`` and links ``(a, b)`` of two token
    sequences over the same bytes, given where each token ends."""
    at_a = dict(zip(a_ends, range(1, len(a_ends) + 1)))
    at_b = dict(zip(b_ends, range(1, len(b_ends) + 1)))
    groups, links = [], []
    a = b = 0
    for end in sorted(at_a.keys() & at_b.keys()):
        past_a, past_b = at_a[end], at_b[end]
        groups.append((a, past_a, b, past_b))
        while a < past_a and b < past_b:
            links.append((a, b))
            ends_first = a_ends[a] - b_ends[b]
            a += ends_first <= 0
            b += ends_first >= 0
        a, b = past_a, past_b
    return groups, links


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    tokenizer = bpe.Tokenizer.from_file(path)
    byte_of = {c: b for b, c in bpe.byte_characters().items()}
    added = set(tokenizer.get_added_tokens_decoder())
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        out.append(token.encode() if i in added else bytes(byte_of[c] for c in token))
    return out


def fallback_tokens(model: SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id of a piece vocabulary with byte fallback."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace(BLANK, " ").encode())
    return out


class Aligner:
    """Units - pieces after a blank, or whole texts - with their ids, groups and links."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = bpe.Pieces(a_path)
        self.a.tokenizer.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = byte_level_tokens(a_path), fallback_tokens(self.b)
        self.span = len(self.b_bytes)  # the key of an id pair is a * span + b
        # pieces can only be cut out at blanks if no token goes on after one
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.b_bytes)
        # nor closing marks from the letters before them if a token mixes both
        texts = [t.decode(errors="ignore") for t in self.b_bytes]
        self.marks = not any(any(c.isalpha() for c in t) and any(c in bpe.CLOSING for c in t) for t in texts)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.keys = array("q")
        self.ends = array("q", [0])
        self.counts = array("q")
        self.written: list[str] = []

    def forget(self, kept: int) -> None:
        """Drop all but the first ``kept`` units."""
        while self.code and len(self.code) > kept:
            self.code.popitem()
        del self.ends[kept + 1 :], self.counts[kept * len(COUNTED) :], self.written[kept:]
        del self.keys[self.ends[kept] :]

    def _add(self, text: str, a: list[int], b: list[int]) -> None:
        """Append the unit of ``text``."""
        a_tokens, b_tokens = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        raw = text.encode()
        if b"".join(a_tokens) == raw and b"".join(b_tokens) == raw:
            groups, links = align(list(accumulate(map(len, a_tokens))), list(accumulate(map(len, b_tokens))))
            self.keys.extend([a[i] * self.span + b[j] for i, j in links])
            self.counts.extend((len(a), len(b), len(groups), len(links)))
            a_text, b_text = list(map(str, a)), list(map(str, b))
            self.written.append(";".join([",".join(a_text[i:k]) + "|" + ",".join(b_text[j:m]) for i, k, j, m in groups]))
        else:
            self.counts.extend((0, 0, 0, 0))  # no unit of aligned bytes is without a token
            self.written.append("")
        self.ends.append(len(self.keys))

    def codes(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """The unit of each piece, and that of closing marks cut off its end or -1."""
        stems, marks = [], []
        for piece in pieces:
            stem = piece.rstrip(bpe.CLOSING) if self.marks else piece
            cut = stem != piece and stem.isalpha() and max(stem) <= bpe.LAST_LATIN
            stems.append(stem if cut else piece)
            marks.append(piece[len(stem) :] if cut else "")
        new = [p for p in dict.fromkeys(stems) if p not in self.code]
        for piece, b in zip(new, self.b.encode(new, num_threads=1) if new else []):
            self.code[piece] = len(self.written)
            self._add(" " + piece, self.a.after_blank(piece), b)
        for mark in {*marks} - {""}:
            if "\n" + mark not in self.code:  # no piece of its own begins with a line end
                self.code["\n" + mark] = len(self.written)
                self._add(mark, self.a._merged(mark), self.b.encode("x" + mark)[len(self.b.encode("x")) :])
        return [self.code[p] for p in stems], [self.code["\n" + m] if m else -1 for m in marks]

    def whole(self, text: str) -> int:
        self._add(" " + text, self.a.whole(" " + text), self.b.encode(text))
        return len(self.written) - 1

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of the texts in a row, and the text each belongs to."""
        parts = pc.split_pattern(texts, " ")
        offsets = np.asarray(parts.offsets)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_pylist()
        odd = np.array([not p or p[0].isspace() for p in pieces], bool)
        plain = np.full(len(texts), self.cuts)
        plain[owner[odd[index]]] = False
        used = np.zeros(len(pieces), bool)
        used[index[plain[owner]]] = True
        code, mark = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1, np.int64)
        code[used], mark[used] = self.codes([p for p, u in zip(pieces, used.tolist()) if u])
        unit = np.stack([code[index], mark[index]], axis=1)
        first = np.zeros(len(index), bool)
        first[offsets[:-1] - offsets[0]] = True
        for at, start in zip(np.flatnonzero(~plain).tolist(), np.flatnonzero(first)[~plain].tolist()):
            unit[start] = self.whole(texts[at].as_py()), -1
        kept = (plain[owner] | first)[:, None] & (unit >= 0)
        return unit[kept], np.repeat(owner, kept.sum(1))

    def batch(self, texts: pa.Array) -> dict[str, pa.Array]:
        known = len(self.code)
        unit, owner = self.units(pc.fill_null(texts.cast(pa.large_string()), ""))
        counts = np.frombuffer(self.counts, np.int64).reshape(-1, len(COUNTED))[unit]
        ok = np.ones(len(texts), bool)
        ok[owner[counts[:, 0] == 0]] = False  # null, empty, or other bytes
        out = {}
        for k, name in enumerate(COUNTED):
            total = np.bincount(owner, weights=counts[:, k], minlength=len(texts)).astype(np.int64)
            out[name] = pa.array(np.where(ok, total, 0))
        live = ok[owner]
        unit, owner = unit[live], owner[live]
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        parts = list(map(self.written.__getitem__, unit.tolist()))
        out["groups"] = pa.array([";".join(parts[i:j]) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.string())
        ends = np.array(self.ends, np.int64)
        length = (ends[1:] - ends[:-1])[unit]
        keys = np.array(self.keys, np.int64)[bpe._gather(ends[unit], length)]
        size = len(self.a_bytes) * self.span
        both, times = np.unique(np.repeat(owner, length) * size + keys, return_counts=True)
        edges = pa.array(np.searchsorted(both, np.arange(len(texts) + 1) * size).astype(np.int32))
        out["pairs"] = pa.ListArray.from_arrays(edges, pa.array(both % size))
        out["times"] = pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32)))
        # whole texts, the last units, are not remembered, nor pieces that came when the memory was full
        self.forget(len(self.code) if known < MOST_PIECES else known)
        return out


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One memory per Python worker and pair of vocabularies; workers serve many tasks."""
    return remembered(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def alignments(df: DataFrame, text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = WITH_FALLBACK) -> DataFrame:
    """``df`` without its text, with the alignment of each whole text in new columns.

    ``n_a, n_b, n_groups, n_links`` are counts; ``groups`` writes the groups in order as
    ``a,a|b;a|b,b``; ``pairs`` holds the text's distinct linked id pairs as ``a * size of b's
    vocabulary + b`` in rising order and ``times`` how often each is linked; ``_row`` tells rows
    apart, repeated ones too, once the result is written. Texts that are null or empty, or
    whose tokens' bytes are not a blank and the text's, have no tokens. Columns of these names in
    ``df`` are replaced, all others kept.
    """
    made = [*COUNTED, "groups", "pairs", "times", "_row"]
    text = fresh(df, "_text")
    other = [F.col(f"`{c}`") for c in df.columns if c not in made and c != text_col]
    rows = df.select(*other, F.col(text_col).alias(text))
    kept = [f for f in rows.schema if f.name != text]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner_of(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in bpe.split_batches(batches, text):
            out = {f.name: batch.column(f.name) for f in kept} | known.batch(batch.column(text))
            out["_row"] = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{n} bigint" for n in COUNTED], "groups string, pairs array<bigint>, times array<int>, _row bigint"])
    return rows.mapInArrow(each, schema)


def pair_counts(aligned: DataFrame, span: int) -> DataFrame:
    """``(pair, n_docs, best)``: in how many rows the pair is linked, and whether no pair of its
    first id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = Written(counts, "pair-counts").df
    first = F.floor(F.col("pair") / span)
    most = counts.groupBy(first.alias("_a")).agg(F.max("n_docs").alias("_most"))
    return counts.join(most, first == F.col("_a")).select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def with_pair_counts(aligned: DataFrame, a_path: str = BYTE_LEVEL, b_path: str = WITH_FALLBACK, most_common: int = MOST_COMMON) -> DataFrame:
    """The rows of ``alignments`` with ``n_best``, the links whose pair is in as many rows as
    any pair of its first id, and ``count_sum``, the sum over links of the rows that hold their pair.

    Counts cover all rows. The ``most_common`` pairs of most rows travel to the tasks as sorted
    arrays; the others, each in few rows, are joined by their key. A pair's rows count
    once each, however often they link it; repeated rows count each.
    """
    step = Written(aligned, "alignments", "zstd").df
    counts = Written(pair_counts(step, len(aligner_of(a_path, b_path).b_bytes)), "pair-counts").df
    top = counts.orderBy(F.desc("n_docs"), "pair").limit(most_common).toPandas().sort_values("pair")
    sent = step.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n_docs"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))
    kept = [f for f in step.schema if f.name not in ("pairs", "times", "groups", "n_best", "count_sum")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, n_docs, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            pair = lists.flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(common, pair), max(0, len(common) - 1))
            hit = common[at] == pair if len(common) else np.zeros(len(pair), bool)
            out = {f.name: batch.column(f.name) for f in kept}
            for name, value in (("n_best", best), ("count_sum", n_docs)):
                # float sums are exact: whole numbers far below 2^53
                out[name] = pa.array(np.bincount(owner[hit], weights=times[hit] * value[at[hit]], minlength=batch.num_rows).astype(np.int64))
            left = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=batch.num_rows))]).astype(np.int32)
            out["rare"] = pa.ListArray.from_arrays(pa.array(left), pa.array(pair[~hit]))
            out["rare_times"] = pa.ListArray.from_arrays(pa.array(left), pa.array(times[~hit]))
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n_best bigint, count_sum bigint, rare array<bigint>, rare_times array<bigint>"])
    scored = Written(step.drop("groups", "n_best", "count_sum").mapInArrow(each, schema), "alignments-scored").df
    sent.destroy()
    rare = scored.select("_row", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_times").alias("times"))))
    more = rare.join(counts, "pair").groupBy("_row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("n_docs")).alias("_sum"))
    both = scored.drop("rare", "rare_times").join(more, "_row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    return both.withColumns(added).drop("_best", "_sum", "_row")
