"""Cutting documents into chunks: fixed size, token estimate, sentences, paragraphs, recursive."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions.columns import ref
from plumbline.functions.text import CHARS_PER_TOKEN, text_slices, token_estimate

# Fixed values.
SIZE = 512
OVERLAP = 64
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")
SENTENCE_END = r"(?<=[.!?])\s+"
PARAGRAPH_END = r"\n{2,}"


def fixed_chunks(
    df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, trim_tail: bool = False
) -> DataFrame:
    """Overlapping windows of ``size`` characters as rows, without a loop or Python.

    The text is cut once into pieces of one step; a window is a few pieces joined. After
    the window that reaches the end, every later start within the overlap gives one more
    window, one character on each; ``trim_tail`` leaves those out.
    """
    step = max(1, size - overlap)
    per_window = -(-size // step)
    n = F.length(ref(text))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    base = F.greatest(F.lit(0), n - overlap)
    rows = df.where(n > 0).select(
        "*",
        n.alias("_n"),
        F.regexp_extract_all(ref(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_pieces"),
        F.substring(ref(text), base + 1, F.lit(overlap)).alias("_tail"),
        base.alias("_base"),
        F.least(last, F.floor((n - 1) / step).cast("int")).alias("_last"),
    )
    regular = F.transform(
        F.sequence(F.lit(0), F.col("_last")),
        lambda k: F.struct(
            (k * step).alias("char_start"),
            F.substring(F.array_join(F.slice("_pieces", k + 1, per_window), ""), 1, size).alias("chunk_text"),
        ),
    )
    first_tail = F.greatest(F.col("_last") * step + 1, F.col("_n") - overlap)
    tail = F.when(
        first_tail < F.col("_n"),
        F.transform(
            F.sequence(first_tail, F.col("_n") - 1),
            lambda q: F.struct(
                q.alias("char_start"), F.substring(F.col("_tail"), q - F.col("_base") + 1, F.lit(overlap)).alias("chunk_text")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<char_start:int,chunk_text:string>>"))
    chunks = regular if trim_tail else F.concat(regular, tail)
    kept = [c for c in df.columns if c != text]
    out = rows.select(*[ref(c) for c in kept], F.posexplode(chunks).alias("chunk_index", "_c"))
    chunk = F.col("_c.chunk_text")
    return out.select(
        *[ref(c) for c in kept],
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("_c.char_start").cast("long").alias("char_start"),
        (F.col("_c.char_start") + F.length(chunk)).cast("long").alias("char_end"),
        chunk.alias("chunk_text"),
        token_estimate(chunk).alias("token_estimate"),
    )


def token_chunks(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, trim_tail: bool = False) -> DataFrame:
    """Fixed windows sized in estimated tokens of four characters."""
    return fixed_chunks(df, text, size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN, trim_tail)


# ---------------------------------------------------------------- grouped units

def unit_windows(lengths: Sequence[int], size: int, carry: bool) -> Iterator[tuple[int, int, int]]:
    """Greedy windows over units joined by one separator: ``(first, stop, start)``.

    A window closes before the unit that would push it past ``size``; the next one begins
    with the last unit again if ``carry``. ``start`` counts the units before the window's
    newest unit, one separator each.
    """
    first, start, position, joined = 0, 0, 0, -1
    for i, length in enumerate(lengths):
        grown = joined + 1 + length
        if i > first and grown > size:
            yield first, i, start
            first, start = (i - 1, position) if carry else (i, position)
            grown = length + (lengths[i - 1] + 1 if carry else 0)
        elif i == first:
            start = position
        joined = grown
        position += length + 1
    if len(lengths) > first:
        yield first, len(lengths), start


def grouped(units: Sequence[str], size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Chunks ``(char_start, char_end, text)`` of consecutive units."""
    out = []
    for first, stop, start in unit_windows([len(u) for u in units], size, overlap > 0):
        joined = " ".join(units[first:stop])
        out.append((start, start + len(joined), joined))
    return out


def sentences(text: str) -> list[str]:
    return re.split(SENTENCE_END, text)


def paragraphs(text: str) -> list[str]:
    return [p for p in (part.strip() for part in re.split(PARAGRAPH_END, text)) if p]


def _exploded(df: DataFrame, text: str, cut, extra: Sequence[str] = ()) -> DataFrame:
    """Run ``cut(text) -> [(index, start, end, chunk, *extra)]`` per document, rows streaming out for a few
    megabytes of text at a time."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField(c, T.LongType()) for c in ("chunk_index", "char_start", "char_end")]
        + [T.StructField("chunk_text", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in extra]
    )
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in text_slices(batch.column(len(kept))):
                part = batch.slice(start, length)
                rows = [(n, *chunk) for n, body in enumerate(part.column(len(kept)).to_pylist()) if body for chunk in cut(body)]
                owner, *columns = zip(*rows) if rows else [()] * (1 + len(made) - len(kept))
                owner = pa.array(owner, pa.int64())
                keys = [part.column(n).take(owner) for n in range(len(kept))]
                types = [f.type for f in made][len(kept) :]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns, types)], names=made.names)

    out = df.select(*[ref(c) for c in kept], ref(text)).mapInArrow(run, schema)
    return out.withColumn("token_estimate", token_estimate(F.col("chunk_text")))


def sentence_chunks(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sentences grouped to ``size`` characters; the last one opens the next chunk too."""
    return _exploded(df, text, lambda t: [(i, *c) for i, c in enumerate(grouped(sentences(t), size, overlap)) ])


def paragraph_chunks(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return _exploded(df, text, lambda t: [(i, *c) for i, c in enumerate(grouped(paragraphs(t), size, overlap))])


# ---------------------------------------------------------------- recursive

def part_spans(text: str, separator: str) -> Iterator[tuple[int, int]]:
    """Positions of the parts between separators."""
    start = 0
    while (end := text.find(separator, start)) >= 0:
        yield start, end
        start = end + len(separator)
    yield start, len(text)


def level_pieces(text: str, size: int, level: int, origin: int) -> list[tuple | None]:
    """Pieces of one nesting level as ``(char_start, char_end, text, doc_start)``.

    Parts are merged as long as the slice from the first to the last fits. A part that
    alone is too long is cut by the next separator, with offsets relative to the part.
    None stands for a blank piece, which takes a number but gives no row.
    """
    out: list[tuple | None] = []

    def close(start: int, end: int, at_end: bool) -> None:
        body = text[start:end]
        if not body.strip():
            out.append(None)
        elif at_end:
            out.append((text.rfind(body), len(text), body.strip(), origin + start))
        else:
            found = text.find(body)
            out.append((found, found + len(body), body.strip(), origin + start))

    separator = SEPARATORS[level]
    if separator:
        spans = part_spans(text, separator)
    else:
        spans = ((i, min(i + size, len(text))) for i in range(0, len(text), size))
    opened: tuple[int, int] | None = None
    for start, end in spans:
        begin = opened[0] if opened else start
        if end - begin <= size:
            opened = (begin, end) if end > begin else None
            continue
        if opened:
            close(*opened, at_end=False)
        if end - start > size and separator:
            out += [p for p in level_pieces(text[start:end], size, level + 1, origin + start) if p]
            opened = None
        else:
            opened = (start, end) if end > start else None
    if opened:
        close(*opened, at_end=True)
    return out


def recursive_pieces(text: str, size: int = SIZE) -> list[tuple]:
    return [(i, *p) for i, p in enumerate(level_pieces(text, size, 0, 0)) if p]


def recursive_chunks(df: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """Chunks along the coarsest separator that fits, without overlap.

    ``char_start`` and ``char_end`` count within the enclosing piece, ``doc_start`` within
    the document.
    """
    return _exploded(df, text, lambda t: recursive_pieces(t, size), ["doc_start"])


STRATEGIES = {
    "recursive": lambda df, text, size, overlap: recursive_chunks(df, text, size),
    "fixed": fixed_chunks,
    "sentence": sentence_chunks,
    "paragraph": paragraph_chunks,
    "token": token_chunks,
}


def chunk(df: DataFrame, strategy: str = "recursive", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks by strategy name; an unknown name means recursive."""
    return STRATEGIES.get(strategy, STRATEGIES["recursive"])(df, text, size, overlap)
