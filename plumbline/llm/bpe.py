"""Token ids of whole texts by the tokenizers library, in Arrow batches inside tasks.

A byte-level tokenizer splits a text before the merges, and never across a blank between two
words. So each task cuts texts at blanks, asks the library once for every piece it has not
met, and puts the ids together from its memory. Texts in which blanks stand inside longer
white space are given to the library whole. The ids are those of the whole text either way.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from plumbline.llm.common import remembered

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
MOST_PIECES = 400_000
TEXT_BYTES_AT_ONCE = 4 << 20
CLOSING = ".,;:!?"
LAST_LATIN = "ɏ"


def byte_characters() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte: itself if it
    is printable in Latin-1, else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in out]
    return out | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


class Pieces:
    """Ids of pieces of text that follow a blank, remembered up to ``MOST_PIECES`` pieces."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = byte_characters()
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = array("I")
        self.ends = array("q", [0])
        self.closing: dict[str, list[int]] = {}

    def forget(self, kept: int) -> None:
        """Drop all but the ``kept`` pieces met first; common ones are met early."""
        while len(self.code) > kept:
            self.code.popitem()
        del self.ends[kept + 1 :]
        del self.ids[self.ends[kept] :]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, text: str) -> list[int]:
        """Ids of a text that the splitter leaves in one part."""
        if text.isascii() and text.isprintable() and " " not in text[1:]:
            text = "Ġ" + text[1:] if text[0] == " " else text
        else:
            text = text.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(text)]

    def _word(self, piece: str, lead: str) -> list[int] | None:
        """Ids of letters and closing marks after ``lead``; None for any other piece."""
        word = piece.rstrip(CLOSING)
        # letters up to U+024F are one part with a blank before them, closing marks another
        if not word.isalpha() or max(word) > LAST_LATIN:
            return None
        if word == piece:
            return self._merged(lead + word)
        mark = piece[len(word) :]
        if mark not in self.closing:
            self.closing[mark] = self._merged(mark)
        known = self.code.get(word) if lead else None
        if known is not None:
            return self.ids[self.ends[known] : self.ends[known + 1]].tolist() + self.closing[mark]
        return self._merged(lead + word) + self.closing[mark]

    def after_blank(self, piece: str) -> list[int]:
        ids = self._word(piece, " ")
        if ids is None and piece.count("\n") == 1:  # a line break between two words is a part of its own
            first, _, second = piece.partition("\n")
            left, right = self._word(first, " "), self._word(second, "")
            if left is not None and right is not None:
                ids = left + self._merged("\n") + right
        return self.whole(" " + piece) if ids is None else ids

    def codes(self, pieces: list[str]) -> np.ndarray:
        code, ids, ends = self.code, self.ids, self.ends
        found = list(map(code.get, pieces))
        for n, c in enumerate(found):
            if c is None:
                found[n] = code[pieces[n]] = len(ends) - 1
                ids.extend(self.after_blank(pieces[n]))
                ends.append(len(ids))
        return np.array(found, np.int64)


def pieces_of(path: str) -> Pieces:
    """One memory per Python worker and vocabulary; workers serve many tasks."""
    return remembered(("pieces", path), lambda: Pieces(path))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def encode(texts: pa.Array, path: str = VOCABULARY, names_as_text: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned 32 bit) of all texts in a row, and the number of ids of each; a null text
    has none. The name of an added token in a text is ordinary text or, without
    ``names_as_text``, that token's id, as by the library's defaults."""
    known = pieces_of(path)
    known.tokenizer.encode_special_tokens = names_as_text
    kept = len(known.code)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.split_pattern(texts, " ")
    offsets = np.asarray(parts.offsets)
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    first = offsets[:-1] - offsets[0]
    is_first = np.zeros(len(index), bool)
    is_first[first] = True
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    odd = np.array([not p or p[0].isspace() for p in pieces], bool)
    plain = np.ones(len(texts), bool)
    plain[owner[odd[index] & ~is_first]] = False
    for name in [] if names_as_text else known.added:  # its text is the library's, so no piece holds a name
        plain &= ~pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
    used = np.zeros(len(pieces), bool)
    used[index[~is_first & plain[owner]]] = True
    code = np.zeros(len(pieces), np.int64)
    code[used] = known.codes([p for p, u in zip(pieces, used.tolist()) if u])
    all_ids = np.frombuffer(known.ids, np.uint32)
    ends = np.frombuffer(known.ends, np.int64)
    body = np.flatnonzero(~is_first & plain[owner])
    length = np.zeros(len(index), np.int64)
    length[body] = (ends[code + 1] - ends[code])[index[body]] if len(body) else 0
    # the first piece of a text, or a text that is not plain, goes to the library as it is
    opening = [known.whole(pieces[i]) if p else known.whole(t) for p, i, t in zip(plain.tolist(), index[first].tolist(), _texts(texts, plain))]
    length[first] = [len(o) for o in opening]
    out = np.empty(int(length.sum()), np.uint32)
    begin = np.cumsum(length) - length
    out[_gather(begin[body], length[body])] = all_ids[_gather(ends[code[index[body]]], length[body])]
    if opening:
        out[_gather(begin[first], length[first])] = np.array([i for o in opening for i in o], np.uint32)
    counts = np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64)
    del all_ids, ends  # the memory may change again
    if kept >= MOST_PIECES:
        known.forget(kept)
    return out, counts


def _texts(texts: pa.Array, plain: np.ndarray) -> list[str | None]:
    """The texts that are not plain, in their places."""
    out: list[str | None] = [None] * len(texts)
    for at in np.flatnonzero(~plain).tolist():
        out[at] = texts[at].as_py()
    return out


def split_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about ``TEXT_BYTES_AT_ONCE`` of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            till = max(at + 1, int(np.searchsorted(size, done + TEXT_BYTES_AT_ONCE, "right")))
            yield batch.slice(at, till - at)
            at = till


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each text's, and the numbers that follow."""
    stops = np.cumsum(counts)
    return np.insert(ids, stops, end_id).astype(np.uint32), counts + 1
