"""Text expressions: cleaning, Markdown and HTML to plain text, sizes and file names."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns. (?U) makes Java classes Unicode-aware.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MIN_LINE = 3
MARKDOWN = (
    (r"(?U)#{1,6}\s*", ""),
    (r"\*{1,2}([^*]+)\*{1,2}", "$1"),
    (r"`{1,3}[^`]*`{1,3}", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
)
HTML_DROPPED = ("script", "style", "nav", "footer", "header")
HTML_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
             "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer")
HTML_VERBATIM = ("pre", "textarea")
CHARS_PER_TOKEN = 4
UNNAMED = "Unknown Document"
TEXT_BYTES_AT_ONCE = 4 << 20


def text_slices(texts: pa.Array, most: int = TEXT_BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with about ``most`` bytes of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, till - at
        at = till


@F.arrow_udf(T.StringType())
def _decompose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = (texts.slice(*s).to_pylist() for s in text_slices(texts))
        found = [pa.array([None if t is None else unicodedata.normalize("NFKD", t) for t in p], texts.type) for p in parts]
        yield pa.concat_arrays(found) if found else texts


def decomposed(text: Column) -> Column:
    """NFKD form. Only texts with a non-ASCII character travel to Python."""
    return F.coalesce(_decompose(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def clean_text(text: Column) -> Column:
    """Normalised text without control characters, page debris and runs of blanks.

    The order of the steps is part of the result: blank lines are limited before short
    lines are removed, so longer gaps can come back.
    """
    text = F.regexp_replace(decomposed(text), CONTROL, "")
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"(?U)\s+\z", ""))
    lines = F.filter(lines, lambda line: (line == "") | (F.length(strip(line)) > MIN_LINE))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]{2,}", " "))


def markdown_text(text: Column) -> Column:
    """Markdown without heading marks, emphasis, code spans and link targets."""
    for pattern, replacement in MARKDOWN:
        text = F.regexp_replace(text, pattern, replacement)
    return text


class _Page(HTMLParser):
    """Text nodes and title of one page, outside dropped elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[str] = []
        self.pending: list[str] = []
        self.title: list[str] | None = None
        self.title_done = False

    def flush(self):
        data = "".join(self.pending)
        self.pending = []
        if not data or any(t in HTML_DROPPED for t in self.open):
            return
        if not data.strip(" \t\n\r\f") and not any(t in HTML_VERBATIM for t in self.open):
            data = "\n" if "\n" in data else " "
        self.nodes.append(data)
        if "title" in self.open and not self.title_done:
            self.title = (self.title or []) + [data]

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in HTML_VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.open:
            last = len(self.open) - 1 - self.open[::-1].index(tag)
            if "title" in self.open[last:] and self.title is not None:
                self.title_done = True
            del self.open[last:]

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def unknown_decl(self, data):
        self.flush()

    def handle_pi(self, data):
        self.flush()


def page_text(html: str) -> tuple[str, str]:
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    title = page.title[0] if page.title and len(page.title) == 1 else ""
    return title, "\n".join(page.nodes)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def html_text(pages: pd.Series) -> pd.DataFrame:
    """Title and text of HTML pages; nested and unclosed tags need a real tokenizer."""
    return pd.DataFrame([(None, None) if p is None else page_text(p) for p in pages], columns=["title", "text"])


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def file_name(path: Column) -> Column:
    """Last part of a path with either slash; a name for the nameless."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(F.coalesce(path, F.lit("")) == "", UNNAMED).otherwise(name)


def suffix(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, with the dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\.](\.[^./\\]+)$", 1))
