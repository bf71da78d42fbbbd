"""Language by cross-parsing entropy.

For each language, a suffix automaton of labelled text holds every substring of that text.
A text is parsed against it from left to right into longest matches: a phrase ends where the
automaton has no further step, and the next phrase starts there. The fewer phrases a text
needs, times the bits that point into the reference text, the more likely the language.

The automata are built from a bounded sample per language. Texts are parsed whole. For speed
the segments of a text are parsed side by side as if a phrase began with each; then every
segment is parsed again from the state its predecessor ends in, up to the first phrase that
begins where one did before, as all that follows is the same. So phrases run across segments,
and the count is that of a parse from the first byte to the last.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Written, fresh, smallest_draws

REFERENCE_BYTES = 60_000
SAMPLE_DOCUMENTS = 400
SEGMENT = 512
SEGMENTS_AT_ONCE = 8192
UNKNOWN = "und"


class _ToBlank(dict):
    """A table for ``str.translate`` that learns each character once."""

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code) if chr(code).isalpha() else " "
        return out


TO_BLANK = _ToBlank()


def normalised(text: str) -> bytes:
    return " ".join(text.lower().translate(TO_BLANK).split()).encode()


def automaton(data: bytes, symbols: np.ndarray) -> np.ndarray:
    """Steps of the suffix automaton of ``data``: state by symbol, -1 where there is none.

    ``symbols`` gives the column of each byte, 0 for bytes that occur nowhere.
    """
    width = int(symbols.max()) + 1
    # at most two states a byte; one flat array, as a dictionary per state takes ten times as much
    none = array("i", [-1]) * width
    steps = array("i", none)
    link, longest = array("i", [-1]), array("i", [0])
    last = 0
    for symbol in symbols[np.frombuffer(data, np.uint8)].tolist():
        current = len(link)
        steps.extend(none)
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and steps[at * width + symbol] < 0:
            steps[at * width + symbol] = current
            at = link[at]
        if at >= 0:
            target = steps[at * width + symbol]
            if longest[target] == longest[at] + 1:
                link[current] = target
            else:
                copy = len(link)
                steps.extend(steps[target * width : (target + 1) * width])
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at >= 0 and steps[at * width + symbol] == target:
                    steps[at * width + symbol] = copy
                    at = link[at]
                link[target] = link[current] = copy
        last = current
    return np.frombuffer(steps, np.int32).reshape(-1, width)


class Parser:
    """The automata of all languages over one alphabet."""

    def __init__(self, references: dict[str, bytes]) -> None:
        self.names = sorted(references)
        used = np.unique(np.frombuffer(b"".join(references.values()), np.uint8))
        self.symbols = np.zeros(256, np.uint8)
        self.symbols[used] = np.arange(1, len(used) + 1)
        tables = [automaton(references[n], self.symbols) for n in self.names] or [np.zeros((0, 1), np.int32)]
        offsets = np.cumsum([0] + [len(t) for t in tables])
        self.roots = offsets[:-1].astype(np.int64)
        # one table: a step to nowhere is -1, a byte outside the alphabet has none from any state
        self.steps = np.concatenate([np.where(t >= 0, t + o, -1) for t, o in zip(tables, offsets)]).astype(np.int32)
        self.bits = np.array([np.log2(len(references[n]) + 1) for n in self.names])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases of each text by language, shape (texts, languages)."""
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        data = self.symbols[np.frombuffer(b"".join(texts), np.uint8)]
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(lengths) - lengths)[owner] + number * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - number * SEGMENT)
        count = np.zeros((len(owner), len(self.names)), np.int64)
        state = np.zeros(count.shape, np.int64)
        # where phrases begin is kept for segments that have a predecessor only
        place = np.cumsum(number > 0) - 1
        marks = np.zeros((SEGMENT, int((number > 0).sum()), len(self.names)), bool)
        order = np.lexsort((number == 0, -size))
        for at in range(0, len(order), SEGMENTS_AT_ONCE):
            rows = order[at : at + SEGMENTS_AT_ONCE]
            count[rows], state[rows] = self._parse(data, begin[rows], size[rows], number[rows] > 0, place[rows], marks)
        if marks.size:
            self._join(data, begin, size, number, place, marks, count, state)
        total = np.zeros((len(texts), len(self.names)), np.int64)
        np.add.at(total, owner, count)
        return total

    def _parse(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, later: np.ndarray, place: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in segments sorted by falling size, each parsed from its first
        byte, and the last states."""
        flat, width = self.steps.ravel(), self.steps.shape[1]
        roots = np.repeat(self.roots[None, :], len(begin), 0)
        state = roots.copy()
        count = np.zeros(state.shape, np.int64)
        falling, kept = -size, np.flatnonzero(later)
        where = place[kept]
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(falling, -t, "left"))  # segments longer than t
            symbol = data[begin[:live] + t].astype(np.int64)[:, None]
            after = flat[state[:live] * width + symbol].astype(np.int64)
            begins = (after < 0) | (state[:live] == roots[:live])
            if begins.any():
                again = flat[roots[:live] * width + symbol]
                # a byte the reference does not have is a phrase of its own
                after = np.where(after < 0, np.where(again < 0, roots[:live], again), after)
                count[:live] += begins
                some = int(np.searchsorted(kept, live))
                marks[t, where[:some]] = begins[kept[:some]]
            state[:live] = after
        return count, state

    def _join(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray, place: np.ndarray, marks: np.ndarray, count: np.ndarray, state: np.ndarray) -> None:
        """Correct ``count`` and ``state`` in place for phrases that reach into a segment.

        All segments once side by side; those after a segment whose last state has changed are
        walked from there on, as in lines that repeat without ever meeting the other parse.
        """
        flat, width = self.steps.ravel(), self.steps.shape[1]
        alone, ends = count.copy(), state.copy()
        row, side = (x.ravel() for x in np.indices(count.shape))
        todo = number[row] > 0
        row, side = row[todo], side[todo]
        if len(row):
            now, root = state[row - 1, side], self.roots[side]
            more, fewer = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            last = np.full(len(row), -1, np.int64)  # -1: met the parse of the segment alone
            active = np.flatnonzero(now != root)
            t = 0
            while len(active):
                r, s = row[active], side[active]
                symbol = data[begin[r] + t].astype(np.int64)
                after = flat[now[active] * width + symbol].astype(np.int64)
                begins = (after < 0) | (now[active] == root[active])
                before = marks[t, place[r], s]
                apart = ~(begins & before)
                active, after, symbol = active[apart], after[apart], symbol[apart]
                more[active] += begins[apart]
                fewer[active] += before[apart]
                again = flat[root[active] * width + symbol]
                now[active] = np.where(after < 0, np.where(again < 0, root[active], again), after)
                t += 1
                done = size[row[active]] == t
                last[active[done]] = now[active[done]]
                active = active[~done]
            count[row, side] = alone[row, side] + more - fewer
            last = np.where(last < 0, ends[row, side], last)
            changed = last != state[row, side]
            state[row, side] = last
            row, side = row[changed] + 1, side[changed]
            inside = row < len(number)
            row, side = row[inside], side[inside]
            inside = number[row] > 0
            self._walk(data, begin, size, number, place, marks, count, state, alone, ends, row[inside], side[inside])

    def _walk(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, number: np.ndarray, place: np.ndarray, marks: np.ndarray, count: np.ndarray, state: np.ndarray, alone: np.ndarray, ends: np.ndarray, row: np.ndarray, side: np.ndarray) -> None:
        """Parse on, byte by byte, from the given segments until the states agree again."""
        steps, width, symbols = memoryview(self.steps.ravel()), self.steps.shape[1], memoryview(data)
        order = np.lexsort((row, side))
        at_side, through = -1, -1
        for r, s in zip(row[order].tolist(), side[order].tolist()):
            if s != at_side:
                at_side, through = s, -1
            if r <= through:
                continue
            root = int(self.roots[s])
            while True:
                now, low = int(state[r - 1, s]), int(begin[r])
                before = marks[: size[r], place[r], s].tobytes()
                more = t = 0
                met = now == root
                while not met and t < len(before):
                    symbol = symbols[low + t]
                    after = steps[now * width + symbol]
                    if after < 0 or now == root:
                        if before[t]:
                            met = True
                            break
                        more += 1
                        if after < 0:
                            after = steps[root * width + symbol]
                            after = root if after < 0 else after
                    now = after
                    t += 1
                count[r, s] = alone[r, s] + more - before[:t].count(1)
                now = int(ends[r, s]) if met else now
                changed = now != state[r, s]
                state[r, s], through, r = now, r, r + 1
                if not changed or r == len(number) or number[r] == 0:
                    break

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and spare bits of each text.

        The score compares the two shortest parses: the share of the second in their sum, 0.5
        for a draw (the language first by name is taken); 1 if one language is known. The spare
        bits are those by which the shortest parse, its last phrase not counted, falls short of
        bytes drawn alike from the alphabet: negative for a text the language does not help to
        tell. They are 0 where nothing is parsed.
        """
        plain = [normalised(t or "") for t in texts]
        known = np.flatnonzero([len(p) > 0 for p in plain])
        names, score, spare = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not len(known) or not self.names:
            return names, score, spare
        found = self.phrases([plain[i] for i in known])
        cost = (found + 0.5) * self.bits
        order = np.argsort(cost, axis=1, kind="stable")
        at = np.arange(len(known))
        best = cost[at, order[:, 0]]
        second = cost[at, order[:, 1]] if len(self.names) > 1 else np.full(len(known), np.inf)
        score[known] = np.where(np.isinf(second), 1.0, second / (best + np.where(np.isinf(second), 0, second)))
        alike = np.log2(self.symbols.max() + 1.0) * np.array([len(plain[i]) for i in known])
        spare[known] = alike - ((found - 1) * self.bits)[at, order[:, 0]]
        for i, n in zip(known.tolist(), order[:, 0].tolist()):
            names[i] = self.names[n]
        return names, score, spare


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", documents: int = SAMPLE_DOCUMENTS, reference_bytes: int = REFERENCE_BYTES) -> Parser:
    """Automata of whole labelled texts: per label those of smallest hash, at most
    ``documents`` of at most ``reference_bytes`` bytes each, until ``reference_bytes`` are reached.
    A label that has only longer texts is learned from the first ``reference_bytes`` characters of one.

    Rows without a label or a letter teach nothing. Equal texts count once.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keys = rows.groupBy("label", F.xxhash64("text").alias("key")).agg(F.max(F.octet_length("text")).alias("bytes"))
    keys = Written(keys, "language-keys").df
    short = F.col("bytes") <= reference_bytes
    counted = keys.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short")).collect()
    sizes = {r["label"]: r["short"] or r["n"] for r in counted}
    keys = keys.where(short | F.col("label").isin([r["label"] for r in counted if not r["short"]]))
    keys = smallest_draws(keys, "label", "key", documents, sizes)
    order = Window.partitionBy("label").orderBy("nth")
    keys = keys.withColumn("before", F.sum("bytes").over(order) - F.col("bytes")).where(F.col("before") < reference_bytes)
    chosen = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(keys.select("label", "key")), ["label", "key"])
    # a longer text without what is no letter, so that its beginning has letters
    part = F.substring(F.regexp_replace("text", r"\P{L}+", " "), 1, reference_bytes)
    chosen = chosen.withColumn("text", F.when(F.octet_length("text") > reference_bytes, part).otherwise(F.col("text")))
    taken = chosen.groupBy("label", "key").agg(F.first("text").alias("text")).toPandas()
    references = {}
    for label, group in taken.sort_values("key").groupby("label"):
        references[label] = b" ".join(normalised(t) for t in group["text"])
    return Parser(references)


def predict(df: DataFrame, parser: Parser, text_col: str = "text", name: str = "lang_pred", score: str = "score", spare: str | None = None) -> DataFrame:
    """``df`` with the predicted label, a score of 0 to 1 and, if named, the spare bits. ``und`` with score 0 where the
    text is null or has no letter; every other text, however short or long, is parsed whole.
    Columns of these names are replaced, all others and all rows kept."""
    model = df.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("name string, score double, spare double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        parts, size, held = [], 0, []
        for text in [*texts, None]:
            held.append(text)
            size += len(text or "")
            if size > 1 << 20:
                parts.append(model.value.judge(held))
                size, held = 0, []
        parts.append(model.value.judge(held))
        columns = [np.concatenate([np.asarray(p[n], object if n == 0 else float) for p in parts]) for n in range(3)]
        return pd.DataFrame(dict(zip(("name", "score", "spare"), columns))).iloc[: len(texts)]

    held = fresh(df, "_judged")
    out = df.withColumn(held, judged(F.col(text_col)))
    for column, part in ((name, "name"), (score, "score"), (spare, "spare")):
        if column:
            out = out.withColumn(column, F.col(held)[part])
    return out.drop(held)


def fold(id_col: str | Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as the text ''."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def held_out_predictions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """``(<id>, held_out, lang_pred, score)``: fitted on the other folds, applied to all rows."""
    out = fold(id_col, folds) == held
    parser = fit(df.where(~out), text_col, label_col)
    texts = df.select(F.col(id_col).alias("_id"), out.alias("held_out"), F.col(text_col).alias("_text"))
    return predict(texts, parser, "_text").select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score")
