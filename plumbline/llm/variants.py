"""Spelling variants: words one edit apart, found on a trie that is a table.

The trie's edges ``(node, label, child)`` are a distributed table, a node being the hash of the
letters above it. The frontier holds states ``(word, position, node, edits)``. Level by level it
is joined with the edges of that depth: a state without an edit goes on along its own letter,
and along any other edge as a replaced or an inserted letter; a state with an edit goes on along
its word's next letter only. A state that ends with one edit at the end of a word makes a
neighbour.

Three things keep the frontier small and lose nothing. There is one trie per length of the
word reached, so letters are replaced in the word's own length and inserted in the next one; a
deleted letter is an inserted one seen from the other word. Every word stands in a forward and
in a reversed trie, and edits are only tried in the half furthest from the root, where few
edges leave a node: an edit in one half of a word is in the far half of one of the two.
And a word's own path is its frontier without an edit, so it is read, not joined.

Words longer than ``LONG`` letters have, behind each edit, one edge for all that is left of
the word, labelled by its hash. Links are checked letter by letter at the end, so equal hashes
never make one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Written, delete_path

LONG = 40
LETTERS_AT_ONCE = 1 << 17
ODD_FACTOR = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
REPLACE, INSERT = 0, 1
END = 0  # label of the edge from a word's last letter; its child is the word


# ---------------------------------------------------------------- words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(df: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int, slip_every: int | None) -> DataFrame:
    """``(word, n)``: letter runs of whole texts, only A-Z lower-cased, of at least ``least_letters``
    code points and ``least_count`` occurrences. With ``slip_every`` a run loses the letter its
    hash with the id names if that number divides the hash."""
    runs = F.regexp_extract_all(text_col, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_letters},}}"), F.lit(0))
    each = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    # lower() is quick and changes more than A-Z only in runs it changes at all
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    each = each.select("id", lowered.alias("word"))
    if slip_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
        each = each.select("word", h.alias("h"), at.alias("at")).select(F.when(F.col("h") % slip_every == 0, cut).otherwise(F.col("word")).alias("word"))
        each = each.where(F.length("word") >= least_letters)
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- the trie as a table

def _mix(h: np.ndarray) -> np.ndarray:
    for factor, shift in zip(MIX, (30, 27)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Paths:
    """Prefix hashes of many words at once, forward and reversed."""

    def __init__(self, words: list[str], ids: np.ndarray) -> None:
        self.words, self.ids = words, ids
        self.length = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.owner = np.repeat(np.arange(len(words)), self.length)
        self.letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.place = np.arange(len(self.letters)) - self.begin[self.owner]
        most = int(self.length.max()) + 2
        self.powers = _powers(ODD_FACTOR, most)
        self.inverse = _powers(pow(ODD_FACTOR, -1, 1 << 64), most)

    def hashes(self, reversed_: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words and letters as read in this direction, and the hash of each prefix, by word
        and number of letters: word ``i`` has its own from ``begin[i] + i`` on."""
        letters, words = self.letters, self.words
        if reversed_:
            letters = letters[(self.begin + self.length)[self.owner] - 1 - self.place]
            words = [w[::-1] for w in words]
        # wrapping sums of letter times power; a word's own sum is the difference from its start
        terms = letters.astype(np.uint64) * self.powers[self.place]
        total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        at = np.repeat(self.begin, self.length + 1) + self.steps()
        return words, letters, total[at] - np.repeat(total[self.begin], self.length + 1)

    def steps(self) -> np.ndarray:
        """0 to length of each word."""
        size = self.length + 1
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _node(prefix: np.ndarray, depth: np.ndarray, length: np.ndarray, reversed_: bool) -> np.ndarray:
    salt = (depth.astype(np.uint64) << np.uint64(33)) ^ (length.astype(np.uint64) << np.uint64(1)) ^ np.uint64(reversed_)
    return _mix(prefix ^ _mix(salt + np.uint64(ODD_FACTOR))).view(np.int64)


def _path_rows(words: list[str], ids: np.ndarray) -> Iterator[dict[str, np.ndarray | list]]:
    """Per direction the rows of all words: kind -1 the edges of the word's own trie, 0 and 1 its
    frontier without an edit in the tries of its own and the next length."""
    paths = _Paths(words, ids)
    for side in (False, True):
        ordered, letters, prefix = paths.hashes(side)
        step, owner = paths.steps(), np.repeat(np.arange(len(words)), paths.length + 1)
        length = paths.length[owner]
        first = np.concatenate([[0], np.cumsum(paths.length + 1)])[:-1]
        # a neighbour may be a letter shorter, so edges begin one level above the half
        for kind, since, trie in ((-1, (length - 1) // 2, length), (REPLACE, length - length // 2, length), (INSERT, length - length // 2, length + 1)):
            if side and kind >= 0:
                since = length - (length - length // 2)
            chosen = step >= (since if kind < 0 else np.minimum(since, length))
            if kind == REPLACE:
                chosen &= step < length
            at = np.flatnonzero(chosen)
            n, depth, own = owner[at], step[at], length[at]
            ended = depth == own
            letter = np.where(ended, END, letters[np.minimum(paths.begin[n] + depth, max(0, len(letters) - 1))])
            tail = (prefix[first[n] + own] - prefix[at]) * paths.inverse[depth]
            behind = (prefix[first[n] + own] - prefix[np.minimum(at + 1, len(prefix) - 1)]) * paths.inverse[np.minimum(depth + 1, len(paths.inverse) - 1)]
            node = _node(prefix[at], depth, trie[at], side)
            out = {"kind": np.full(len(at), kind, np.int8), "id": ids[n], "side": np.full(len(at), side), "depth": depth.astype(np.int32), "trie": trie[at].astype(np.int32), "node": node, "letter": letter}
            long = trie[at] > LONG
            if kind < 0:
                child = _node(prefix[np.minimum(at + 1, len(prefix) - 1)], depth + 1, own, side)
                out |= {"child": np.where(ended, ids[n], child), "tail": _mix(tail).view(np.int64), "rest": [None] * len(at)}
            else:
                # what is left after the edit: the letters, or the hash of all of them
                left = np.where(kind == REPLACE, behind, tail)
                texts = [None if far else ordered[i][d + (kind == REPLACE) :] for i, d, far in zip(n.tolist(), depth.tolist(), long.tolist())]
                out |= {"child": np.zeros(len(at), np.int64), "tail": _mix(left).view(np.int64), "rest": texts}
            yield out


PATHS = "kind tinyint, id bigint, side boolean, depth int, trie int, node bigint, letter bigint, child bigint, tail bigint, rest string, level int"


def paths(words: DataFrame) -> DataFrame:
    """The edges and the edit-free frontier of ``words(id, word)``, one row per word,
    direction and level; ``level`` is the depth, or -1 for the tries of long words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                till = max(at + 1, int(np.searchsorted(ends, done + LETTERS_AT_ONCE, "right")))
                part = batch.slice(at, till - at)
                for out in _path_rows(part.column("word").to_pylist(), part.column("id").to_numpy()):
                    out["level"] = np.where(out["trie"] > LONG, -1, out["depth"]).astype(np.int32)
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) if k == "rest" else pa.array(v) for k, v in out.items()})
                at = till

    return words.mapInArrow(each, PATHS)


# ---------------------------------------------------------------- the frontier

def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)`` ids of all words one inserted, deleted or replaced code point apart, each
    pair once, ``b`` the longer one or that with the greater letter.

    ``words(id, word)`` has distinct words and ids.
    """
    step = Written(paths(words), "trie")
    rows = step.df
    edges = rows.where("kind = -1").select("level", "node", F.col("letter").alias("label"), "child").distinct()
    edges = Written(edges, "trie-edges", partition=["level"])
    states = rows.where("kind >= 0").select("level", "kind", "id", "depth", "node", "letter", "tail", "rest", "side")
    starts = Written(states, "trie-states", partition=["level"])
    tails = rows.where("kind = -1 and level = -1").select(F.col("node").alias("_at"), F.col("tail").alias("_tail"), F.col("id").alias("b"))
    levels = [r[0] for r in rows.where("kind >= 0").groupBy("level").agg(F.lit(1)).select("level").orderBy("level").collect()]
    found: list[DataFrame] = []
    frontier: Written | None = None
    level = min((x for x in levels if x >= 0), default=None)
    kept = ["kind", "id", "at", "letter", "side"]
    while level is not None:
        here = edges.df.where(F.col("level") == level).drop("level")
        begun = starts.df.where(F.col("level") == level).drop("level", "tail").withColumnRenamed("letter", "own")
        # any other letter; of two replaced by each other the greater, so that a pair is met once
        other = F.when(F.col("kind") == REPLACE, F.col("label") > F.col("own")).otherwise((F.col("label") != END) & (F.col("label") != F.col("own")))
        edited = begun.join(here, "node").where(other).select("kind", "id", F.col("depth").alias("at"), F.col("label").alias("letter"), "side", F.col("child").alias("node"), "rest")
        if frontier is not None:
            # a state with an edit: its word's next letter, or the end
            next_letter = F.when(F.col("rest") == "", F.lit(END)).otherwise(F.ascii("rest")).cast("long")
            moved = frontier.df.where("not done").withColumn("label", next_letter).join(here, ["node", "label"])
            moved = moved.select(*kept, F.col("child").alias("node"), F.expr("if(rest = '', null, substring(rest, 2))").alias("rest"))
            edited = edited.unionByName(moved)
        after = Written(edited.withColumn("done", F.col("rest").isNull()), "frontier", partition=["done"])
        found.append(after.df.where("done").select(*kept, F.col("node").alias("b")))
        if frontier is not None:
            delete_path(words.sparkSession, f"{frontier.path}/done=false")
        frontier = after
        level = level + 1 if level <= max(levels) else None
    if -1 in levels:
        begun = starts.df.where("level = -1").withColumnRenamed("letter", "own")
        far = edges.df.where("level = -1").drop("level")
        other = F.when(F.col("kind") == REPLACE, F.col("label") > F.col("own")).otherwise((F.col("label") != END) & (F.col("label") != F.col("own")))
        edited = begun.join(far, "node").where(other).select("kind", "id", F.col("depth").alias("at"), F.col("label").alias("letter"), "side", "child", "tail")
        met = edited.join(tails, (F.col("child") == F.col("_at")) & (F.col("tail") == F.col("_tail")))
        found.append(met.select(*kept, "b"))
    if not found:
        return words.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    links = reduce(DataFrame.unionByName, found)
    # letter by letter: the edit made on the word, read in its direction, is the other word
    both = links.join(words.select(F.col("id"), F.col("word").alias("_a")), "id").join(words.select(F.col("id").alias("b"), F.col("word").alias("_b")), "b")
    read = F.when(F.col("side"), F.reverse("_a")).otherwise(F.col("_a"))
    made = F.concat(F.expr("substring(_read, 1, at)"), F.expr("char(letter)"), F.expr(f"substring(_read, if(kind = {REPLACE}, at + 2, at + 1))"))
    same = both.withColumn("_read", read).where(made == F.when(F.col("side"), F.reverse("_b")).otherwise(F.col("_b")))
    return same.select(F.col("id").alias("a"), "b").distinct()


# ---------------------------------------------------------------- forms

def with_roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` with ``root``, the end of the chain of forms from each word.
    Pointers double, so a chain of n forms takes log2(n) rounds."""
    step = Written(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.df.select(F.col("word").alias("_w"), F.col("root").alias("_on"))
        joined = step.df.join(on, F.col("root") == F.col("_w"), "left")
        after = Written(joined.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "roots")
        step.delete()
        moved = not after.df.where("moved").isEmpty()
        step = after
        if not moved:
            break
    return forms.join(step.df.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(counts: DataFrame, times: float = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the distinct words ``counts(word, n)``.

    A word's form is its near word (one code point inserted, deleted or replaced) of largest
    ``n``, the smallest in code-point order of several, if that ``n`` is at least ``times`` the
    word's own; else null. ``root`` is where the forms lead. No words give no rows.
    """
    # a written id is fixed: reading it again gives the same
    words = Written(counts.select("word", "n", F.monotonically_increasing_id().alias("id")), "words").df
    pairs = Written(near_pairs(words.select("id", "word")), "near-pairs").df
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("id").alias("b"), F.col("word").alias("_word"), F.col("n").alias("_n")), "b")
    best = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("_word").alias("word"))).alias("_best"))
    joined = words.join(best, F.col("id") == F.col("a"), "left")
    likely = -F.col("_best.n") >= times * F.col("n")
    out = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("_best.word")).alias("form"), F.when(likely, -F.col("_best.n")).alias("form_n"))
    return with_roots(Written(out, "forms").df).select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, times: float = 5, slip_every: int | None = None) -> DataFrame:
    """Words of whole texts grouped with their spelling variants; see ``words_of`` and ``group_variants``.

    Null and empty texts have no words, a null id counts as the text ''. Repeated rows count
    each time. Columns of other names are not read. Empty tables give no rows.
    """
    counts = words_of(df, id_col, text_col, least_letters, least_count, slip_every)
    return group_variants(counts, times)
