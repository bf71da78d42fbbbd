"""Toxicity by the nearest labelled examples in exact TF-IDF cosine.

Labelled texts are the examples, a bounded sample of each class. Terms that go with a label
are the telling ones; over them every text is a unit TF-IDF vector. An inverted index keeps for
every term its postings and, per block of examples, the largest weight among them. The sum of
these largest weights bounds the cosine of any example of a block, so a query reads blocks by
falling bound and stops when no block left can hold one of the ``k`` nearest.

A second index holds every term of every example. It gives the neighbours of a text without
a telling term, and the cosines over all terms that stand in the evidence of every text.

Neighbours vote by their closeness and by the share of all labelled rows they stand for; a
logistic curve fitted on the examples, each judged without itself, turns votes into scores.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, smallest_draws
from plumbline.llm.language import fold

EXAMPLES_PER_CLASS = 3000
MOST_TERMS = 20_000
LEAST_ROWS = 5
LEAST_ASSOCIATION = 20.0
BLOCK = 64
NEIGHBOURS = 15
PRIOR_VOTES = 0.5
DENSE_SHARE = 8
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def association(a: np.ndarray, b: np.ndarray, in_a: float, in_b: float) -> np.ndarray:
    """G statistic of a term that occurs in ``a`` of ``in_a`` and ``b`` of ``in_b`` rows."""
    cells = [(a, in_a), (in_a - a, in_a), (b, in_b), (in_b - b, in_b)]
    rate = (a + b) / (in_a + in_b)
    out = np.zeros(len(a))
    for (n, size), share in zip(cells, (rate, 1 - rate, rate, 1 - rate)):
        expected = size * share
        out += np.where(n > 0, 2 * n * np.log(np.maximum(n, 1e-12) / np.maximum(expected, 1e-12)), 0.0)
    return out


class Bags:
    """The words of many texts as numbers: two ints a word and text, each word's letters once."""

    def __init__(self, texts: list[str | None]) -> None:
        known: dict[str, int] = {}
        term, count, ends = array("i"), array("i"), array("q", [0])
        for text in texts:
            bag = Counter(words(text))
            term.extend([known.setdefault(w, len(known)) for w in bag])
            count.extend(bag.values())
            ends.append(len(term))
        self.names = [*known]
        self.term, self.count, self.ends = np.array(term, np.int32), np.array(count, np.int32), np.array(ends, np.int64)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Words and counts of text ``i``, in the order they are met."""
        at = slice(self.ends[i], self.ends[i + 1])
        return self.term[at], self.count[at]

    def ordered(self, order: list[int]) -> Bags:
        """The bags in another order, their words numbered as they are met there."""
        out = object.__new__(Bags)
        sizes = np.diff(self.ends)[order]
        out.ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(out.ends[-1]) + np.repeat(self.ends[:-1][order] - out.ends[:-1], sizes)
        first, place = np.unique(self.term[at], return_index=True)
        met = first[np.argsort(place)]
        number = np.zeros(len(self.names), np.int32)
        number[met] = np.arange(len(met))
        out.names, out.term, out.count = [self.names[t] for t in met.tolist()], number[self.term[at]], self.count[at]
        return out

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.ends))


class Everything:
    """TF-IDF cosines with all examples over all their terms; frequent terms as dense rows."""

    def __init__(self, bags: Bags, weight: np.ndarray, rows: int) -> None:
        self.terms = {w: n for n, w in enumerate(bags.names)}
        term, owner = bags.term, bags.owners()
        spread = np.bincount(term, weight[owner], len(self.terms))
        self.idf = np.append(np.log((rows + 1) / (spread + 1)) + 1, np.log(rows + 1) + 1)  # the last for terms of no example
        value = np.log(bags.count.astype(np.float64))
        value += 1
        value *= self.idf[term]
        value /= np.sqrt(np.bincount(owner, value * value, len(bags)))[owner]
        order = np.argsort(term, kind="stable").astype(np.int32)
        self.owner, self.value = owner[order], value[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])
        self.size = len(bags)
        dense = np.flatnonzero(np.diff(ends) > len(bags) // DENSE_SHARE)
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), len(bags)), np.float32)
        for n, t in enumerate(dense.tolist()):
            self.dense[n, self.owner[ends[t] : ends[t + 1]]] = self.value[ends[t] : ends[t + 1]]
        self.ends = ends

    def cosines(self, bag: Counter) -> np.ndarray:
        return self.numbered(np.array([self.terms.get(w, -1) for w in bag], np.int64), np.array([*bag.values()], np.int64))

    def numbered(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The cosines of a text by the numbers of its terms, -1 for those of no example."""
        if not len(terms) or not self.size:
            return np.zeros(self.size)
        value = (1 + np.log(counts)) * self.idf[terms]
        value /= np.sqrt((value * value).sum())
        known = terms >= 0
        terms, value = terms[known], value[known]
        row = self.row[terms]
        query = np.zeros(len(self.dense), np.float32)
        query[row[row >= 0]] = value[row >= 0]
        out = (query @ self.dense).astype(np.float64)
        terms, value = terms[row < 0], value[row < 0]
        if len(terms):
            low, size = self.ends[terms], self.ends[terms + 1] - self.ends[terms]
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            out += np.bincount(self.owner[at], self.value[at] * np.repeat(value, size), self.size)
        return np.minimum(out, 1.0)


class Index:
    """Block-max inverted index of the examples."""

    def __init__(self, texts: list[str], keys: list, toxic: np.ndarray, totals: dict[int, int]) -> None:
        bags = Bags(texts)
        here = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
        self.weight = np.array([totals.get(int(c), 0) / here[int(c)] for c in toxic])
        side = np.repeat(toxic, np.diff(bags.ends))
        found = [np.bincount(bags.term[side == c], minlength=len(bags.names)) for c in (0, 1)]
        often = sorted(np.flatnonzero(found[0] + found[1] >= LEAST_ROWS).tolist(), key=bags.names.__getitem__)
        terms = [bags.names[t] for t in often]
        counts = [f[often].astype(np.float64) for f in found]
        link = association(counts[1], counts[0], here[1], here[0]) if terms else np.zeros(0)
        chosen = np.lexsort((np.arange(len(terms)), -link))[:MOST_TERMS]
        chosen = np.sort(chosen[link[chosen] >= LEAST_ASSOCIATION])
        self.terms = {terms[i]: n for n, i in enumerate(chosen.tolist())}
        rows = sum(totals.values())
        spread = sum(totals.get(c, 0) / here[c] * counts[c][chosen] for c in (0, 1)) if terms else np.zeros(0)
        self.idf = np.log((rows + 1) / (spread + 1)) + 1
        telling = np.full(len(bags.names), -1, np.int64)
        telling[np.array(often, np.int64)[chosen]] = np.arange(len(chosen))
        vectors = [self._unit(telling[t], n) for t, n in map(bags.__getitem__, range(len(bags)))]
        # similar examples share a block: sorted by their heaviest term
        heavy = [int(t[v.argmax()]) if len(t) else -1 for t, v in vectors]
        order = sorted((i for i in range(len(bags)) if heavy[i] >= 0), key=lambda i: (heavy[i], len(vectors[i][0]), str(keys[i]), i))
        empty = np.array([h < 0 for h in heavy], bool)
        self.telling = len(order)  # examples from here on have no telling term
        order += np.flatnonzero(empty).tolist()
        self.toxic, self.keys = toxic[order].astype(np.float64), [keys[i] for i in order]
        self.votes = self.weight[order]
        self.bare = self._share(self.weight[empty], toxic[empty], rows, totals)
        self.prior = (totals.get(1, 0) + 0.5) / (rows + 1)
        blocks = -(-self.telling // BLOCK)
        bags = bags.ordered(order)
        order = order[: self.telling]
        self.most = np.zeros((len(self.terms), blocks))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for n, i in enumerate(order):
            for t, v in zip(*vectors[i]):
                postings[t].append((n, v))
                self.most[t, n // BLOCK] = max(self.most[t, n // BLOCK], v)
        self.where = [np.array([n for n, _ in p], np.int64) for p in postings]
        self.value = [np.array([v for _, v in p]) for p in postings]
        self.ends = [np.searchsorted(w, np.arange(blocks + 1) * BLOCK) for w in self.where]
        self.known: dict[tuple, list] = {}
        self.slope, self.shift = 1.0, 0.0
        self.all = Everything(bags, self.votes, rows)
        self._calibrate([vectors[i] for i in order], bags)

    @staticmethod
    def _share(weight: np.ndarray, toxic: np.ndarray, rows: int, totals: dict[int, int]) -> float:
        base = (totals.get(1, 0) + 0.5) / (rows + 1)
        return float((weight @ toxic + base) / (weight.sum() + 1)) if len(weight) else base

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights of a text; no known term gives an empty vector."""
        return self._unit(np.array([self.terms.get(w, -1) for w in bag], np.int64), np.array([*bag.values()], np.int64))

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by the numbers of its telling terms, -1 for others."""
        known = np.flatnonzero(terms >= 0)
        known = known[np.argsort(terms[known])]
        terms, value = terms[known], (1 + np.log(counts[known].astype(np.float64))) * self.idf[terms[known]]
        return terms, value / np.sqrt((value * value).sum()) if len(terms) else value

    def nearest(self, terms: np.ndarray, value: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, ties to the earlier example."""
        bound = value @ self.most[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or len(best) == k and bound[block] < -best[-1][0] - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, v in zip(terms.tolist(), value.tolist()):
                low, high = self.ends[t][block], self.ends[t][block + 1]
                score[self.where[t][low:high] - block * BLOCK] += v * self.value[t][low:high]
            near = np.flatnonzero(score > 0)
            found = [(-score[n], block * BLOCK + int(n)) for n in near if block * BLOCK + n != without]
            best = sorted(best + found)[:k]
        return [(-s, n) for s, n in best]

    def nearest_of_all(self, cosines: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0 over all terms, ties to the earlier example."""
        if without >= 0:
            cosines = cosines.copy()
            cosines[without] = 0.0
        at = np.flatnonzero(cosines >= np.partition(cosines, -k)[-k]) if len(cosines) > k else np.arange(len(cosines))
        at = at[np.argsort(-cosines[at], kind="stable")][:k]
        return [(float(cosines[n]), int(n)) for n in at if cosines[n] > 0]

    def vote(self, near: list[tuple[float, int]], prior: float | None = None) -> float:
        """Share of the votes for label 1: a vote falls with the square of the sine. ``prior``
        is the share where no example is near."""
        prior = self.prior if prior is None else prior
        if not near:
            return self.bare
        cosine = np.minimum(1.0, np.array([s for s, _ in near]))
        at = [n for _, n in near]
        votes = self.votes[at] * cosine**2 / (1 + 4 * (1 - cosine**2))
        return float((votes @ self.toxic[at] + PRIOR_VOTES * prior) / (votes.sum() + PRIOR_VOTES))

    def _calibrate(self, vectors: list[tuple], every: Bags) -> None:
        raw = [self.vote(self.nearest(t, v, NEIGHBOURS, without=n)) for n, (t, v) in enumerate(vectors)]
        for n in range(self.telling, len(every)):
            raw.append(self.vote(self.nearest_of_all(self.all.numbered(*every[n]), NEIGHBOURS, without=n), self.bare))
        x = np.clip(np.array(raw), 1e-6, 1 - 1e-6)
        x = np.log(x / (1 - x))
        y, w = self.toxic, self.votes
        if not (w[y == 1].sum() > 0 and w[y == 0].sum() > 0):
            return
        w = w / w.sum()
        for _ in range(30):  # Newton steps, lightly drawn to slope 1
            p = 1 / (1 + np.exp(-(self.slope * x + self.shift)))
            grad = np.array([(w * (p - y) * x).sum() + 1e-3 * (self.slope - 1), (w * (p - y)).sum()])
            s = w * p * (1 - p)
            curve = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
            step = np.clip(np.linalg.solve(curve, grad), -2, 2)
            self.slope, self.shift = self.slope - step[0], self.shift - step[1]

    def judge(self, text: str | None, k: int = NEIGHBOURS) -> tuple[float, list, list[float], list[int]]:
        """Score and evidence: keys, cosines over all terms and labels of the nearest examples."""
        bag = Counter(words(text))
        cosines = self.all.cosines(bag)
        terms, value = self.vector(bag)
        if not len(terms):
            near = self.nearest_of_all(cosines, k)
            score = self._score(self.vote(near, self.bare))
        else:
            sign = (tuple(terms.tolist()), tuple(value.tolist()))
            if sign not in self.known:
                if len(self.known) > 5_000:
                    self.known.clear()
                near = self.nearest(terms, value, k)
                self.known[sign] = self._score(self.vote(near)), near
            score, near = self.known[sign]
        at = [n for _, n in near]
        return score, [self.keys[n] for n in at], cosines[at].tolist(), [int(self.toxic[n]) for n in at]

    def _score(self, raw: float) -> float:
        raw = min(max(raw, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.slope * np.log(raw / (1 - raw)) + self.shift))))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES_PER_CLASS) -> Index | None:
    """An index of whole labelled texts: per class at most ``examples`` rows, those of smallest
    hash of the id. A row counts as toxic if any label of its id is 1. Null labels, null ids
    and texts without a label teach nothing; without any example there is no index (None)."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    totals = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = smallest_draws(marked, "_toxic", "_id", examples, totals).select("_id", "_toxic")
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = texts.groupBy("_id", "_toxic").agg(F.max("_text").alias("_text")).toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("_id", kind="stable")
    keys, toxic = rows["_id"].tolist(), rows["_toxic"].to_numpy()
    return Index(rows.pop("_text").tolist(), keys, toxic, totals)


def with_scores(df: DataFrame, index: Index | None, text_col: str = "text", key_type: str = "bigint") -> DataFrame:
    """``df`` with ``score``, ``predicted`` (1 from 0.5 on) and the evidence: ``near_ids``,
    ``near_cosines`` and ``near_labels``. Columns of these names are replaced, all rows kept.

    Every text is read whole. One without a telling term is judged by the examples nearest over
    all terms, the nearer the more; far from all it gets the rate of examples without a telling term,
    as do null and empty texts. Without an index the score is 0.
    """
    model = df.sparkSession.sparkContext.broadcast(index)
    shape = f"score double, near_ids array<{key_type}>, near_cosines array<double>, near_labels array<int>"

    @F.pandas_udf(shape)
    def judged(texts: pd.Series) -> pd.DataFrame:
        known = model.value
        rows = [known.judge(t) if known else [0.0, [], [], []] for t in texts]
        return pd.DataFrame(rows, columns=["score", "near_ids", "near_cosines", "near_labels"])

    held = fresh(df, "_judged")
    out = df.withColumn(held, judged(F.col(text_col)))
    for name in ("score", "near_ids", "near_cosines", "near_labels"):
        out = out.withColumn(name, F.col(held)[name])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(held)


def held_out_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0) -> DataFrame:
    """``(<id>, held_out, score, predicted)`` and evidence for every row of ``df``; labels of
    the held fold are never read."""
    index = fit(df, labels.where(fold(id_col, folds) != held), id_col, text_col, label_col)
    rows = df.select(F.col(id_col).alias("_id"), (fold(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("_text"))
    out = with_scores(rows, index, "_text", df.schema[id_col].dataType.simpleString())
    return out.select(F.col("_id").alias(id_col), "held_out", "score", "predicted", "near_ids", "near_cosines", "near_labels")
