"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

A token belongs to a class: the ``words`` most frequent tokens are classes of their own, the others
fall into the classes of the most frequent last two bytes, and what is left into one more. The
vectors of the classes before a token, each times a weight vector of its place, add up to a
prediction; its product with a class's output vector, plus a bias, is that class's score. Softmax
is normalised over all classes; for many tokens the exp of their scores are products of rows of
one table per place. Within its class a token has its share of the corpus counts, so the probabilities
of all tokens, the unknown one included, sum to 1.

Counts and class masses cover all training texts. The vectors are trained where the texts are:
each task starts from the current vectors and passes over those training documents of its split that
are dealt to this round; the results are averaged, weighted by tokens, and the next
round starts from there. The rounds together take every training document once, none is left
out, and nothing but the vectors, of fixed size, is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.common import Written, draw, fresh

END = "\n"  # no word holds white space
WORDS, SUFFIXES = 256, 128
WIDTH, CONTEXT = 16, 4
NOISE, BATCH, RATE = 48, 256, 0.15
ROUNDS = 3
MOST_COMMON = 1 << 20
FLUSH_AT = 400_000
TOKENS_AT_ONCE = 512  # scores of so many tokens stay in a core's cache
HIGHEST = 60.0  # sums of exp of scores up to here are floats, so none is shifted


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of whole texts, only A-Z lower-cased, with one end after each text's, and their number in each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    # white space around a text leaves empty words
    real = np.flatnonzero(pc.binary_length(words).to_numpy())
    offsets = lists.offsets.to_numpy()
    stops = np.searchsorted(real, offsets[1:] - offsets[0])
    every = pa.concat_arrays([words, pa.array([END], words.type)])
    return every.take(pa.array(np.insert(real, stops, len(words)))), np.diff(stops, prepend=0) + 1


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """``(token, c)`` over all texts, counted within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in bpe.split_batches(batches, text):
            found = pc.value_counts(tokens_of(batch.column(text))[0])
            held.append(pa.table({"token": found.field("values"), "c": found.field("counts")}))
            if sum(t.num_rows for t in held) > FLUSH_AT:
                held = [merged(held)]
                if held[0].num_rows > FLUSH_AT // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    def merged(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")])
        return pa.table({"token": sums["token"], "c": sums["c_sum"]})

    return texts.select(text).mapInArrow(count, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Classes:
    """The token classes, their masses and the most common tokens with their counts."""

    own: dict[str, int]
    by_suffix: dict[bytes, int]
    mass: np.ndarray
    common: dict[str, int]
    counts: np.ndarray
    n: int
    v: int

    @property
    def rest(self) -> int:
        return len(self.mass) - 1

    def of(self, token: str) -> int:
        found = self.own.get(token)
        return self.by_suffix.get(token.encode()[-2:], self.rest) if found is None else found

    def places(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token among the common ones or -1, and its class."""
        place = pc.fill_null(pc.index_in(tokens, value_set=self.common_tokens.cast(tokens.type)), -1).to_numpy().astype(np.int64)
        found = np.append(self.class_of_common, self.rest)[place]
        # tokens with a class of their own are common
        other = np.flatnonzero(place < 0)
        last = pc.binary_slice(tokens.take(pa.array(other)).cast(pa.binary()), -2)
        suffix = pc.fill_null(pc.index_in(last, value_set=pa.array([*self.by_suffix], pa.binary())), -1).to_numpy()
        found[other] = np.array([*self.by_suffix.values(), self.rest], np.int64)[suffix]
        return place, found

    @cached_property
    def common_tokens(self) -> pa.Array:
        return pa.array([*self.common], pa.string())

    @cached_property
    def class_of_common(self) -> np.ndarray:
        return np.array([self.of(t) for t in self.common], np.int64)

    def base(self, c):
        """log10 of a token's share, by its count."""
        return np.log10((np.asarray(c) + 0.5) / (self.n + 0.5 * (self.v + 1)))


def classes_of(counts: DataFrame, words: int = WORDS, suffixes: int = SUFFIXES, most_common: int = MOST_COMMON) -> Classes:
    """Classes by the counts of all tokens. What reaches the driver is bounded: totals,
    suffixes and the common tokens, those of more than one in ``most_common`` of all
    occurrences, so fewer than ``most_common``."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    common = counts.where(F.col("c") * most_common > total["n"]).collect()
    common.sort(key=lambda r: (-r["c"], r["token"].encode()))
    own = {r["token"]: i for i, r in enumerate(common[:words])}
    whole = total["n"] + 0.5 * (total["v"] + 1)
    suffix = F.hex(F.expr("substring(cast(token as binary), -2, 2)"))
    others = counts.where(~F.col("token").isin([*own])) if own else counts
    sums = others.groupBy(suffix.alias("suffix")).agg(F.sum(F.col("c") + 0.5).alias("mass")).orderBy(F.desc("mass"), "suffix")
    by_suffix = {}
    mass = [(r["c"] + 0.5) / whole for r in common[:words]]
    for r in sums.limit(suffixes).collect():
        by_suffix[bytes.fromhex(r["suffix"])] = len(mass)
        mass.append(r["mass"] / whole)
    mass.append(max(1 - sum(mass), 0.5 / whole))  # all other tokens and the unknown one
    return Classes(own, by_suffix, np.array(mass), {r["token"]: i for i, r in enumerate(common)}, np.array([r["c"] for r in common], np.int64), total["n"], total["v"])


class Model:
    """Input vectors (the last stands before a text), place weights, output vectors and biases."""

    def __init__(self, mass: np.ndarray, width: int = WIDTH, context: int = CONTEXT, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.mass, self.context = mass, context
        small = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        # with biases at the logarithm of the masses training starts from the class shares
        self.parts = [small(len(mass) + 1, width), 1 + small(context, width), small(len(mass), width), np.log(mass).astype(np.float32)]

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, p in enumerate(self.parts):
            self.parts[k] = flat[at : at + p.size].astype(np.float32, copy=False).reshape(p.shape)
            at += p.size

    def contexts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The classes of all texts in a row and, for each, those before it within its text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(texts) + 1) * self.context, sizes)
        row = np.full(len(at) + self.context * len(texts), len(self.mass), np.int64)
        if texts:
            row[at] = np.concatenate(texts)
        return row[at], np.stack([row[at - k - 1] for k in range(self.context)], axis=1) if len(at) else np.zeros((0, self.context), np.int64)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return np.einsum("bkw,kw->bw", self.parts[0].take(before, axis=0), self.parts[1])

    def log_probabilities(self, before: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all classes, one row per context."""
        scores = self.predicted(before) @ self.parts[2].T
        scores += self.parts[3]
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))

    def powers(self) -> list[np.ndarray] | None:
        """Per place the exp of what each class there adds to each score, last the biases', if all products are floats."""
        vectors, places, outputs, bias = self.parts
        added = [(vectors * p) @ outputs.T for p in places]
        if not sum(np.abs(x).max() for x in added) + np.abs(bias).max() < HIGHEST:
            return None
        return [np.exp(x) for x in [*added, bias]]

    def chosen(self, before: np.ndarray, target: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``log_probabilities`` those of ``target`` and of one other class.

        The exp of a score is a product of one number per place. The tables of these have a row for each
        class, so for more tokens than classes they are less work than an exp for every score.
        """
        vectors, _, outputs, bias = self.parts
        first, second = np.empty(len(target)), np.empty(len(target))
        powers = self.powers() if len(target) > len(vectors) else None
        held = np.empty((2, min(len(target), TOKENS_AT_ONCE), len(bias)), np.float32)  # taken once: fresh pages cost as much as the products
        for at in range(0, len(target), TOKENS_AT_ONCE):
            y, ctx = target[at : at + TOKENS_AT_ONCE], before[at : at + TOKENS_AT_ONCE]
            h = self.predicted(ctx)
            whole, factor = held[:, : len(y)]
            if powers is None:
                np.matmul(h, outputs.T, out=whole)
                whole += bias
                whole -= whole.max(1, keepdims=True)
                own, rest = whole[np.arange(len(y)), y], whole[:, other].copy()
                log_sum = np.log(np.exp(whole, out=whole).sum(1))
            else:
                powers[0].take(ctx[:, 0], axis=0, out=whole, mode="clip")
                for k in range(1, self.context):
                    whole *= powers[k].take(ctx[:, k], axis=0, out=factor, mode="clip")
                own, rest = np.einsum("bw,bw->b", h, outputs.take(y, axis=0)) + bias.take(y), h @ outputs[other] + bias[other]
                log_sum = np.log(whole @ powers[-1])
            first[at : at + len(y)], second[at : at + len(y)] = own - log_sum, rest - log_sum
        return first, second

    def train(self, target: np.ndarray, before: np.ndarray, seed: int, noise: int = NOISE, batch: int = BATCH, rate: float = RATE) -> None:
        """One pass of noise-contrastive estimation in shuffled batches, steps by Adagrad. The
        noise, drawn by the class masses, is shared within a batch."""
        random = np.random.default_rng(seed)
        order = random.permutation(len(target))
        target, before = target.astype(np.int32)[order], before.astype(np.int32).take(order, axis=0)
        log_noise = np.log(noise * self.mass).astype(np.float32)
        upto = np.cumsum(self.mass / self.mass.sum())
        rounds = -(-len(target) // batch)
        drawn = np.minimum(np.searchsorted(upto, random.random((rounds, noise))), len(upto) - 1)
        # one row of numbers, so a step moves them at once: input vectors, place weights, and output vectors each with its bias
        (_, width), (context, _), count = self.parts[0].shape, self.parts[1].shape, len(self.parts[3])
        flat = np.concatenate([self.parts[0].ravel(), self.parts[1].ravel(), np.column_stack(self.parts[2:]).ravel()])
        first, second = self.parts[0].size, self.parts[0].size + self.parts[1].size
        vectors, places, outputs = flat[:first].reshape(-1, width), flat[first:second].reshape(-1, width), flat[second:].reshape(count, width + 1)
        square, held = np.full(len(flat), 1e-2, np.float32), np.empty(len(flat), np.float32)
        # the places in that row of each input vector and of each output vector with its bias
        of_vector, of_output = np.arange(first).reshape(-1, width), np.arange(second, len(flat)).reshape(count, width + 1)
        most, wide = min(batch, len(target)), context * width
        cells = np.empty(most * (wide + width + 1) + noise * (width + 1), np.int64)
        added = np.empty(len(cells), np.float32)
        bent = np.ones((most, width + 1), np.float32)  # the predictions, and a 1 for the bias
        spread, row, column = np.zeros((wide, width), np.float32), np.arange(wide), np.tile(np.arange(width), context)
        with np.errstate(over="ignore"):  # beyond all floats a slope is 0
            for at, other in zip(range(0, len(target), batch), drawn):
                y, ctx = target[at : at + batch], before[at : at + batch]
                size = len(y)
                cut, end = size * wide, size * (wide + width + 1)
                all_of = end + noise * (width + 1)
                of_vector.take(ctx, axis=0, out=cells[:cut].reshape(size, context, width), mode="clip")
                of_output.take(y, axis=0, out=cells[cut:end].reshape(size, width + 1), mode="clip")
                of_output.take(other, axis=0, out=cells[end:all_of].reshape(noise, width + 1), mode="clip")
                seen, wanted, unwanted = vectors.take(ctx, axis=0).reshape(size, wide), outputs.take(y, axis=0), outputs.take(other, axis=0)
                spread[row, column] = places.ravel()
                h = bent[:size]
                h[:, :width] = seen @ spread
                # mean slopes of the loss: how far data looks like noise, and noise like data
                g_true = np.einsum("bw,bw->b", h, wanted)
                g_true -= log_noise.take(y)
                g_true = np.float32(-1 / size) / (1 + np.exp(g_true))
                against = -unwanted
                against[:, width] += log_noise.take(other)
                g_false = h @ against.T
                np.exp(g_false, out=g_false)
                g_false += 1
                np.divide(np.float32(1 / size), g_false, out=g_false)
                g_h = g_false @ unwanted[:, :width]
                wanted *= g_true[:, None]
                g_h += wanted[:, :width]
                g_places = np.einsum("bw,bkw->kw", g_h, seen.reshape(size, context, width)).ravel()
                np.matmul(g_h, spread.T, out=added[:cut].reshape(size, wide))
                np.multiply(g_true[:, None], h, out=added[cut:end].reshape(size, width + 1))
                np.matmul(g_false.T, h, out=added[end:all_of].reshape(noise, width + 1))
                g = np.bincount(cells[:all_of], added[:all_of], len(flat)).astype(np.float32)
                g[first:second] = g_places
                square += np.multiply(g, g, out=held)
                g /= np.sqrt(square, out=held)
                g *= rate
                flat -= g
        self.parts = [vectors.copy(), places.copy(), outputs[:, :width].copy(), outputs[:, width].copy()]


def fit(training: DataFrame, key: Column, text: str, classes: Classes, rounds: int = ROUNDS) -> Model:
    """The model trained on every document of ``training`` once; the draw of ``key`` deals them to the rounds."""
    model = Model(classes.mass)
    if not classes.n:
        return model
    dealt = training.select(text, F.floor(draw(key) * rounds).alias("_round"))
    for turn in range(rounds):
        sent = training.sparkSession.sparkContext.broadcast((classes, model))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, mine = sent.value
            start = mine.flat
            seen = 0
            for n, batch in enumerate(bpe.split_batches(batches, text)):
                tokens, sizes = tokens_of(batch.column(text))
                _, found = known.places(tokens)
                target, before = mine.contexts(np.split(found, np.cumsum(sizes)[:-1]))
                mine.train(target, before, seed=1000 * turn + n)
                seen += len(target)
            if seen:
                yield pa.RecordBatch.from_pydict({"moved": pa.array([(mine.flat - start).tolist()]), "weight": pa.array([float(seen)])})
            mine.load(start)  # the broadcast value serves other tasks of this worker

        moved = dealt.where(F.col("_round") == turn).select(text).mapInArrow(each, "moved array<double>, weight double").select("weight", F.posexplode("moved"))
        mean = moved.groupBy("pos").agg((F.sum(F.col("col") * F.col("weight")) / F.sum("weight")).alias("mean"))
        steps = mean.orderBy("pos").toPandas()["mean"].to_numpy(np.float64)
        sent.destroy()
        if len(steps):
            model.load(model.flat + steps)
    return model


def score(df: DataFrame, counts: DataFrame, classes: Classes, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``n_tokens, n_known, base_score, score`` of each whole text.

    ``base_score`` adds log10 of each token's share, ``score`` that of the model's
    probability. The most common tokens are known within tasks; the others are joined with
    ``counts`` once per text and token. Null and empty texts are one end token.
    """
    made = ["n_tokens", "n_known", "base_score", "score"]
    text, row = fresh(df, "_text"), fresh(df, "_row")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made and c != text_col]
    rows = df.select(*kept, F.col(text_col).alias(text))
    fields = [f for f in rows.schema if f.name != text]
    sent = df.sparkSession.sparkContext.broadcast((classes, model))
    kinds = {"rare": pa.list_(pa.string()), "times": pa.list_(pa.int32()), "if_known": pa.list_(pa.float32()), "if_new": pa.list_(pa.float32())}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lm = sent.value
        base = known.base(known.counts) if len(known.counts) else np.zeros(1)
        log_mass = np.log10(known.mass)
        for batch in bpe.split_batches(batches, text):
            tokens, sizes = tokens_of(batch.column(text))
            place, found = known.places(tokens)
            target, before = lm.contexts(np.split(found, np.cumsum(sizes)[:-1]))
            # log10 of how much likelier the class is here than over all texts
            gained, lost = (x / np.log(10) for x in lm.chosen(before, target, known.rest))
            gained -= log_mass[target]
            lost -= log_mass[known.rest]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            hit = place >= 0
            own = np.where(hit, base[np.maximum(place, 0)], 0.0)
            out = {f.name: batch.column(f.name) for f in fields}
            out["n_tokens"] = pa.array(sizes)
            out["n_known"] = pa.array(np.bincount(owner[hit], minlength=len(sizes)).astype(np.int64))
            out["base_score"] = pa.array(np.bincount(owner, weights=own, minlength=len(sizes)))
            out["score"] = pa.array(np.bincount(owner, weights=np.where(hit, own + gained, 0.0), minlength=len(sizes)))
            # the others once per text and token
            few = np.flatnonzero(~hit)
            named = tokens.take(pa.array(few)).dictionary_encode()
            each_name = len(named.dictionary)
            met, at = np.unique(owner[few] * each_name + named.indices.to_numpy(), return_inverse=True)
            sums = [np.bincount(at, weights, len(met)) for weights in (None, gained[few], lost[few])]
            edges = pa.array(np.searchsorted(met, np.arange(len(sizes) + 1) * each_name), pa.int32())
            lists = [named.dictionary.take(pa.array(met % max(each_name, 1))), *sums]
            for (name, kind), values in zip(kinds.items(), lists):
                out[name] = pa.ListArray.from_arrays(edges, pa.array(values).cast(kind.value_type))
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_tokens bigint, n_known bigint, base_score double, score double, rare array<string>, times array<int>, if_known array<float>, if_new array<float>"])
    # written with its ids: reading it again gives the same rows
    step = Written(rows.mapInArrow(each, schema).withColumn(row, F.monotonically_increasing_id()), "lm-scores", "zstd").df
    sent.destroy()
    few = step.select(row, F.inline(F.arrays_zip("rare", "times", "if_known", "if_new")))
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 0.5) / (classes.n + 0.5 * (classes.v + 1))) * F.col("times")
    found = few.join(counts.withColumnRenamed("token", "rare"), "rare", "left")
    gain = F.when(F.col("c").isNotNull(), F.col("if_known")).otherwise(F.col("if_new")).cast("double")
    more = found.groupBy(row).agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("_known"), F.sum(base).alias("_base"), F.sum(base + gain).alias("_score"))
    both = step.drop(*kinds).join(more, row, "left")
    added = {"n_known": "_known", "base_score": "_base", "score": "_score"}
    return both.withColumns({k: F.col(k) + F.coalesce(v, F.lit(0)) for k, v in added.items()}).drop(row, *added.values())


def held_out_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(<id>, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Counts, classes and vectors come from rows where ``held_out`` is false; all rows are
    scored. Repeated rows are scored each, null ids stay null. Columns of other names are not
    read. Without training rows every token is unknown; empty tables give no rows.
    """
    docs = df.select(F.col(id_col).alias("_id"), held_out.alias("held_out"), F.col(text_col).alias("_text"))
    training = docs.where(~F.col("held_out"))
    counts = Written(token_counts(training, "_text"), "token-counts").df
    classes = classes_of(counts)
    model = fit(training, F.xxhash64("_id", "_text"), "_text", classes, rounds)
    out = score(docs, counts, classes, model, "_text").withColumn("train_tokens", F.lit(classes.n).cast("long"))
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
