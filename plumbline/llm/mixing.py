"""Mixing documents to target weights of domains they belong to softly.

A naive Bayes classifier over surface features, counted on all labelled rows, gives every
document posteriors over the domains. A rate per document, how often it is taken, then makes
the expected tokens of the domains match target shares: projected-gradient least squares over
nonnegative rates that starts from rate 1. Everything is DataFrame expressions: a document's
gradient depends on the data only through one residual per domain, so a round is one
aggregate over narrow rows, and a rate is replayed from the residuals of all rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Written, fresh

MOST_DOMAINS = 64
MOST_ROUNDS = 60
TOLERANCE = 1e-7
SHARE_BINS = 20
LENGTH_BINS = 24
# multiples of these fill [0, 1) evenly
GOLDEN = 0.6180339887498949
PLASTIC = 0.7548776662466927


def tokens(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def surface(text: Column) -> dict[str, tuple[Column, int]]:
    """Binned features of a whole text, each with its number of bins; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    words = F.split(text, " ")
    count = F.size(words)

    def share(part: Column, whole: Column) -> Column:
        return F.least(F.floor(F.sqrt(part / whole) * SHARE_BINS), F.lit(SHARE_BINS)).cast("int")

    return {
        "distinct": (share(F.size(F.array_distinct(words)), count), SHARE_BINS + 1),
        "capitals": (share(F.regexp_count(text, F.lit(r"\p{Lu}")), size), SHARE_BINS + 1),
        "marks": (share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")), size), SHARE_BINS + 1),
        "digits": (share(F.regexp_count(text, F.lit(r"\p{N}")), size), SHARE_BINS + 1),
        "word_length": (F.least(F.floor(size / count), F.lit(LENGTH_BINS)).cast("int"), LENGTH_BINS + 1),
        "words": (F.least(F.floor(F.log2(count + F.lit(1))), F.lit(LENGTH_BINS)).cast("int"), LENGTH_BINS + 1),
    }


@dataclass
class Mixture:
    """A fitted mixture: applies to any table with the same kind of text."""

    domains: list[str]
    prior: list[float]
    logs: dict[str, list[list[float]]]  # by feature and domain, the log share of each bin
    steps: list[list[float]]

    def posterior(self, bins: dict[str, Column]) -> Column:
        """Shares of the domains, in the order of ``domains``."""
        scores = []
        for k in range(len(self.domains)):
            total = F.lit(self.prior[k])
            for name, logs in self.logs.items():
                total = total + F.element_at(F.array(*[F.lit(x) for x in logs[k]]), bins[name] + 1)
            scores.append(total)
        raw = F.array(*scores)
        shifted = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        return F.transform(shifted, lambda x: F.round(x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b), 9))

    def rate(self, posterior: Column) -> Column:
        """The rate after all rounds: each moves it against the gradient, never below 0."""
        if not self.steps:
            return F.lit(1.0)
        steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in self.steps])
        pairs = lambda s: F.zip_with(posterior, s, lambda p, r: p * r)
        moved = lambda s: F.aggregate(pairs(s), F.lit(0.0), lambda a, b: a + b)
        return F.aggregate(steps, F.lit(1.0), lambda w, s: F.greatest(F.lit(0.0), w - moved(s)))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small linear system by elimination with pivots."""
    n = len(right)
    rows = [[*m, r] for m, r in zip(matrix, right)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for j in range(n):
            if j != i and rows[i][i]:
                factor = rows[j][i] / rows[i][i]
                rows[j] = [a - factor * b for a, b in zip(rows[j], rows[i])]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


def features(df: DataFrame, id_col: str, text_col: str, key: bool = False) -> DataFrame:
    """``_id``, ``_tokens``, one ``_bin_<feature>`` column per feature and, if asked for, ``_key``, the
    hash of the text."""
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("_id"), tokens(text).alias("_tokens"), *[F.xxhash64(text).alias("_key")] * key, *[c.alias(f"_bin_{n}") for n, (c, _) in surface(text).items()])


def fit(rows: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", domain_col: str = "quality") -> Mixture:
    """Fit on written ``features`` of the documents to mix and the labelled table.

    Labels that are null, of no target or without a document teach nothing; each label row
    of a document counts. Without any usable label, or without tokens, all rates are 1.
    """
    if not targets or min(targets.values()) < 0 or not sum(targets.values()) > 0:
        raise ValueError("targets must be nonnegative weights that do not sum to 0")
    if len(targets) > MOST_DOMAINS:
        raise ValueError(f"at most {MOST_DOMAINS} domains")
    domains = sorted(targets)
    wanted = [targets[d] / sum(targets.values()) for d in domains]
    sizes = {name: n for name, (_, n) in surface(F.lit("")).items()}
    known = labels.select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_domain"))
    known = known.where(F.col("_domain").isin(domains))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_bin_{n}").alias("bin")) for n in sizes]))
    # one row per domain, feature and bin reaches the driver
    counted = rows.join(known, "_id").select("_domain", cells.alias("c")).groupBy("_domain", "c.name", "c.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {(r["_domain"], r["name"], r["bin"]): r["n"] for r in counted}
    first = next(iter(sizes))
    per = [sum(n for (d, name, _), n in seen.items() if d == domain and name == first) for domain in domains]
    out = Mixture(domains, [math.log((n + 1) / (sum(per) + len(domains))) for n in per], {}, [])
    if not sum(per):
        return out
    for name, size in sizes.items():
        out.logs[name] = [[math.log((seen.get((d, name, b), 0) + 0.5) / (n + 0.5 * size)) for b in range(size)] for d, n in zip(domains, per)]
    posterior = out.posterior({n: F.col(f"_bin_{n}") for n in sizes})
    soft = rows.select(F.col("_tokens").cast("double").alias("t"), posterior.alias("p"))
    # rows with the same features share their posterior
    soft = Written(soft.groupBy("p").agg(F.sum("t").alias("t")), "posteriors").df
    k = range(len(domains))
    share = [F.sum(F.col("t") * F.col("p")[i] * F.col("p")[j]) for i in k for j in k]
    total, *cross = soft.agg(F.sum("t"), *share).first()
    if not total:
        return out
    # the curvature of the least squares in tokens, lightly held away from 0
    curve = [[cross[i * len(domains) + j] / total + 1e-6 * (i == j) for j in k] for i in k]
    for _ in range(MOST_ROUNDS):
        rate = out.rate(F.col("p"))
        got = soft.select("t", "p", rate.alias("w")).agg(*[F.sum(F.col("t") * F.col("w") * F.col("p")[i]) for i in k]).first()
        residual = [round(g / total - w, 9) for g, w in zip(got, wanted)]
        if max(map(abs, residual)) < TOLERANCE:
            break
        out.steps.append([round(x, 12) for x in solve(curve, residual)])
    return out


def copies(id_col: Column, rate: Column) -> Column:
    """How often a document is taken: the rate rounded up or down by a fixed draw of its id."""
    draw = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) / F.lit(float(1 << 32))
    return F.floor(rate + draw).cast("int")


def with_row_draw(df: DataFrame, id_col: str, key: Column, name: str) -> DataFrame:
    """``df`` with a draw in [0, 1) per row in the column ``name``, from the id and ``key``, the hash
    of its text. Rows equal in both get evenly spread draws by their places in the table."""
    own, place, again = fresh(df, "_own"), fresh(df, "_place"), fresh(df, "_again")
    rows = df.withColumn(own, F.xxhash64(F.col(id_col), key)).withColumn(place, F.monotonically_increasing_id())
    repeated = df.select(F.xxhash64(F.col(id_col), key).alias(own)).groupBy(own).agg(F.count(F.lit(1)).alias(again)).where(F.col(again) > 1)
    row, task = F.col(place).bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright(place, 33)
    shift = F.when(F.col(again).isNull(), F.lit(0.0)).otherwise(row * F.lit(GOLDEN) + task * F.lit(PLASTIC))
    rows = rows.join(repeated, own, "left")
    spread = F.shiftrightunsigned(own, 11) / F.lit(float(1 << 53)) + shift
    return rows.withColumn(name, spread - F.floor(spread)).drop(own, place, again)


def rates(df: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "quality", by_row: bool = False) -> DataFrame:
    """``(<id>, tokens, domain, posterior, rate, copies)`` per row of ``df``: the likeliest
    domain, the posteriors in the order of the sorted targets, the rate and its rounding.

    Null and empty texts have no tokens and the rate of their features. Null ids are never
    labelled. Repeated rows have equal rates. Rows of one id are rounded alike or, with
    ``by_row``, each on its own. Other columns are not read; empty tables give no rows.
    """
    rows = Written(features(df, id_col, text_col, by_row), "features").df
    mixture = fit(rows, labels, targets, id_col, domain_col)
    out = rows.withColumn("posterior", mixture.posterior({n: F.col(f"_bin_{n}") for n in mixture.logs}))
    best = F.element_at(F.array(*[F.lit(d) for d in mixture.domains]), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    out = out.withColumn("rate", F.round(mixture.rate(F.col("posterior")), 6))
    if by_row:
        out = with_row_draw(out, "_id", F.col("_key"), "_draw")
    many = F.floor(F.col("rate") + F.col("_draw")).cast("int") if by_row else copies(F.col("_id"), F.col("rate"))
    return out.select(F.col("_id").alias(id_col), F.col("_tokens").alias("tokens"), best.alias("domain"), "posterior", "rate", many.alias("copies"))


def mix(df: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "quality", by_row: bool = False) -> DataFrame:
    """``df`` with every row as often as its rate says, not at all for 0 copies; all columns kept.
    ``by_row`` as in ``rates``."""
    rows = Written(features(df, id_col, text_col), "features").df
    mixture = fit(rows, labels, targets, id_col, domain_col)
    held, taken = fresh(df, "_bins"), fresh(df, "_taken")
    bins = F.struct(*[c.alias(n) for n, (c, _) in surface(F.col(text_col)).items()])
    # exploding an array of one keeps the optimizer from repeating the features where they are used
    drawn = fresh(df, "_draw")
    out = with_row_draw(df, id_col, F.xxhash64(text_col), drawn) if by_row else df
    out = out.withColumn(held, F.explode(F.array(bins)))
    shares = mixture.posterior({n: F.col(held)[n] for n in mixture.logs})
    rate = F.round(mixture.rate(shares), 6)
    many = F.floor(rate + F.col(drawn)).cast("int") if by_row else copies(F.col(id_col), rate)
    out = out.withColumn(taken, F.explode(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
