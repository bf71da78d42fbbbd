"""Order-based building blocks that never sort a whole table in one task.

* ``exact_quantiles``  - exact order statistics from a sketch plus one narrow recount
* ``quantiles_of_counts`` - the same from counts per value, where the values are few
* ``running_totals``   - prefix sums over a global or per-group order
* ``carry_forward``    - last known value along an order, split over buckets
* ``dense_index``      - position of each value in sorted order
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.joins import null_safe_join
from plumbline.session import materialize

SKETCH_ACCURACY = 20_000
CELLS = 64
ROWS_PER_RANGE = 1_000_000
FEWEST_PER_RANGE = 20_000


# ---------------------------------------------------------------- exact quantiles

def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    probabilities: Sequence[float],
    value: str = "value",
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Linear-interpolated quantiles per key, as ``(keys, n, quantiles ARRAY<DOUBLE>)``.

    A quantile sketch brackets every wanted rank, with a margin of several times its
    error; groups too small for the margin to span whole ranks take a wider bracket, or
    all their values. Rows below a bracket are only counted; only rows inside one are
    shuffled, already grouped by value, so ties collapse. A rank outside its bracket
    would fail the job rather than give a wrong value.

    ``keys`` must be few (columns, features, classes): the bracket table has one row per
    key and is broadcast. Without keys the single row is a scalar subquery.
    """
    keys = list(keys)
    probabilities = [float(p) for p in probabilities]
    count = len(probabilities)
    margins = (4.0 / accuracy, 80.0 / accuracy)
    enough = (10 * accuracy, accuracy // 5)
    asked = [0.0, 1.0]
    for margin in margins:
        asked += [max(0.0, p - margin) for p in probabilities] + [min(1.0, p + margin) for p in probabilities]
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))

    sketch = rows.groupBy(*keys).agg(
        F.count("value").alias("n"), F.percentile_approx("value", asked, accuracy).alias("marks")
    )

    def bound(slot: int, side: int) -> Column:
        places = [3 + 2 * count * level + side * count + slot for level in range(len(margins))]
        return (
            F.when(F.col("n") > enough[0], F.element_at("marks", places[0]))
            .when(F.col("n") > enough[1], F.element_at("marks", places[1]))
            .otherwise(F.element_at("marks", side + 1))
        )

    sketch = sketch.select(
        *keys,
        "n",
        F.array(*[bound(i, 0) for i in range(count)]).alias("lows"),
        F.array(*[bound(i, 1) for i in range(count)]).alias("highs"),
    )
    if keys:
        bounded = rows.join(F.broadcast(sketch), keys)
    else:
        one = sketch.select(F.struct("n", "lows", "highs").alias("s")).scalar()
        bounded = rows.withColumn("_s", one).select("value", "_s.n", "_s.lows", "_s.highs")
    lo = [F.element_at("lows", i + 1) for i in range(count)]
    hi = [F.element_at("highs", i + 1) for i in range(count)]

    below = bounded.groupBy(*keys, "n").agg(
        *[F.sum((F.col("value") < lo[i]).cast("long")).alias(f"below{i}") for i in range(count)]
    )
    below = below.select(
        *keys,
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("slot"),
                        F.lit(-1).alias("cell"),
                        F.lit(None).cast("double").alias("value"),
                        F.col(f"below{i}").alias("cnt"),
                    )
                    for i in range(count)
                ]
            )
        ),
    )
    hits = [(F.col("value") >= lo[i]) & (F.col("value") <= hi[i]) for i in range(count)]
    width = [hi[i] - lo[i] for i in range(count)]
    cells = [
        F.when(width[i] > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("value") - lo[i]) / width[i] * CELLS).cast("int")))
        .otherwise(F.lit(0))
        for i in range(count)
    ]
    any_hit = reduce(lambda a, b: a | b, hits)
    places = F.array_compact(
        F.array(*[F.when(hits[i], F.struct(F.lit(i).alias("slot"), cells[i].alias("cell"))) for i in range(count)])
    )
    inside = (
        bounded.where(any_hit)
        .select(*keys, "n", "value", F.inline(places))
        .groupBy(*keys, "n", "slot", "cell", "value")
        .agg(F.count("*").alias("cnt"))
    )
    counted = below.unionByName(inside.select(*below.columns))

    # A bracket is cut into equal cells: their totals show which one or two hold the rank,
    # and only those are sorted.
    shares = F.array(*[F.lit(p) for p in probabilities])
    at = F.element_at(shares, F.col("slot") + 1) * (F.col("n") - 1)
    before = Window.partitionBy(*keys, "slot").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    totals = counted.groupBy(*keys, "n", "slot", "cell").agg(F.sum("cnt").alias("total"))
    totals = totals.withColumn("end", F.sum("total").over(before)).withColumn("at", at)
    wanted = totals.where((F.col("end") > F.floor("at")) & (F.col("end") - F.col("total") <= F.floor("at") + 1))
    wanted = wanted.select(*keys, "slot", "cell", "at", (F.col("end") - F.col("total")).alias("skipped"))
    along = Window.partitionBy(*keys, "slot", "cell").orderBy(F.col("value").asc_nulls_first())
    upto = F.col("skipped") + F.sum("cnt").over(along.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.join(F.broadcast(wanted), [*keys, "slot", "cell"]).withColumn("upto", upto)
    picked = ranked.groupBy(*keys, "n", "slot", "at").agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col("value"))).alias("x0"),
        F.min(F.when(F.col("upto") > F.floor("at") + 1, F.col("value"))).alias("x1"),
        F.bool_or(F.col("value").isNull()).alias("missed"),
    )
    fail = F.raise_error(F.lit("quantile bracket missed"))
    missed = F.col("missed") | F.col("x0").isNull() | (F.col("x1").isNull() & (F.floor("at") + 1 < F.col("n")))
    picked = picked.withColumn("x0", F.when(missed, fail).otherwise(F.col("x0")))
    part = _interpolated(F.col("x0"), F.col("x1"), F.col("at"))
    return picked.groupBy(*keys, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", part.alias("q")))), lambda s: s["q"]).alias("quantiles")
    )


def _interpolated(x0: Column, x1: Column, at: Column) -> Column:
    return x0 + (F.coalesce(x1, x0) - x0) * (at - F.floor(at))


def quantiles_of_counts(
    rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float], value: str = "value"
) -> DataFrame:
    """The result of ``exact_quantiles`` for keys of few distinct values each.

    Tasks count their rows per value before the shuffle, and one row per value is ranked, so
    a key's window has as many rows as it has values, however many rows there are.
    """
    keys = list(keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("cnt"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    along = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(*keys, "value", F.sum("cnt").over(whole).alias("n"), F.sum("cnt").over(along).alias("upto"))

    def quantile(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("n") - 1)
        x0, x1 = (F.min(F.when(F.col("upto") > F.floor(at) + i, F.col("value"))) for i in (0, 1))
        return _interpolated(x0, x1, at)

    return ranked.groupBy(*keys, "n").agg(F.array(*[quantile(p) for p in probabilities]).alias("quantiles"))


# ---------------------------------------------------------------- range buckets

def range_count(rows: int, per_range: int, shuffle_partitions: int) -> int:
    """As many ranges as the rows ask for; few rows are spread over the shuffle partitions."""
    return max(1, -(-rows // per_range), min(shuffle_partitions, -(-rows // FEWEST_PER_RANGE)))


def in_ranges(df: DataFrame, order: Sequence[str], per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` written in ranges of about ``per_range`` rows along ``order``, with the number of
    the range in ``_bucket`` and a last tie key in ``_tie``.

    The rows are written once with the tie key, which fixes their order, then dealt by range
    of all order columns and the tie key: rows equal in the order columns, or with NULL there, spread
    over as many ranges as their number asks for. What is read back is files, so a
    lost executor cannot change where a range ends.
    """
    kept = materialize(df.withColumn("_tie", F.monotonically_increasing_id()), "order")
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = range_count(kept.count(), per_range, shuffle)
    dealt = kept.repartitionByRange(parts, *[F.col(c) for c in order], F.col("_tie"))
    return materialize(dealt.withColumn("_bucket", F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, str],
    groups: Sequence[str] = (),
    per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add inclusive running sums ``{output: input}`` along ``order`` within ``groups``.

    A two-pass scan: each range of ``in_ranges`` is summed locally, and the range totals - one
    row per group and range - give the offsets, so neither the whole order, nor a hot
    group, nor a third of equal or NULL order values ever sits in one task. Rows equal in
    ``order`` take some order among themselves.
    """
    order, groups = list(order), list(groups)
    cut = in_ranges(df, order, per_range)
    totals = cut.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
    before = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *groups,
        "_bucket",
        *[F.sum(f"_sum_{o}").over(before).alias(f"_off_{o}") for o in sums],
    )
    local = Window.partitionBy(*groups, "_bucket").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.select("*", *[F.sum(c).over(local).alias(f"_run_{o}") for o, c in sums.items()])
    joined = null_safe_join(summed, offsets, [*groups, "_bucket"])
    # NULL only while no value has been met, in this range or before it
    whole = {o: F.coalesce(F.col(f"_run_{o}") + F.col(f"_off_{o}"), f"_run_{o}", f"_off_{o}") for o in sums}
    return joined.select(*df.columns, *[c.alias(o) for o, c in whole.items()])


def carry_forward(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    groups: Sequence[str] = (),
    backward: bool = False,
    per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Fill NULLs from the last known value along ``order`` (or the next, if backward).

    ``order`` must be unique within a group. A range's last known value is one row, and
    only those rows travel to later ranges.
    """
    order, groups = list(order), list(groups)
    cut = in_ranges(df, order, per_range)
    key = F.struct(*order, "_tie")
    pick = F.min_by if backward else F.max_by
    edges = cut.groupBy(*groups, "_bucket").agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_edge_{c}") for c in columns]
    )
    sort = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    before = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy(sort("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *groups, "_bucket", *[F.last(f"_edge_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns]
    )
    local = (
        Window.partitionBy(*groups, "_bucket")
        .orderBy(*[sort(c) for c in (*order, "_tie")])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    known = cut.select("*", *[F.last(c, ignorenulls=True).over(local).alias(f"_known_{c}") for c in columns])
    filled = null_safe_join(known, carried, [*groups, "_bucket"])
    return filled.select(
        *[F.coalesce(f"_known_{c}", f"_in_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def dense_index(values: DataFrame, order: str, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``position`` (0-based) of each row in sorted order; rows must be distinct."""
    counted = running_totals(values.withColumn("_one", F.lit(1)), [order], {"_upto": "_one"}, groups)
    return counted.select(*values.columns, (F.col("_upto") - 1).cast("long").alias("position"))
