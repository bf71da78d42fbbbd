"""Jump consistent hashing: a key's shard follows from the key and the number of shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import fresh

# Fixed values of the published algorithm: its generator's factor, and 2^31.
FACTOR = 2862933555777941757
SPAN = float(1 << 31)

ROWS_PER_CELL = 200_000


def jump_buckets(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards``; expected ``ln(shards)`` vector steps."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(FACTOR) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((shard[live] + 1).astype(np.float64) * (SPAN / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def key_bits(key: str | Column) -> Column:
    """60 well-mixed bits of a key of any type, from its text; a null key counts as the text ''."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def jump_shard(key: str | Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a key, as a column; with ``shards + 1`` a key stays or
    moves to the new shard, the necessary ``1 / (shards + 1)`` of all keys."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf(T.IntegerType())
    def place(bits: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(bits.to_numpy(), shards).astype(np.int32))

    return place(key_bits(key))


def with_shards(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``df`` and its shard column (an existing column of that name is replaced). A
    projection: no shuffle, all rows and columns kept, equal keys share a shard, null keys too."""
    return df.withColumn(name, jump_shard(key, shards))


def with_slots(df: DataFrame, by: str, name: str = "slot", rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Number the rows of each ``by`` from 0 without gaps, in the order of the MD5 of the row.

    Equal rows are counted before the shuffle, so a row that a third of the table repeats
    costs one row there. Cells are equal ranges of the MD5, as many as the row count asks
    for; a cell is sorted on its own and starts where the smaller cells of its shard end.
    Rows that are equal in all columns are interchangeable. Empty tables give no rows.
    """
    columns = df.columns
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns]
    own = {n: fresh(df, f"_{n}") for n in ("copies", "order", "cell", "before", "rows", "by", "in", "start", "from", "till", "nth")}
    mixed = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias(own["copies"]))
    mixed = mixed.withColumn(own["order"], F.md5(F.concat_ws(":", *texts).cast("binary")))
    bits = max(0, int(df.count() // rows_per_cell).bit_length())
    mixed = mixed.withColumn(own["cell"], F.shiftright(F.conv(F.substring(own["order"], 1, 8), 16, 10).cast("long"), 32 - bits))
    cell = Window.partitionBy(by, own["cell"]).orderBy(own["order"], *[F.col(f"`{c}`") for c in columns])
    within = mixed.withColumn(own["before"], F.sum(own["copies"]).over(cell) - F.col(own["copies"]))
    sizes = mixed.groupBy(by, own["cell"]).agg(F.sum(own["copies"]).alias(own["rows"]))
    below = Window.partitionBy(by).orderBy(own["cell"])  # one row per cell
    starts = sizes.select(F.col(by).alias(own["by"]), F.col(own["cell"]).alias(own["in"]), (F.sum(own["rows"]).over(below) - F.col(own["rows"])).alias(own["start"]))
    placed = within.join(starts, within[by].eqNullSafe(starts[own["by"]]) & (within[own["cell"]] == starts[own["in"]]))
    first = F.col(own["start"]) + F.col(own["before"])
    # a row repeated millions of times is written out from several tasks
    step = F.lit(rows_per_cell).cast("long")
    parts = placed.withColumn(own["from"], F.explode(F.sequence(F.lit(0).cast("long"), F.col(own["copies"]) - 1, step)))
    many = parts.where(F.col(own["copies"]) == 1).withColumn(name, first)
    rest = parts.where(F.col(own["copies"]) > 1).repartition(own["order"], own["from"]).withColumn(own["till"], F.least(F.col(own["from"]) + step, F.col(own["copies"])) - 1)
    rest = rest.withColumn(own["nth"], F.explode(F.sequence(own["from"], own["till"]))).withColumn(name, first + F.col(own["nth"]))
    keep = [F.col(f"`{c}`") for c in columns if c != name] + [F.col(name)]
    return many.select(*keep).unionByName(rest.select(*keep))


def write_shards(df: DataFrame, path: str, key: str, shards: int, files_per_shard: int = 1) -> None:
    """Write one folder ``shard=<n>`` per shard, each in ``files_per_shard`` files or fewer."""
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    part = fresh(df, "_part")
    out = with_shards(df, key, shards).withColumn(part, spread)
    out.repartition("shard", part).drop(part).write.partitionBy("shard").parquet(path)
