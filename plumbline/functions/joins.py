"""Joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import BROADCAST_ROWS


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left key columns."""
    keyed = right.select(
        *[F.col(c).alias(f"_key_{c}") if c in on else F.col(c) for c in right.columns]
    )
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(keyed[f"_key_{c}"])
    return left.join(keyed, match, how).drop(*[f"_key_{c}" for c in on])


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than ``limit + 1``."""
    return df.limit(limit + 1).count() <= limit


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    weight: str | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``df`` to a table with unique keys.

    Small tables are broadcast after a count. Otherwise, if ``weight`` names the number
    of rows each key has in ``df``, the heaviest keys (at most ``limit``, by count) are
    broadcast and only the light rest is shuffled; no row is dropped either way.
    """
    on = list(on)
    if small_enough(table, limit):
        out = table.drop(weight) if weight else table
        return df.join(F.broadcast(out), on, how)
    if weight is None:
        return df.join(table, on, how)
    total = table.agg(F.sum(weight)).first()[0] or 0
    cut = total / limit
    heavy = table.where(F.col(weight) > cut).drop(weight)
    light = table.where(F.col(weight) <= cut).drop(weight)
    on_heavy = df.join(F.broadcast(heavy), on, "inner")
    on_light = df.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return on_heavy.unionByName(on_light)
