"""Connected components of a table of links, in rounds of joins; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Written


def _checksum(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(links: DataFrame) -> tuple[DataFrame, Written]:
    """``(node, root)`` of every node of ``links(a, b)``: the smallest node reachable.

    Large-star and small-star rounds until the links form stars. A node with very many
    links only meets others through a minimum (combined before the shuffle) and a join
    whose large side adaptive execution may split. Each round is one written table. Null
    ends and loops are left out; no links give no rows. The second value owns the files.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    step = Written(edges.where("a > b").distinct(), "links")
    seen = _checksum(step.df)
    while True:
        both = step.df.unionByName(step.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour moves to the smallest neighbour
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        # all smaller neighbours of a node move to the smallest of them
        moved = large.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = Written(moved.select("e.a", "e.b").where("a > b").distinct(), "links")
        step.delete()
        step, before = after, seen
        seen = _checksum(step.df)
        if seen == before:
            break
    roots = step.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return step.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), step
