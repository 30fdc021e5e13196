"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) for each node that has a link.

    links: columns hi and lo, hi > lo. Each round hangs every node's larger
    neighbours, then its smaller ones, on its smallest neighbour, until each
    node has one link, to its root. Every step is written to the shared
    checkpoint folder, so that joins meet plain shuffles, of which adaptive
    execution splits a hub's; only a count and a sum reach the driver.
    """
    links = cut(links.where("hi > lo").distinct())
    seen = None
    for _ in range(rounds):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
        down = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = cut(lowest.select("hi", F.col("m").alias("lo")).union(down).distinct())
        state = links.agg(F.count("*").alias("n"), F.countDistinct("hi").alias("nodes"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"no fixed point within {rounds} rounds")
