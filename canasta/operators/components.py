"""Connected components by joins: smallest labels spread along the edges and jump over labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node that it reaches) of all nodes of the edges; rows with a null end are left out, an edge from a node to itself names a node alone.

    A step is an equi-join of the edges with the labels of the step before, aggregated with map-side combining,
    then a join of labels with labels, so that chains halve. Each step is written to the shared folder and the
    one before deleted.
    """
    there = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = written(there.union(there.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        over = spread.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = written(spread.join(over, "component").select("node", F.col("next").alias("component"), (F.col("next") != F.col("was")).alias("moved")), "labels")
        dropped(labels)
        labels = step.select("node", "component")
        labels.written_at = step.written_at
        if step.where("moved").isEmpty():
            dropped(both)
            return labels
