"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, for edges (a, b).

    Each round takes the least label of the neighbours and then that label's own
    label, so long paths halve; the rounds end when nothing changes.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("l").alias("was"), F.least("l", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("l").alias("far"))
        new = saved(spread.join(jump, "m", "left").select("node", "was", F.least("m", "far").alias("l")), "labels")
        moved = new.filter("l <> was").limit(1).count()
        labels = new.select("node", "l")
        if not moved:
            return labels.select("node", F.col("l").alias("component"))
