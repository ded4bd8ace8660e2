"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import pin


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so a chain of n nodes needs about log n rounds; the
    labels are written to the shared folder after each.
    """
    both = pin(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low")).select("node", F.least("node", "_low").alias("component")))
    while True:
        lowest = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_low"))
        step = labels.join(lowest, "node").select("node", F.col("component").alias("_was"), F.least("component", "_low").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        moved = pin(step.join(up, "component", "left").select("node", "_was", F.least("component", F.coalesce("_up", "component")).alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("component <> _was").isEmpty():
            return labels
