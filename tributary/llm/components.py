"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import common


def connected(links: DataFrame) -> DataFrame:
    """links(a, b), longs, undirected, to (node, component): the smallest node of each component.

    Every round takes the smallest label among neighbours, then the label's own label; both are joins and partial
    minimums, and each round's labels are written to the shared folder. Self-links name nodes without partners."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = common.stash(both.filter("a is not null and b is not null").distinct(), "links")
    labels = common.stash(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = step.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component"))
        last, step = labels, common.stash(step, "labels")
        common.free(last)
        if step.filter("old <> component").isEmpty():
            common.free(edges)
            return step.drop("old")
        labels = step
