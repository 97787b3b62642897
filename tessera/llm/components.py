"""Connected components of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of the links (a, b).

    Labels start as the smallest neighbour or the node itself; each round takes the smallest
    label among neighbours and then the label's label, so rounds grow with the logarithm of a
    component's width. Sums by node are pre-aggregated, and labels are tables in the shared
    folder.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = materialise(labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")), "lower")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        nearer = materialise(lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "was"), "labels")
        release(links.sparkSession, lower, labels)
        labels = nearer
        if not nearer.where(F.col("component") != F.col("was")).limit(1).count():
            release(links.sparkSession, both)
            return labels
