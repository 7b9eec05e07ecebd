"""Connected components of links between documents, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """`links(a long, b long)` -> `(node, component)`: the smallest node reachable, for every node with a link.

    Each round gives a node the smallest label among its neighbours' and its own, then lets every label take
    over the label of the node it names, which halves the distance left. Labels only shrink, so rounds end when
    none does; each round's labels are written to the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = lower.join(of_label, "component", "left").select("node", "old", F.least("component", F.coalesce("jump", "component")).alias("component"))
        new = materialize(new, "labels")
        changed = new.where("component <> old").limit(1).count()
        drop_table(labels)
        labels = new.select("node", "component")
        if not changed:
            drop_table(both)
            return labels
