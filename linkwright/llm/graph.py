"""Connected components of an edge table by smallest label, with pointer jumps, as joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Self links, repeats and either direction are fine; nulls are ignored. Each round takes the smallest label among a node's
    neighbours, then that label's own label, so long chains shrink geometrically. Every round is a written table; only
    the question whether a label changed comes to the driver. A hot node is pre-aggregated before its shuffle, and
    the joins have an exchange on either side, so that skewed partitions can be split.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        own = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("over"))
        stepped = written(own.join(jump, own.new == jump.at, "left").select("node", "old", F.least("new", "over").alias("component")), "labels")
        changed = not stepped.where("component <> old").isEmpty()
        forget(labels)
        labels = stepped.select("node", "component")
        if not changed:
            forget(edges)
            return labels
