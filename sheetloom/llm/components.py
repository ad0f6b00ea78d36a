"""Connected components of a links table, by labels that shrink and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    `links` is (a, b), in any direction, repeats allowed. Each round gives a node the smallest
    label around it and then that label's own label, so the number of rounds grows with the
    logarithm of a component's width rather than with its width. Sums by key are combined before
    they are shuffled. Both joins stand between settled tables: where many links meet in one
    node, or many nodes point to one label, the adaptive skew join splits that side.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = settle(both)
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).select("a", "component").groupBy("a").agg(F.min("component").alias("seen"))
        step = settle(labels.join(seen, labels["node"] == seen["a"]).select("node", "component", F.least("component", "seen").alias("next")))
        # only nodes that others point to are asked for their own label
        asked = step.select(F.col("next").alias("via")).distinct()
        jump = settle(step.select(F.col("node").alias("via"), F.col("next").alias("far")).join(asked, "via", "left_semi"))
        step = settle(step.join(jump, step["next"] == jump["via"]).select("node", "component", "far"))
        labels = step.select("node", F.col("far").alias("component"))
        if step.where("component <> far").isEmpty():
            return labels
