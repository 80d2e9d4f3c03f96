"""Connected components by joins: labels fall along edges, are hooked onto roots, and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges(a, b)``; the label is the smallest node that can be reached.

    The number of rounds grows with the logarithm of a component's longest path. Minima are partial aggregates, so a node with many edges
    sends one row per task.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        ends = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("label_a")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("label_b")), "b").filter("label_a > label_b")
        offers = ends.select(F.explode(F.array("a", "label_a")).alias("node"), F.col("label_b").alias("offer")).groupBy("node").agg(F.min("offer").alias("offer"))
        lower = labels.join(offers, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("next"), F.col("label").alias("old"))
        lower = stage(lower)
        jumped = lower.join(lower.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old")
        jumped = stage(jumped)
        labels = jumped.select("node", "label")
        if jumped.filter("label != old").isEmpty():
            return labels
