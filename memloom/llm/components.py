"""Connected components of an edge table, on Spark, without a graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` → ``(node, label)``: each node that has an edge, with its component's smallest node.

    Every round takes the smallest label among the neighbours, hooks the node and
    its present root onto it and then jumps one pointer, so the number of rounds
    grows with the logarithm of a component's width. Rounds go through written tables.
    An empty edge table gives an empty result; repeated edges and loops do no harm.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = scratch.save(both)
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("low"))
        )
        lower = scratch.save(labels.join(near, "node").filter("low < label"))
        if lower.isEmpty():
            scratch.drop(lower)
            return labels
        hooks = (
            lower.select("node", "low")
            .union(lower.select(F.col("label").alias("node"), "low"))
            .groupBy("node")
            .agg(F.min("low").alias("low"))
        )
        hooked = scratch.save(
            labels.join(hooks, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"))
        )
        root = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = scratch.save(hooked.join(root, "label").select("node", F.col("root").alias("label")))
        for old in (labels, lower, hooked):
            scratch.drop(old)
        labels = jumped
