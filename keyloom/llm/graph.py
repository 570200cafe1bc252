"""Connected components by label propagation with hooking and pointer jumping; a row an edge or node, nothing gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of the undirected links (a, b); nodes without links aren't in it.

    Every round a node and the node it points at take the least label next to them, then labels jump to their label's
    label; rounds go with the logarithm of the diameter. Joins by a hub are such that adaptive execution can split them.
    """
    edges = scratch.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = scratch.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = scratch.write(
            edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("seen")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("seen").alias("seen"))
            .join(labels, "node")
        )
        moved = near.where("seen < component")
        if moved.isEmpty():
            return labels
        hooked = moved.select("node", F.col("seen").alias("to")).unionByName(moved.select(F.col("component").alias("node"), F.col("seen").alias("to")))
        down = scratch.write(
            labels.join(hooked.groupBy("node").agg(F.min("to").alias("to")), "node", "left").select("node", F.least("component", "to").alias("component"))
        )
        jump = down.select(F.col("node").alias("component"), F.col("component").alias("to"))
        labels = scratch.write(down.join(jump, "component", "left").select("node", F.least("component", "to").alias("component")))


def labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component for pruning: equal components are connected, connected nodes may still differ. One round only:
    the least node next to a node, and what that one points to."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    jump = near.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return near.join(jump, "component").select("node", F.col("to").alias("component"))
