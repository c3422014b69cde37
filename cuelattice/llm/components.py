"""Connected components by repeated hooking and contraction, all of it in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the undirected edges (src, dst); root is the least node reachable.

    Each round hooks every node to its least neighbour (a partial aggregation, so a hub costs no task
    more than its share), flattens the trees by pointer jumping and contracts the edges to the roots.
    The number of nodes at least halves with each round. Every step is a written table: a lost executor
    costs the running step only, and the joins read two plain tables, whose hot keys Spark can split.

    Null ends and loops are ignored; no edges give no rows.
    """
    edges = scratch.write(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        tree = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
        tree = scratch.write(tree.select("node", F.least("least", "node").alias("root")), "hooks")
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = scratch.write(tree.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jumps")
            tree = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = tree
        else:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = scratch.write(labels.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        ends = edges
        for side in ("src", "dst"):
            ends = ends.join(tree.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side)
        left = scratch.write(ends.select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).where("src <> dst").distinct(), "edges")
        if left.isEmpty():
            return labels
        edges = left
