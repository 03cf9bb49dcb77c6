"""Connected components of an edge table by label propagation with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Edges are undirected; repeats, both directions and self-loops are harmless, null ends are ignored. No edges: no rows.
    Each round takes neighbours' labels, hooks the old label to the new and jumps one pointer, so the rounds grow with
    the logarithm of the longest path. Labels are a written table after each round; only a count reaches the driver.
    """
    e = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).dropna()
    e = written(e.union(e.select("near", "node")).where("node <> near").distinct(), "edges")
    labels = written(e.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = labels.select(F.col("node").alias("near"), F.col("label").alias("seen"))
        seen = e.join(near, "near").groupBy("node").agg(F.min("seen").alias("seen"))
        took = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        hooks = took.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        # written, so that it is made once, and a giant component's label is a plain shuffled side that Spark can split
        hooked = written(took.join(hooks, "node", "left").select("node", "old", F.least("label", "hook").alias("label")), "hooked")
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = hooked.join(roots, "label").select("node", "old", F.least("label", "root").alias("label"))
        turn = written(jumped, "labels")
        labels = turn.select("node", "label")
        if turn.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
