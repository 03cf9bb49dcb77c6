"""Connected components of an edge table, for groups that hang together through several keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, spill: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every node of edges(a, b): component is the smallest node reachable.

    Large and small stars in turn: every node hands its larger neighbours, then its smaller ones, to the smallest. The edges never grow
    in number, and the turns grow with the logarithm of the longest path. Each turn is one smallest neighbour a node, joined back to its
    edges, so that a node with very many neighbours is never gathered. spill(df) cuts the lineage. Null ends and loops are left out.
    """
    links = spill(edges.select("a", "b").dropna().where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = spill(large.distinct())
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("x"), F.col("m")).union(least.select("a", "m"))
        links = spill(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 20))).first()
        if state == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
        seen = state
