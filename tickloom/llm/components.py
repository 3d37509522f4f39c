"""Connected components by alternating star contraction, all in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage, drop_written


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); a component is its smallest node.

    Each round hangs the neighbours of a node on the smallest of them, first the larger and
    then the smaller ones, until nothing changes. Minima are summed before shuffling, so a node
    with many neighbours is no hot group, and its edges are split by the join.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, state = cut_lineage(both, "edges"), None
    while True:
        around = edges.union(edges.select("b", "a"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
        before, edges = edges, cut_lineage(small.select("e.a", F.col("e.m").alias("b")).where("a != b").distinct(), "edges")
        drop_written(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
