"""Connected components of a graph of integer nodes, by alternating star contraction in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's neighbours (the larger ones, or the others) point to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # a: the node; b: its neighbour. Small stars look at neighbours under the node only: edges hold b < a.
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        least = cut_lineage(least)  # a hub has many neighbours: a plain join, whose large partitions Spark can split
    moved = both.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node that it reaches.

    ``edges`` has two long columns, a and b, in either direction. Every round is written to the checkpoint folder;
    rounds stop when nothing changes (after a logarithmic number of them; ``most`` guards against a fault).
    Self edges, repeated edges and an empty table are fine.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most):
        then = cut_lineage(_stars(_stars(now, large=True), large=False))
        seen = then.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).head()
        now = then
        if (seen["n"], seen["x"]) == state:
            break
        state = (seen["n"], seen["x"])
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
