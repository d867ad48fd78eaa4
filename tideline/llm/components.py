"""Connected components of a table of links, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import checkpointed


def _tied_to_smallest(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step: the neighbors of each node move to its smallest neighbor.

    ``upward``: all neighbors are seen and the larger ones move (large star), else the
    smaller ones are seen and move with the node itself (small star). The minimum is
    pre-aggregated, so a node with very many links is no single task's group.
    """
    seen = edges if not upward else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = seen.join(least, "u")
    if upward:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each linked node and the smallest node that it reaches.

    Nodes may be of any type that has an order. Links to oneself and null ends are ignored,
    repeated ones count once. The number of rounds grows with the logarithm of the longest
    path; more than ``max_rounds`` raise an error.
    """
    edges = checkpointed(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        edges = checkpointed(_tied_to_smallest(_tied_to_smallest(edges, True), False))
        # edges are distinct: their number and 128 bits of their hashes tell whether any has moved
        state = edges.agg(F.count(F.lit(1)), *[F.bit_xor(F.xxhash64(F.lit(f"edge {k}"), "u", "v")) for k in (1, 2)]).first()
        if state == seen:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = state
    raise RuntimeError("links did not settle")
