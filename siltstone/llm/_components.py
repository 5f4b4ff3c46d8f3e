"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._store import discard, heavy_join, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node next to it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("copies")), "least")
    out = settle(heavy_join(both.filter("v > u"), least, "u", "copies").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    least = settle(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("copies")), "least")
    moved = heavy_join(edges, least, "a", "copies").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    out = settle(moved.select("e.*").filter("a <> b").distinct(), "edges")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Large-star and small-star steps in turn, until the edges are stars around
    the least node of each component; edges are (larger, smaller) throughout.
    A star takes two rounds whatever its size, a path a logarithm of its length.
    Rounds are written down, so none is recomputed; nodes with very many edges
    are handled where their edges are.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == before:
            break
        before, large = state, _large_star(edges)
        discard(edges)
        edges = _small_star(large)
        discard(large)
    centre = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centre.select("b", F.col("b").alias("component")))
