"""Connected components of a graph of longs, as rounds of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.plans.session import remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the least node.

    Large-star and small-star rounds (alternating; their number grows with the logarithm of
    the largest component) until the edges form stars. Every round is written to the shared
    folder, so the plan stays short and a lost executor costs one round at most. Least
    neighbours are aggregated before anything is joined, and the joins are of a kind that
    adaptive execution splits where a node has very many neighbours.
    """
    rows = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(rows, "edges")
    state = _state(now)
    while state[0]:
        large = written(_large_star(now).distinct(), "large")
        small = written(_small_star(large).distinct(), "small")
        remove(now)
        remove(large)
        now, before = small, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
