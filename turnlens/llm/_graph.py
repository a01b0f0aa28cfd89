"""Connected components of a distributed edge list (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpoint


def _state(edges: DataFrame) -> tuple:
    """Count and order-free fingerprint of an edge list."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to its smallest neighbour. Edges have a < b."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint); component is the smallest node reachable.

    Union-find by joins: each round hooks neighbours to the smallest node they see, and group minima are combined
    before the shuffle, so a hub costs one row a task. Each round is checkpointed; it ends when a round changes nothing.
    Self-loops, repeated and reversed edges do no harm; an empty edge list gives an empty result.
    """
    now = checkpoint(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    )
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = checkpoint(_small_star(_large_star(now)))
        then, seen = seen, _state(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
