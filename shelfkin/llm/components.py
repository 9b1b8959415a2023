"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below go to the smallest of them; ``b`` is below ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it can reach.

    Edges may repeat and point either way; nulls and loops are ignored.  Each round is
    written to the shared folder, so a lost executor costs one round at most.  Only
    edges move: minima are combined before the shuffle, and joins on a node with very
    many edges are left to the adaptive skew join.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, purpose)
    state = _state(now)
    while True:
        now = materialize(_small_star(_large_star(now)), purpose)
        after = _state(now)
        if after == state:
            break
        state = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
