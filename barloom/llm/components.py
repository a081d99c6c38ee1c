"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lookup
from barloom.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node next to it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = lookup(both, ["a"], F.min("b").alias("low")).select(F.col("a"), F.least("a", "low").alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (``a`` is above ``b``)."""
    least = lookup(edges, ["a"], F.min("b").alias("low"))
    moved = edges.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with an edge; the root is the smallest node that can be reached.

    ``edges`` has bigint ``a, b`` with ``a <> b`` in either order and any number of times.  Each round is written to the shared
    folder; the rounds grow with the logarithm of the longest path.  Joins are on the smallest neighbour, one row
    for each node, so a hub is aggregated on the map side and its edges can be split.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)).alias("x")).first()
        if sign == (mark["n"], mark["x"]):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        sign = (mark["n"], mark["x"])
        now = cut(_small_star(_large_star(now)))
