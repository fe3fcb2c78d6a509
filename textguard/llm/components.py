"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.scratch import written


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; ``root`` is the smallest node reachable.

    Rounds of hooking to the smallest neighbour: in a large-star round every larger neighbour of
    a node is linked to the smallest node near it, in a small-star round every smaller one is.
    The number of links never grows, stars are the fixed point, and the number of rounds grows
    with the logarithm of the longest chain. Joins are plain equality joins, so that a node with
    very many neighbours can be split by Spark. Links written by each round cut the lineage.
    """
    edges = written(_both_apart(links), "links")
    while not _stars(edges):
        edges = written(_small_star(_large_star(edges)), "links")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return counted.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


def _both_apart(links: DataFrame) -> DataFrame:
    """Each link once, larger node first; loops fall away."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("least"))
    least = written(least, "least")  # a side that ends in an aggregate keeps Spark from splitting a hot node
    joined = around.join(least, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Here every link has its larger node first."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    joined = edges.join(least, "a")
    moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()
