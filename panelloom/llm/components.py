"""Connected components of an edge list that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.runtime import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches.

    Alternating large-star and small-star steps (public algorithm: Kiveris et al., 2014), until every node but the least
    has one edge, to it. Each round is written to the shared folder, so lineage stays short and a lost executor costs one
    round; it takes two shuffles, and the test whether it was the last takes one.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        now = current
        current = scratch.save(lambda: _small_star(_large_star(now)), "stars")
        if _are_stars(current):
            break
    # now each edge leads from a node to its component's least node
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges to smaller nodes, or one and another from a larger node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return ends.where("up > 1 or up = 1 and least = 0").limit(1).count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge leads from the larger to the smaller node; one row becomes one at most."""
    own = edges.repartition("a").distinct()  # one shuffle serves both
    own = own.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
    return own.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
