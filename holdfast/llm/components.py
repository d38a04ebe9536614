"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import cut_lineage


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one lower end at most and no lower end has one of its own."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = both.filter("b > a").join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its lower neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """One row (node, root) per node that is not itself the least of its component.

    Ids are of any ordered type; rows with a null end and self-loops say nothing. A hub is never
    gathered: its least neighbour comes from a partial aggregate and goes back by a join whose hot
    partitions adaptive execution splits. Every round is written to the shared folder, so a lost
    executor costs one round; the rounds end when the edges are stars.
    """
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now, "edges")
    while not _stars(now):
        now = cut_lineage(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
