"""Connected components by large-star and small-star steps, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import beside, dropped, written


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _is_star_forest(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degrees = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return degrees.where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Edges (a, b) of any comparable type to (node, root): the least node that each node reaches.

    Self-loops are ignored, as are edges with a null end; nodes without edges don't appear.  Each round is written to
    the shared folder, so a lost executor costs one round at most.  The number of rounds grows with the logarithm of
    the longest path.  Least neighbours are aggregated within tasks first, and written; edges are joined to that table by plain exchanges, so
    that adaptive execution splits the edges of a node that has many, or by a broadcast where it has few rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        # large star: each neighbour that is greater than a node moves to the least node around it
        both = _both(now)
        around = written(_least(both))
        large = written(both.join(beside(around), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: each smaller neighbour, and the node itself, moves to the least one
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(beside(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # a forest of stars: every node has one edge, to a node that has none
        done = _is_star_forest(step)
        dropped(now, around, large, least)
        now = step
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components are not closed after {max_rounds} rounds")
