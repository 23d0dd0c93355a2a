"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.checkpoints import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to the least of its component."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    return several.unionByName(inner).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge (a, b); the label is the least node that it reaches.

    A round shortens all paths at once, whatever the degree of a node: minima
    are combined before the shuffle, and Spark splits the joins of a hot node.
    """
    state = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not _stars(state):
        state = checkpoint(_small_star(_large_star(state)))
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def flatten_pointers(pointers: DataFrame) -> DataFrame:
    """(node, target) with every chain of targets shortened to its end; a cycle ends at its least node."""
    found = components(pointers.select(F.col("node").alias("a"), F.col("target").alias("b")))
    ends = pointers.select(F.col("target").alias("node")).join(pointers.select("node"), "node", "left_anti").distinct()
    roots = found.join(ends, "node").groupBy("label").agg(F.min("node").alias("target"))
    return pointers.select("node").join(found, "node").join(roots, "label", "left").select("node", F.coalesce("target", "label").alias("target")).where("node <> target")
