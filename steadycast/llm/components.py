"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadycast.llm.common import store


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), each once: neighbours are hung on the least node around.

    A large star moves the greater neighbours of a node, a small star the lesser ones and itself.
    The least neighbour is an aggregate that combines before its shuffle, so a hub costs little.
    """
    if large:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its least node.

    The rounds grow with the logarithm of the nodes at most. Edges of a node to itself and
    repeated ones do no harm; without edges the result is empty.
    """
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        # Done when every edge leads to a root, that is to a node which hangs on no other.
        roots = edges.select(F.col("a").alias("b")).distinct()
        twice = edges.groupBy("a").count().where("count > 1")
        if edges.join(roots, "b", "left_semi").isEmpty() and twice.isEmpty():
            break
        edges = store(_stars(_stars(edges, True), False), "edges")
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return hung.union(edges.select("b", "b").distinct())
