"""Relationship graphs: depth, cycles, descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

MOST_DEPTH = 64


def depths(edges: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    """(node, depth) of every node of a graph (parent, child): its longest path from a root.

    The frontier moves one edge a round and is checkpointed; a path of more than ``most`` edges or a cycle fails.
    """
    shared_folder(edges.sparkSession)
    edges = edges.select("parent", "child").distinct()
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    level = roots.withColumn("depth", F.lit(0))
    found, front = level, level
    for k in range(1, most + 2):
        front = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        front = front.withColumn("depth", F.lit(k)).checkpoint()
        if front.isEmpty():
            break
        if k > most:
            raise ValueError("RELATIONSHIP_GRAPH: a cycle, or a path that is too long")
        found = found.unionByName(front)
    out = found.groupBy("node").agg(F.max("depth").alias("depth"))
    nodes = edges.select(F.col("parent").alias("node")).unionByName(edges.select(F.col("child").alias("node"))).distinct()
    if not nodes.join(out, "node", "left_anti").isEmpty():
        raise ValueError("RELATIONSHIP_GRAPH: a cycle")
    return out


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every node below each root (column node), however deep; a root in a cycle is below itself.

    The frontier of new pairs moves one edge a round and is checkpointed, until there are no new pairs.
    """
    shared_folder(edges.sparkSession)
    edges = edges.select("parent", "child").distinct()
    front = roots.select(F.col("node").alias("root"), "node").distinct()
    found = None
    while True:
        front = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        if found is not None:
            front = front.join(found, ["root", "node"], "left_anti")
        front = front.checkpoint()
        if found is not None and front.isEmpty():
            return found
        found = front if found is None else found.unionByName(front)
