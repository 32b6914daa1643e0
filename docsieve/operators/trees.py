"""Trees as rows (tree, id, parent, place): order paths from the roots down, folds from the leaves up.

Both go level by level, one equi-join or grouping for each level, and write each level to the shared folder, so a lost
executor costs one level. A node's path is the places of its ancestors and its own, so sorting by it is reading order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

MOST_DEPTH = 64


def with_paths(nodes: DataFrame, tree: list[str], most: int = MOST_DEPTH) -> DataFrame:
    """``nodes`` with depth (0 for roots) and path, an array of places.

    Roots have no parent, or one that is not there. A cycle, or a path of more than ``most`` edges, fails.
    """
    total = nodes.count()
    above = nodes.select(*tree, F.col("id").alias("parent"))
    roots = nodes.join(above, [*tree, "parent"], "left_anti")
    level = roots.select(*nodes.columns, F.lit(0).alias("depth"), F.array("place").alias("path"))
    levels, reached = [], 0
    for depth in range(most + 1):
        level = stage(level, "level")
        here = level.count()
        if not here:
            break
        reached += here
        levels.append(level)
        up = level.select(*tree, F.col("id").alias("parent"), F.col("path").alias("_path"))
        level = nodes.join(up, [*tree, "parent"]).select(
            *nodes.columns, F.lit(depth + 1).alias("depth"), F.concat("_path", F.array("place")).alias("path")
        )
    if reached < total:
        raise ValueError("RELATIONSHIP_GRAPH: a cycle, or a path that is too long")
    if not levels:
        return level
    return reduce(DataFrame.unionByName, levels)


def cyclic_trees(edges: DataFrame, tree: list[str], most: int = MOST_DEPTH) -> DataFrame:
    """The trees (their columns) whose edges (tree, parent, id) hold a cycle or a path of more than ``most`` edges.

    A node may have several parents. Edges whose parent has none left above it fall away, level by level; what is left
    when nothing falls is a cycle, and what is left after ``most`` levels lies too deep.
    """
    left = stage(edges.select(*tree, "parent", "id").distinct(), "edges")
    n = left.count()
    for _ in range(most):
        if not n:
            break
        held = left.select(*tree, F.col("id").alias("parent")).distinct()
        left = stage(left.join(held, [*tree, "parent"], "left_semi"), "edges")
        before, n = n, left.count()
        if n == before:
            break
    return left.select(*tree).distinct()


def fold_up(nodes: DataFrame, tree: list[str], value: Column, name: str, kind: str = "string") -> DataFrame:
    """``nodes`` (as ``with_paths`` gives them) with a value for each, folded from the deepest level up.

    ``value`` is an expression over a node's columns and ``children``, the values (of type ``kind``) of its children in their order.
    """
    depths = sorted((r[0] for r in nodes.select("depth").distinct().collect()), reverse=True)
    out, below = [], None
    for depth in depths:
        level = nodes.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("children", F.array().cast(f"array<{kind}>"))
        else:
            given = below.groupBy(*tree, F.col("parent").alias("id")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("place", "id", name))), lambda x: x[name]).alias("children")
            )
            level = level.join(given, [*tree, "id"], "left").withColumn("children", F.coalesce("children", F.array().cast(f"array<{kind}>")))
        below = stage(level.withColumn(name, value).select(*nodes.columns, name), "fold")
        out.append(below)
    if not out:
        return nodes.withColumn(name, F.lit(None).cast(kind))
    return reduce(DataFrame.unionByName, out)
