"""Connected components of a table of links, by alternating star contractions on DataFrames."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy(spark: SparkSession) -> None:
    """Let go of tables that nothing refers to any more, so that Spark's cleaner removes their shuffle files now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
    return r["n"], r["h"] or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point larger (or smaller) neighbours, and the vertex itself, at the least of a vertex's neighbourhood."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame, files: int, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the least id of its component.

    Each round is checkpointed in at most ``files`` files, so a lost executor costs one round at most. A vertex with many links is folded by
    a partial minimum before the shuffle, and its rows join through a skew-splittable join.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = edges.filter(F.col("u") != F.col("v")).distinct().coalesce(files).checkpoint()
    mark = _mark(edges)
    for _ in range(most_rounds if mark[0] else 0):
        edges = _star(_star(edges, True), False).coalesce(files).checkpoint()
        new = _mark(edges)
        tidy(links.sparkSession)
        if new == mark:
            break
        mark = new
    else:
        if mark[0]:
            raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
