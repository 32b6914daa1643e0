"""Dense numbers for the rows of a table, and dense names for the distinct values of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

_LOW = (1 << 33) - 1  # the bits of monotonically_increasing_id that count within a partition


def dense_index(table: DataFrame, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """The table with a column of numbers from ``start``, in the order of its partitions; and the next free number.

    Each row is written with its partition and its place there, so that they stay as they are; one count for each
    partition comes back to the driver.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW))
    table = stage(table.withColumns({"_part": F.spark_partition_id(), "_place": local}), "named")
    sizes = {r[0]: r[1] for r in table.groupBy("_part").count().collect()}
    offsets, at = [], start
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(at)
        at += sizes.get(k, 0)
    first = F.element_at(F.array(*map(F.lit, offsets or [start])), F.col("_part") + 1).cast("long")
    return table.withColumn(name, first + F.col("_place")).drop("_part", "_place"), at


def dense_names(table: DataFrame, columns: list[str], name: str, start: int = 0) -> tuple[DataFrame, int]:
    """The table with equal names for equal values of ``columns``, by a join with their numbered distinct values."""
    numbered, free = dense_index(table.select(*columns).distinct(), name, start)
    return table.join(numbered, columns).drop(*columns), free
