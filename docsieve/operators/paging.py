"""Pages of rows, retention, set agreement, job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phases of a job that still move, and those that do not.
ACTIVE = ["QUEUED", "SUBMITTING", "OCR", "COLLECTING", "RENDERING"]
TERMINAL = ["SUCCEEDED", "PARTIAL_SUCCESS", "FAILED"]


def keyset_page(table: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows after a key; the filter reaches the scan and only ``size`` rows are kept by each task."""
    return table.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def offset_page(table: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """A page of at most 100 rows with the number of rows in all."""
    total = table.agg(F.count("*").alias("total"))
    return table.orderBy(*order).offset(offset).limit(min(size, 100)).crossJoin(F.broadcast(total))


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each key with its row, null where there is none."""
    return keys.join(table, key, "left")


def newest(table: DataFrame, keep: int, order: list[Column], group: list[str]) -> DataFrame:
    """The first ``keep`` rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return table.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one side, with the side; empty when both agree."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Active jobs whose time has come."""
    return jobs.filter((F.col("due") <= now) & F.col("phase").isin(ACTIVE))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Due jobs whose lease is free or over."""
    return due(jobs, now).filter(F.col("lease_until").isNull() | (F.col("lease_until") < now))


def backoff_seconds(failures: Column) -> Column:
    """Seconds before the next try."""
    return F.least(F.lit(300.0), F.lit(10.0) * F.pow(F.lit(2.0), failures))


def slots(requests: DataFrame, bound: int, group: list[str], order: list[str]) -> DataFrame:
    """Requests with a slot number where one of ``bound`` is free, in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    n = F.row_number().over(w)
    return requests.withColumn("slot", F.when(n <= bound, n))
