"""The job table's conditional writes as joins: statuses, leases, slots.

A store that accepts a write only if a condition holds becomes a table of requests joined to a table of what is held:
the requests that meet their condition take effect together, the others are refused, and a repeated request changes
nothing. ``jobs`` has id, filename, owner, phase, pages_available, warning_count, error_code, artifacts (a map) and the
columns that a function names; ``slots`` has slot, job_id, generation; ``leases`` has job_id, lease, until.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import TERMINAL


def job_status(jobs: DataFrame) -> DataFrame:
    """What the owner of a job sees of it; artifacts by name."""
    return jobs.select(
        "id", "filename", "phase", "pages_available", F.coalesce("warning_count", F.lit(0)).alias("warning_count"), "error_code",
        F.array_sort(F.map_keys(F.coalesce("artifacts", F.create_map().cast("map<string,string>")))).alias("artifacts"),
    )


def settled(jobs: DataFrame) -> DataFrame:
    """Jobs that reached an end."""
    return jobs.filter(F.col("phase").isin(TERMINAL))


def owned(jobs: DataFrame, owner: Column) -> DataFrame:
    """Jobs of one owner."""
    return jobs.filter(F.col("owner") == owner)


def slot_releasable() -> Column:
    """A slot is free again after recognition, or where a submission was refused for certain (no handle, no doubt)."""
    refused = (F.col("phase") == "FAILED") & F.col("handle").isNull() & ~F.col("unknown_submission") & F.col("slot").isNotNull()
    return F.coalesce(F.col("ocr_finished"), F.lit(False)) | F.coalesce(refused, F.lit(False))


def uncertain_submission() -> Column:
    """Whether a submission may have gone through: doubt stays, an unknown error or one worth a retry raises it."""
    open_ = (F.col("phase") == "SUBMITTING") & F.col("handle").isNull()
    return F.coalesce(F.col("prior_uncertain") | (open_ & (~F.col("known_error") | F.col("retryable"))), F.lit(False))


def claim(leases: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """job_id, lease, until after requests (job_id, lease, until): a free or expired lease goes to the first request by token."""
    first = requests.groupBy("job_id").agg(F.min(F.struct("lease", "until")).alias("new"))
    both = leases.join(first, "job_id", "full")
    free = F.col("lease").isNull() | (F.col("until") <= now)
    got = F.col("new").isNotNull() & free
    return both.select(
        "job_id", F.when(got, F.col("new.lease")).otherwise(F.col("lease")).alias("lease"),
        F.when(got, F.col("new.until")).otherwise(F.col("until")).alias("until"), got.alias("claimed"),
    )


def heartbeat(leases: DataFrame, beats: DataFrame) -> DataFrame:
    """Leases after beats (job_id, lease, until); a beat with another token than the lease's is refused."""
    mine = beats.groupBy("job_id", "lease").agg(F.max("until").alias("later"))
    return leases.join(mine, ["job_id", "lease"], "left").select(
        "job_id", "lease", F.coalesce("later", "until").alias("until"), F.col("later").isNotNull().alias("renewed")
    )


def release_leases(leases: DataFrame, tokens: DataFrame) -> DataFrame:
    """Leases without those given back by their own token (job_id, lease)."""
    return leases.join(tokens.select("job_id", "lease").distinct(), ["job_id", "lease"], "left_anti")


def acquire_slots(slots: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Slots of the requesting jobs (job_id, asked, generation): a job that holds one keeps it under its new generation,
    the others take the least free ones in order of asking; who finds none is not in the result."""
    asked = requests.groupBy("job_id").agg(F.min(F.struct("asked", "generation")).alias("r")).select("job_id", "r.*")
    held = slots.filter(F.col("slot") < limit).groupBy("job_id").agg(F.min("slot").alias("slot"))
    again = asked.join(held, "job_id").select("slot", "job_id", "generation")
    free = slots.sparkSession.range(limit).select(F.col("id").cast("int").alias("slot")).join(slots.select("slot"), "slot", "left_anti")
    # At most ``limit`` free slots exist, so no more requests than that are numbered.
    free = free.withColumn("n", F.row_number().over(Window.orderBy("slot")))
    waiting = asked.join(held, "job_id", "left_anti").orderBy("asked", "job_id").limit(limit)
    waiting = waiting.withColumn("n", F.row_number().over(Window.orderBy("asked", "job_id")))
    return again.unionByName(waiting.join(free, "n").select("slot", "job_id", "generation"))


def release_slots(slots: DataFrame, releases: DataFrame) -> DataFrame:
    """Slots without those given up by their holder under the generation of the hold; a stale release changes nothing."""
    keys = ["slot", "job_id", "generation"]
    return slots.join(releases.select(*keys).distinct(), keys, "left_anti")
