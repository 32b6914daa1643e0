"""Checks of a published run: artifacts against outcomes and bytes, components against the plan, spans against texts.

Each check gives the rows that break it, with a code; an empty result means that the publication holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import comparison_key

COMPLETED = "completed"


def disagreeing_artifacts(outcomes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """component, code: completed components (component, outcome) without an artifact, and artifacts of others."""
    done = outcomes.filter(F.col("outcome") == COMPLETED).select("component").distinct()
    made = artifacts.select("component").distinct()
    missing = done.join(made, "component", "left_anti").withColumn("code", F.lit("ARTIFACT_MISSING"))
    return missing.unionByName(made.join(done, "component", "left_anti").withColumn("code", F.lit("ARTIFACT_UNEXPECTED")))


def broken_artifacts(spark: SparkSession, artifacts: DataFrame, root: str) -> DataFrame:
    """component, relative_path, code of artifacts (component, relative_path, byte_size, sha256) whose files differ.

    A file is hashed as one cell, so files of 2 GB or more fail; write a component's results in parts below that.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(
        F.element_at(F.split("path", F.lit(r"\Q" + base.split(":", 1)[-1].lstrip("/") + r"\E")), -1).alias("relative_path"),
        F.col("length").alias("found"), F.sha2("content", 256).alias("digest"),
    )
    code = (
        F.when(F.col("found").isNull(), "ARTIFACT_MISSING")
        .when(F.col("found") != F.col("byte_size"), "ARTIFACT_SIZE_MISMATCH")
        .when(F.col("digest") != F.col("sha256"), "ARTIFACT_HASH_MISMATCH")
    )
    checked = artifacts.join(files, "relative_path", "left").withColumn("code", code)
    return checked.filter("code is not null").select("component", "relative_path", "code")


def uncovered_components(resolved: DataFrame, outcomes: DataFrame) -> DataFrame:
    """component, code: the plan's components need one outcome each, and no outcome may be of another component."""
    counts = outcomes.groupBy("component").agg(F.count("*").alias("n"))
    both = resolved.select("component").distinct().withColumn("planned", F.lit(True)).join(counts, "component", "full")
    code = (
        F.when(F.col("n").isNull(), "OUTCOME_MISSING")
        .when(F.col("planned").isNull(), "OUTCOME_UNEXPECTED")
        .when(F.col("n") > 1, "OUTCOME_REPEATED")
    )
    return both.withColumn("code", code).filter("code is not null").select("component", "code")


def overall_outcome(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, overall, usable: completed if all components are, failed if none is, else partial."""
    done, n = F.count(F.when(F.col("outcome") == COMPLETED, 1)), F.count("*")
    overall = F.when(done == n, COMPLETED).when(done == 0, "failed").otherwise("partial")
    return outcomes.groupBy(*keys).agg(overall.alias("overall"), (done > 0).alias("usable"))


def disagreeing_runs(claims: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Runs whose claimed overall outcome (keys, overall) is not that of their components."""
    true = overall_outcome(outcomes, keys).withColumnRenamed("overall", "of_components").drop("usable")
    return claims.join(true, keys, "left").filter(~F.col("overall").eqNullSafe(F.col("of_components")))


def reviewable_runs(runs: DataFrame) -> DataFrame:
    """Runs that are published and name their manifest."""
    return runs.filter((F.col("publication") == "published") & F.col("manifest_sha256").isNotNull())


def offsets_match(text: Column, start: Column, end: Column, matched: Column) -> Column:
    """Whether [start, end) is a range of the text that holds just the matched text."""
    inside = (start >= 0) & (end > start) & (end <= F.length(text)) & (end - start == F.length(matched))
    return F.coalesce(inside & (F.substring(text, start + 1, end - start) == matched), F.lit(False))


def locate_hit(blocks: DataFrame, hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The blocks of exact spans (doc_id, page_number, node_id, start, end); a span that no hit has is left out."""
    keys = ["doc_id", "page_number", "node_id", "start", "end"]
    found = wanted.select(*keys).distinct().join(hits.select(*keys).distinct(), keys)
    return found.join(blocks, keys[:3])


def evidence(method: Column, term: Column, distance: Column) -> Column:
    """What supports a hit: its method, the term as listed, and for one-edit hits their distance."""
    return F.struct(method.alias("method"), term.alias("dictionary_term"), F.when(method == "fuzzy", distance).alias("edit_distance"))


def wrong_distances(claims: DataFrame) -> DataFrame:
    """One-edit claims (dictionary_term, matched_text, edit_distance) that a new count of the edits does not bear out."""
    of = lambda c: comparison_key(F.col(c), F.lit(True))
    true = claims.withColumn("true_distance", F.levenshtein(of("dictionary_term"), of("matched_text"), 1))
    return true.filter((F.col("true_distance") != F.col("edit_distance")) | ~F.col("true_distance").isin(0, 1))
