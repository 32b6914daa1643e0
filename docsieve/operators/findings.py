"""Findings of a review from published occurrences, and approvals of what was saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .review import finding_id

#: Outcomes of an approval.
CHANGED, UNCHANGED, CONFLICT, VALIDATION_ERROR = "CHANGED", "UNCHANGED", "CONFLICT", "VALIDATION_ERROR"
KINDS = {"units": "unit", "quantity_expressions": "value", "parameter_value_expressions": "value"}
MOST_FINDINGS = 100_000


def occurrence_kind(component: Column) -> Column:
    """dictionary, unit or value."""
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.coalesce(kind[component], F.lit("dictionary"))


def project(occurrences: DataFrame, job: list[str], most: int = MOST_FINDINGS) -> DataFrame:
    """Findings of each job's occurrences, in the order of its pages.

    ``occurrences`` has the job's columns, component, occurrence_id, page_number, block_order, node_id, start, end and
    matched_text; other columns are ignored. Gives the job, position (from 1), finding_id, component, occurrence_kind,
    occurrence_id, page_number, node_id, start, end, display_text, evidence, removed, origin and error_code. A repeated
    occurrence is one finding; a job with one identity and two texts is ARTIFACT_REJECTED, one with more than ``most``
    findings PROJECTION_LIMIT: such jobs have one row with their error_code alone.
    """
    kind = occurrence_kind(F.col("component"))
    found = occurrences.withColumn("occurrence_kind", kind).withColumn(
        "finding_id", finding_id(*(F.col(c) for c in ("component", "occurrence_kind", "occurrence_id", "page_number", "node_id", "start", "end")))
    )
    order = ["page_number", "block_order", "start", "end", "component", "occurrence_id", "node_id", "finding_id"]
    said = ["component", "occurrence_kind", "occurrence_id", "page_number", "node_id", "start", "end"]
    one = found.groupBy(*job, "finding_id").agg(
        *(F.first(c).alias(c) for c in said), F.min("block_order").alias("block_order"), F.min("matched_text").alias("display_text"),
        (F.count_distinct(F.coalesce("matched_text", F.lit(""))) > 1).alias("differs"),
    )
    state = one.groupBy(*job).agg(F.max("differs").alias("differs"), F.count("*").alias("n"))
    state = state.withColumn("error_code", F.when(F.col("differs"), "ARTIFACT_REJECTED").when(F.col("n") > most, "PROJECTION_LIMIT"))
    good = one.join(state.filter("error_code is null").select(*job), job, "left_semi")
    position = F.row_number().over(Window.partitionBy(*job).orderBy(*order))
    good = good.select(
        *job, position.alias("position"), "finding_id", *said, "display_text", F.lit("document_evidence").alias("evidence"), F.lit(False).alias("removed"),
        F.lit("lexical").alias("origin"), F.lit(None).cast("string").alias("error_code"),
    )
    return good.unionByName(state.filter("error_code is not null").select(*job, "error_code"), allowMissingColumns=True)


def active_highlights(findings: DataFrame) -> DataFrame:
    """What a page shows of its findings: those that are not removed, with evidence in a node and a span."""
    shown = findings.filter(~F.col("removed") & (F.col("evidence") == "document_evidence") & F.col("node_id").isNotNull())
    return shown.filter(F.col("start").isNotNull() & (F.col("end") > F.col("start"))).withColumn("category", F.col("component"))


def approve(reviews: DataFrame, commands: DataFrame) -> DataFrame:
    """What each approval command does: the command, outcome and the review's approval after it.

    ``reviews`` has review_id, revision_id (the saved one) and approved_revision_id; ``commands`` has review_id, seq,
    expected_revision_id, target_revision_id, actor and at. Commands of a review act in the order of seq: one that
    expects or targets another revision changes nothing, the first good one approves, later ones find it approved.
    """
    joined = commands.join(reviews, "review_id")
    good = (F.col("expected_revision_id") == F.col("revision_id")) & (F.col("target_revision_id") == F.col("revision_id"))
    before = Window.partitionBy("review_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(good.cast("int")).over(before), F.lit(0)) > 0
    already = done | F.coalesce(F.col("approved_revision_id") == F.col("revision_id"), F.lit(False))
    outcome = (
        F.when(~F.coalesce(F.col("expected_revision_id") == F.col("revision_id"), F.lit(False)), CONFLICT)
        .when(~F.coalesce(F.col("target_revision_id") == F.col("revision_id"), F.lit(False)), VALIDATION_ERROR)
        .when(already, UNCHANGED).otherwise(CHANGED)
    )
    after = F.when(already | (outcome == CHANGED), F.col("revision_id")).otherwise(F.col("approved_revision_id"))
    return joined.withColumn("outcome", outcome).withColumn("approved_after", after).select(*commands.columns, "outcome", "approved_after")
