"""Page classification: evidence checks, merging three calls, eligibility, allow-lists.

Input is one row for each page and call: doc_id, page_number, call_id (1 to 3), availability, status, labels,
evidence array<struct<label,quote,reason,element_id>>, failure_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities, evidence_text, tsv_cell

PAGE = ["doc_id", "page_number"]
FALLBACK = "OTHER_UNCLASSIFIED"
#: Labels that exclude a page when it has no other.
EXCLUDING = [
    "NON_RELATED",
    "COVER_PAGE",
    "TABLE_OF_CONTENTS",
    "DOCUMENTATION_INSTRUCTIONS",
    "REFERENCE_DOCUMENTATION",
    "SIGNATURE_LOG",
    "SIGNATURE_APPROVAL",
    "ACKNOWLEDGEMENT",
    "BATCH_REVIEW_DISPOSITION",
    "DOCUMENT_CHANGE_HISTORY",
]


def check_quotes(evidence: DataFrame, pages: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Evidence rows (page, quote, element_id) with verification and its reason.

    ``pages`` has readable_text; ``elements`` has (page, element_id, text, ambiguous), one row for each identifier.
    """
    norm = lambda c: evidence_text(decode_entities(c))
    text = pages.select(*PAGE, norm(F.col("readable_text")).alias("_page"))
    out = evidence.join(text, PAGE, "left").withColumn("_quote", norm(F.coalesce("quote", F.lit(""))))
    if elements is None:
        out = out.withColumn("_text", F.lit(None).cast("string")).withColumn("_ambiguous", F.lit(False))
    else:
        side = elements.select(*PAGE, "element_id", norm(F.col("text")).alias("_text"), F.col("ambiguous").alias("_ambiguous"))
        out = out.join(side, [*PAGE, "element_id"], "left")
    named = F.col("element_id").isNotNull()
    reason = (
        F.when(F.col("_quote") == "", "normalized quote is empty")
        .when(~F.coalesce(F.contains("_page", "_quote"), F.lit(False)), "quote not found in normalized page text")
        .when(named & F.coalesce("_ambiguous", F.lit(False)), "element_id is ambiguous on prepared page")
        .when(named & F.col("_text").isNull(), "element_id not found on prepared page")
        .when(named & ~F.contains("_text", "_quote"), "quote not found in normalized element text")
    )
    return out.withColumn("verification_reason", reason).withColumn(
        "verification", F.when(reason.isNull(), "verified").otherwise("unverified")
    ).drop("_page", "_quote", "_text", "_ambiguous")


def merge_kind(n_valid: Column, n_review: Column, n_empty: Column, n_ok: Column, n_labels: Column, unverified: Column) -> Column:
    """The kind of a page from its three calls; the order of the cases is the rule."""
    return (
        F.when(n_valid < 3, "incomplete")
        .when(n_review > 0, "needs_review")
        .when(n_empty == 3, "empty")
        .when((n_empty > 0) & (n_ok > 0), "needs_review")
        .when(n_labels == 0, "needs_review")
        .when(unverified, "needs_review")
        .otherwise("completed")
    )


def merge_pages(outcomes: DataFrame, unverified: DataFrame | None = None) -> DataFrame:
    """One row for each page: kind, labels, requires_review, is_provisional, applied_fallback.

    ``unverified`` names the pages (doc_id, page_number) with evidence that did not verify.
    """
    valid = F.col("availability") == "valid"
    status = lambda s: F.count(F.when(valid & (F.col("status") == s), 1))
    pages = outcomes.groupBy(*PAGE).agg(
        F.countDistinct(F.when(valid, F.col("call_id"))).alias("n_valid"),
        status("needs_review").alias("n_review"),
        status("empty").alias("n_empty"),
        status("ok").alias("n_ok"),
        F.array_sort(F.collect_list(F.when(valid, F.struct("call_id", "labels")))).alias("calls"),
    )
    pages = pages.withColumn("labels", F.flatten(F.transform("calls", lambda c: c["labels"]))).drop("calls")
    if unverified is None:
        pages = pages.withColumn("unverified", F.lit(False))
    else:
        pages = pages.join(unverified.select(*PAGE).distinct().withColumn("unverified", F.lit(True)), PAGE, "left").withColumn(
            "unverified", F.coalesce("unverified", F.lit(False))
        )
    kind = merge_kind(*(F.col(c) for c in ("n_valid", "n_review", "n_empty", "n_ok")), F.size("labels"), F.col("unverified"))
    fallback = (F.col("n_valid") == 3) & (F.col("n_ok") == 3) & (F.size("labels") == 0)
    out = pages.withColumn("kind", kind).withColumn("applied_fallback", fallback)
    none = F.array().cast("array<string>")
    return out.select(
        *PAGE, "kind",
        F.when(F.col("kind") == "empty", none).when(F.col("applied_fallback"), F.array(F.lit(FALLBACK))).otherwise(F.col("labels")).alias("labels"),
        ((F.col("kind") == "needs_review") | F.col("unverified")).alias("requires_review"),
        (F.col("kind") == "incomplete").alias("is_provisional"),
        "applied_fallback", "unverified",
    )


def eligibility(merged: DataFrame) -> DataFrame:
    """Pages with eligible and reason: only completed pages whose labels all exclude are left out."""
    all_out = (F.size("labels") > 0) & F.forall("labels", lambda x: x.isin(EXCLUDING))
    reason = (
        F.when(F.col("is_provisional") | (F.col("kind") == "incomplete"), "incomplete")
        .when(F.col("requires_review") | (F.col("kind") == "needs_review"), "requires_review")
        .when(F.col("unverified"), "unverified")
        .when(F.col("applied_fallback") | F.array_contains("labels", FALLBACK), "fallback")
        .when((F.col("kind") == "empty") | (F.size("labels") == 0), "empty")
        .when(all_out, "excluded")
        .otherwise("labels")
    )
    return merged.withColumn("eligibility_reason", reason).withColumn("eligible", reason != "excluded")


def allow_list(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """The pages that no decision excludes."""
    return pages.join(decided.filter(~F.col("eligible")).select(*PAGE), PAGE, "left_anti")


def response_violations(outcomes: DataFrame) -> DataFrame:
    """Valid calls whose answer breaks a rule: repeated labels, labels of an empty page, evidence of other labels."""
    of_evidence = F.array_distinct(F.transform("evidence", lambda e: e["label"]))
    same = (F.size(F.array_except("labels", of_evidence)) == 0) & (F.size(F.array_except(of_evidence, "labels")) == 0)
    reason = (
        F.when(F.size(F.array_distinct("labels")) < F.size("labels"), "DUPLICATE_LABEL")
        .when((F.col("status") == "empty") & (F.size("labels") > 0), "EMPTY_WITH_LABELS")
        .when(~same, "EVIDENCE_LABELS_DIFFER")
    )
    return outcomes.filter(F.col("availability") == "valid").withColumn("violation", reason).filter("violation is not null")


NOT_SUPPLIED = "classifier call response was not supplied"


def with_missing_calls(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every page's three calls: those without an outcome are ``missing``, with the reason."""
    calls = pages.select(*PAGE).distinct().withColumn("call_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    out = calls.join(outcomes, [*PAGE, "call_id"], "left")
    absent = F.col("availability").isNull()
    reason = F.col("failure_reason") if "failure_reason" in outcomes.columns else F.lit(None).cast("string")
    return out.withColumn("failure_reason", F.when(absent, NOT_SUPPLIED).otherwise(reason)).withColumn(
        "availability", F.coalesce("availability", F.lit("missing"))
    )


def failed_calls(calls: DataFrame, reason: Column) -> DataFrame:
    """Outcomes of calls (page and call_id) that gave no answer."""
    none = F.array().cast("array<string>")
    return calls.select(
        *PAGE, "call_id", F.lit("failed").alias("availability"), F.lit(None).cast("string").alias("status"), none.alias("labels"),
        reason.alias("failure_reason"),
    )


def classify(pages: DataFrame, outcomes: DataFrame, unverified: DataFrame | None = None) -> DataFrame:
    """Every page's merged result and eligibility; absent calls count as missing. Whoever shows them sorts them."""
    return eligibility(merge_pages(with_missing_calls(pages, outcomes), unverified))


def classification_tsv(pages: DataFrame, decided: DataFrame) -> DataFrame:
    """doc_id, tsv: a header and one line for each page in order, its labels and marks, or that there is no result."""
    # The marks in their order, and what stands for no result.
    kind = F.col("kind")
    cases = [
        ("incomplete", kind == "incomplete"), ("needs_review", (kind == "needs_review") | F.col("requires_review")), ("empty", kind == "empty"),
        ("provisional", F.col("is_provisional")), ("unverified_evidence", F.col("unverified")),
    ]
    marks = F.array_compact(F.array(*(F.when(case, F.lit(name)) for name, case in cases)))
    named = F.array_join(F.filter(F.transform("labels", tsv_cell), lambda x: x != ""), "; ")
    marked = F.when(F.size(marks) > 0, F.concat(F.lit("["), F.array_join(marks, "; "), F.lit("]")))
    cell = F.concat_ws(" ", F.nullif(named, F.lit("")), marked)
    cell = F.coalesce(F.nullif(tsv_cell(cell), F.lit("")), F.lit("[no completed classification result]"))
    lines = pages.select(*PAGE).distinct().join(decided, PAGE, "left").select(
        "doc_id", F.struct("page_number", F.concat_ws("\t", F.col("page_number").cast("string"), cell).alias("line")).alias("x")
    )
    lines = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("all"))
    head = F.lit("Page number\tPage classification")
    body = F.concat(F.array(head), F.transform("all", lambda x: x["line"]))
    return lines.select("doc_id", F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("tsv"))
