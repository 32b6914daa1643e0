"""Reviews: revision chains, invalidated approvals, edit folds, findings and their texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweep import segments

FINDING = "finding_id string, component string, display_text string, page int, evidence string, removed boolean, origin string"
#: The order of categories in a text report.
CATEGORIES = ["unit_operations", "process_steps", "materials", "quantity_expressions", "units", "equipment", "parameter_names", "parameter_value_expressions"]


def latest(revisions: DataFrame, key: str = "job_id", generation: str = "generation") -> DataFrame:
    """The head of each chain: its row with the highest generation."""
    return revisions.groupBy(key).agg(F.max_by(F.struct(*revisions.columns), generation).alias("r")).select("r.*")


def chain_violations(revisions: DataFrame) -> DataFrame:
    """Revisions that do not follow their parent: generations without gaps, each naming the one before it."""
    w = Window.partitionBy("job_id").orderBy("generation")
    previous = F.lag("revision_id").over(w)
    out = revisions.withColumn("_before", previous).withColumn("_n", F.row_number().over(w))
    bad = (F.col("_n") != F.col("generation")) | ~F.col("parent_revision_id").eqNullSafe(F.col("_before"))
    return out.filter(bad).drop("_before", "_n")


def invalidated_approvals(pages: DataFrame) -> DataFrame:
    """(job_id, generation, page_number) whose approval the job's revision before had and this one has not.

    ``pages`` has job_id, generation, page_number, approved; a page absent from a revision is not approved there. A
    job's revisions are the generations of all its pages.
    """
    revisions = pages.select("job_id", "generation").distinct()
    after = F.lead("generation").over(Window.partitionBy("job_id").orderBy("generation"))
    following = revisions.select("job_id", "generation", after.alias("next")).filter("next is not null")
    had = pages.filter("approved").select("job_id", "generation", "page_number").distinct()
    due = had.join(following, ["job_id", "generation"]).select("job_id", F.col("next").alias("generation"), "page_number")
    return due.join(had, ["job_id", "generation", "page_number"], "left_anti")


def effective_changes(before: DataFrame, edits: DataFrame) -> DataFrame:
    """Nodes (node_id, before, after) whose text an edit changes."""
    joined = before.join(edits.select("node_id", F.col("text").alias("after")), "node_id")
    return joined.filter(~F.col("text").eqNullSafe(F.col("after"))).select("node_id", F.col("text").alias("before"), "after")


def apply_changes(before: DataFrame, edits: DataFrame) -> DataFrame:
    """Nodes with edited texts in place."""
    joined = before.join(edits.select("node_id", F.col("text").alias("_new")), "node_id", "left")
    return joined.withColumn("text", F.coalesce("_new", "text")).drop("_new")


def fold_edits(findings: DataFrame, edits: DataFrame) -> DataFrame:
    """Fold each review's edits, in order, over its findings.

    ``findings`` has review_id, position and FINDING; ``edits`` has review_id, seq, op (add, replace, patch, remove,
    restore), finding_id, component, display_text, page, evidence. Returns the findings, original order kept and
    additions last, with ``outcome`` of the review: changed, unchanged or the first broken rule (findings as before).
    """
    fields = ["finding_id", "component", "display_text", "page", "evidence", "removed", "origin"]
    out_schema = f"review_id string, position int, {FINDING}, outcome string"

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        review = (left if len(left) else right)["review_id"].iloc[0]
        before = {r["finding_id"]: {f: r[f] for f in fields} for r in left.sort_values("position").to_dict("records")}
        now = {k: dict(v) for k, v in before.items()}
        outcome, same = "unchanged", lambda a, b: a == b or (pd.isna(a) and pd.isna(b))
        for e in right.sort_values("seq").to_dict("records"):
            op, key = e["op"], e["finding_id"]
            new = {f: e[f] for f in ("component", "display_text", "page", "evidence")}
            old = now.get(key)
            if op == "add":
                broken = "ADD_COLLIDES" if old else "ADD_CLAIMS_EVIDENCE" if e["evidence"] == "document_evidence" else None
            elif old is None:
                broken = "MISSING_FINDING"
            elif op == "restore":
                broken = None if old["removed"] else "NOT_REMOVED"
            else:
                broken = "FINDING_REMOVED" if old["removed"] else None
            if broken:
                now, outcome = before, broken
                break
            if op == "add":
                now[key] = {"finding_id": key, **new, "removed": False, "origin": "user"}
            elif op in ("remove", "restore"):
                old["removed"] = op == "remove"
            else:
                change = {"display_text": new["display_text"]} if op == "patch" else new
                if all(same(old[f], v) for f, v in change.items()):
                    continue
                old.update(change)
            outcome = "changed"
        rows = [(review, k, *(v[f] for f in fields), outcome) for k, v in enumerate(now.values())]
        return pd.DataFrame(rows, columns=["review_id", "position", *fields, "outcome"]).astype({"page": "Int32"})

    return findings.groupBy("review_id").cogroup(edits.groupBy("review_id")).applyInPandas(fold, out_schema)


def last_edit(edits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the edit that counts: the last one."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return edits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def replays(saves: DataFrame) -> DataFrame:
    """Each save with what it is: first, replay of the first, or mismatch (same operation, other content)."""
    w = Window.partitionBy("job_id", "actor", "operation_id").orderBy("seq")
    first = F.first("fingerprint").over(w)
    kind = F.when(F.row_number().over(w) == 1, "first").when(first == F.col("fingerprint"), "replay").otherwise("mismatch")
    return saves.withColumn("kind", kind)


def finding_id(*parts: Column) -> Column:
    """A finding's identity from its fields, one on each line."""
    return F.sha2(F.concat_ws("\n", *(p.cast("string") for p in parts)), 256)


def first_by_id(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first finding of each id."""
    w = Window.partitionBy("finding_id").orderBy(*order)
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def report(findings: DataFrame) -> DataFrame:
    """The text report of each review: categories in order, pages ascending with unassigned last, saved order."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("component"))
    page = F.coalesce(F.concat(F.lit("page "), F.col("page").cast("string")), F.lit("unassigned"))
    note = F.when(F.col("evidence") == "no_evidence", " (no evidence)").otherwise("")
    line = F.concat(F.col("component"), F.lit("\t"), page, F.lit("\t"), F.col("display_text"), note)
    row = F.struct(rank, F.col("page").isNull(), F.col("page"), F.col("position"), line.alias("line"))
    out = findings.filter(~F.col("removed")).groupBy("review_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select("review_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("report"))


def highlight_segments(spans: DataFrame, page: list[str]) -> DataFrame:
    """Cut each page at all span edges; segments (from, to) with the sorted ids of the spans that cover them."""
    return segments(spans, page).withColumnRenamed("names", "finding_ids")
