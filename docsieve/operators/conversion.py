"""From OCR responses to documents: checks, nodes, reviewed HTML, warnings, and the findings that a review starts with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tolerance import is_ambiguous_tolerance, suggested_text
from ..session import stage
from ..sources import ocr
from . import assembly
from .trees import cyclic_trees

# Codes of warnings.
PARTIAL, TOLERANCE = "PARTIAL_ANALYSIS", "POSSIBLE_TOLERANCE_SYMBOL_AMBIGUITY"
WARNING = "doc_id string, code string, block_ids array<string>, pages array<int>"


@dataclass
class Conversion:
    """What a conversion gives; a response with a problem has one row there and none elsewhere."""

    problems: DataFrame  # doc_id, violation
    nodes: DataFrame
    pages: DataFrame  # doc_id, page_number, html
    documents: DataFrame  # doc_id, html
    warnings: DataFrame  # WARNING and position
    counts: DataFrame  # doc_id, pages, raw_tables, table_regions


def cyclic_responses(table: DataFrame) -> DataFrame:
    """Responses (doc_id) whose blocks contain each other in a circle, or lie too deep."""
    of = ocr.edges(table).select("doc_id", "parent", F.col("child").alias("id"))
    return cyclic_trees(of, ["doc_id"])


def _rows(table: DataFrame, code: Column, blocks: Column | None = None, pages: Column | None = None) -> DataFrame:
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return table.select("doc_id", code.alias("code"), (none("string") if blocks is None else blocks).alias("block_ids"), (none("int") if pages is None else pages).alias("pages"))


def convert(responses: DataFrame, version: str = "1", revision: str = "baseline") -> Conversion:
    """Convert responses (as ``ocr.read_responses`` gives them): good ones to documents, others to problems."""
    responses = stage(responses, "responses")
    wrong = ocr.violations(responses)
    good = responses.join(wrong.select("doc_id"), "doc_id", "left_anti")
    circles = stage(cyclic_responses(ocr.blocks(good)), "circles")
    problems = wrong.unionByName(circles.select("doc_id", F.lit("CYCLIC_RELATIONSHIP").alias("violation")))
    good = good.join(circles, "doc_id", "left_anti")
    table = stage(ocr.blocks(good), "blocks")
    nodes = stage(assembly.nodes(table, version), "nodes")
    pages = assembly.page_html(nodes)
    facts = good.select("doc_id", F.lit(revision).alias("revision_id"), F.lit(1).alias("generation"), F.col("JobStatus").alias("status"))
    said = good.select("doc_id", F.explode("Warnings").alias("w"))
    every = [
        _rows(said, F.concat(F.lit("AWS_"), "w.ErrorCode"), None, F.coalesce("w.Pages", F.array().cast("array<int>"))),
        _rows(good.filter("JobStatus = 'PARTIAL_SUCCESS'"), F.lit(PARTIAL)),
        _rows(assembly.warnings(table), F.col("code"), F.array("block_id")),
        _rows(nodes.filter(is_ambiguous_tolerance(F.col("text"))), F.lit(TOLERANCE), F.array("block_id"), F.array("page_number")),
    ]
    warnings = every[0].withColumn("kind", F.lit(0))
    for k, more in enumerate(every[1:], 1):
        warnings = warnings.unionByName(more.withColumn("kind", F.lit(k)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "code", "block_ids", "pages"))
    warnings = warnings.withColumn("position", nth).drop("kind")
    regions = assembly.elements(table).filter("kind = 'table_region'").groupBy("doc_id").agg(F.count("*").alias("table_regions"))
    counts = table.groupBy("doc_id").agg(F.max("Page").alias("pages"), F.count_if(F.col("BlockType") == "TABLE").alias("raw_tables"))
    counts = counts.join(regions, "doc_id", "left").withColumn("table_regions", F.coalesce("table_regions", F.lit(0)))
    return Conversion(problems, nodes, pages, assembly.document_html(pages, facts), warnings, counts)


def review_findings(warnings: DataFrame, nodes: DataFrame, blocks: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """A finding for each warning, with what it points to, and a suggested text where just one plus sign is in question.

    ``warnings`` has doc_id, position, code, block_ids and pages; ``nodes`` doc_id, node_id, block_id and text; ``blocks``
    doc_id, Id and Page; ``previous`` doc_id, finding_id, region_hash and decision of an earlier review. Ids follow from
    what a warning says and, among equal ones, their order. A decision stays on its finding; it is ``resolved`` while the
    texts that it was made on are as they were. For several reviews of the same warnings, make ``named_findings`` once,
    ``current_findings`` of those that are wanted, and ``carry_decisions``.
    """
    return carry_decisions(current_findings(named_findings(warnings), nodes, blocks), previous)


def _listed() -> tuple[Column, Column]:
    """Block ids and pages of a warning as texts."""
    return F.concat_ws(",", F.sort_array("block_ids")), F.concat_ws(",", F.sort_array("pages").cast("array<string>"))


def named_findings(warnings: DataFrame) -> DataFrame:
    """The warnings and, of each, the ``finding_id``; staged."""
    identity = F.sha2(F.concat_ws("\n", "code", *_listed()), 256)
    rows = warnings.withColumn("identity", identity)
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "identity").orderBy("position")) - 1
    name = F.concat(F.lit("finding_"), F.substring(F.sha2(F.concat_ws("\0", "identity", ordinal.cast("string")), 256), 1, 32))
    return stage(rows.withColumn("finding_id", name).drop("identity"), "warnings")


def current_findings(rows: DataFrame, nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Named findings with what they point to, before any decision; each needs its own warning alone."""
    named = rows.select("doc_id", "finding_id", F.explode(F.array_distinct("block_ids")).alias("block_id"))
    text = F.coalesce("text", F.lit(""))
    # Nodes and pages of blocks go as rows of one table through one join and one grouping.
    held = nodes.select("doc_id", "block_id", F.struct("node_id", text.alias("text")).alias("node"))
    held = held.unionByName(blocks.select("doc_id", F.col("Id").alias("block_id"), F.col("Page").alias("page")), allowMissingColumns=True)
    held = named.join(held, ["doc_id", "block_id"]).groupBy("doc_id", "finding_id")
    held = held.agg(F.collect_set(F.struct("node", "page")).alias("held"))  # one set: a row has a node or a page
    held = held.select("doc_id", "finding_id", F.sort_array(F.array_compact("held.node")).alias("met"), F.array_compact("held.page").alias("raw_pages"))
    rows = rows.join(held, ["doc_id", "finding_id"], "left")
    rows = rows.withColumn("met", F.coalesce("met", F.array().cast("array<struct<node_id:string,text:string>>")))
    rows = rows.withColumn("pages", F.array_sort(F.array_union("pages", F.coalesce("raw_pages", F.array().cast("array<int>")))))
    said = F.transform("met", lambda n: F.concat(n["node_id"], F.lit(":"), F.length(n["text"]).cast("string"), F.lit(":"), n["text"]))
    region = F.concat_ws("|", F.array_join(said, ","), *_listed())
    plus = lambda t: F.length(t) - F.length(F.replace(t, F.lit("+"), F.lit("")))
    alone = (F.col("code") == TOLERANCE) & (plus(F.array_join("met.text", "")) == 1)  # one plus sign in all that is met
    one = F.when(alone, F.get(F.filter("met", lambda n: n["text"].contains("+") & ~n["text"].contains("±")), F.lit(0)))
    out = rows.withColumn("region_hash", F.sha2(region, 256)).withColumn("_one", one).withColumn("suggested_node", F.col("_one.node_id"))
    out = out.withColumn("suggested_text", suggested_text(F.col("_one.text")))
    return out.withColumn("node_ids", F.col("met.node_id")).drop("met", "raw_pages", "_one")


def carry_decisions(out: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Findings with the decisions of an earlier review, and whether these still hold."""
    if previous is None:
        return out.withColumn("decision", F.lit(None).cast("string")).withColumn("resolved", F.lit(False))
    before = previous.select("doc_id", "finding_id", F.col("region_hash").alias("_was"), "decision")
    out = out.join(before, ["doc_id", "finding_id"], "left")
    return out.withColumn("resolved", F.col("decision").isNotNull() & F.coalesce(F.col("_was") == F.col("region_hash"), F.lit(False))).drop("_was")
