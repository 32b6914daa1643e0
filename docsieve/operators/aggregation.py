"""From hits to occurrences: method rank, grouping of interpretations, one candidate, page-level dedup, unit mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold

SPAN = ["doc_id", "node_id", "start", "end", "matched_text"]
#: Methods, the strongest first.
METHODS = ["exact", "normalized_exact", "fuzzy"]
#: What tells two interpretations of one span apart (null differs from '').
INTERPRETATION = ["component", "term_role", "source_table", "source_field", "literal", "display_name", "attributes_json"]


def method_rank(c: Column) -> Column:
    """0 for the strongest method."""
    return F.array_position(F.array(*map(F.lit, METHODS)), c) - 1


def best_methods(hits: DataFrame, span: list[str] = SPAN) -> DataFrame:
    """One hit for each span and source reference: the strongest method."""
    keys = [*span, "source_table", "row_id", "source_field", "term_role", "component", "literal"]
    w = Window.partitionBy(*keys).orderBy(method_rank(F.col("method")))
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ambiguity(attributes: Column) -> Column:
    """What qualifies a term on its own: a related synonym or a policy of context need their context."""
    related = F.coalesce(attributes["alias_type"], F.lit("")) == "hasRelatedSynonym"
    return F.when(related | (F.coalesce(attributes["match_policy"], F.lit("")) == "context_required"), "context_required")


def occurrences(hits: DataFrame, span: list[str] = SPAN) -> DataFrame:
    """One row for each span and component: the chosen interpretation and whether others existed.

    Hits of one interpretation are grouped to their least row id; of several interpretations the canonical name comes
    first, then the order of the key. ``unresolved`` says that another interpretation or row was there.
    """
    best = best_methods(hits, span).withColumn("attributes_json", F.to_json(F.sort_array(F.map_entries("attributes"))))
    carry = [c for c in best.columns if c not in {*span, *INTERPRETATION, "row_id", "method", "attributes"}]
    grouped = best.groupBy(*span, *INTERPRETATION).agg(
        F.min("row_id").alias("row_id"),
        F.countDistinct("row_id").alias("n_rows"),
        F.min(method_rank(F.col("method"))).alias("rank"),
        F.first("attributes").alias("attributes"),
        *(F.min(c).alias(c) for c in carry if c in ("page_number", "block_order")),
    )
    of_span = Window.partitionBy(*span, "component")
    order = of_span.orderBy(
        (F.col("term_role") != "material_name").cast("int"), *(F.asc_nulls_first(c) for c in INTERPRETATION)
    )
    ranked = grouped.withColumn("choice", F.row_number().over(order)).withColumn(
        "alternatives", F.count("*").over(of_span) + F.sum("n_rows").over(of_span) - 2
    )
    chosen = ranked.filter("choice = 1")
    state = F.when(F.col("alternatives") > 0, "unresolved").otherwise(F.coalesce(ambiguity(F.col("attributes")), F.lit("none")))
    identity = F.sha2(F.concat_ws("|", *span, "component", "row_id", "literal"), 256)
    return chosen.select(
        *span, *[c for c in ("page_number", "block_order") if c in chosen.columns and c not in span], "component", "term_role", "source_table",
        "source_field", "literal", "display_name", "row_id", F.element_at(F.array(*map(F.lit, METHODS)), F.col("rank").cast("int") + 1).alias("method"),
        state.alias("ambiguity"), F.concat(F.lit("dict-"), F.substring(identity, 1, 32)).alias("occurrence_id"),
    )


def best_per_page(found: DataFrame, page: list[str], folded: Column | None = None) -> DataFrame:
    """Per page, component and case-folded text the first occurrence: canonical names, then document order."""
    key = casefold("matched_text") if folded is None else folded
    order = [
        (F.col("term_role") != "material_name").cast("int"),
        *(F.col(c) for c in ("block_order", "node_id", "start", "end", "occurrence_id") if c in found.columns),
    ]
    w = Window.partitionBy(*page, "component", "_key").orderBy(*order)
    return found.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key")


def unit_mentions(hits: DataFrame, span: list[str] = SPAN, parts: int | None = None) -> DataFrame:
    """One mention for each span: exact before normalised, catalogue rows before the fixed vocabulary.

    ``parts`` deals the hits to so many tasks before they are grouped, so that none groups a whole split of its input.
    """
    hits = hits.repartition(parts, *span) if parts else hits
    fixed = F.col("row_id").startswith("vocab:")
    rank = F.struct(method_rank(F.col("method")), fixed.cast("int"), F.col("row_id"))
    out = hits.groupBy(*span).agg(
        F.min_by("row_id", rank).alias("row_id"),
        F.min_by("literal", rank).alias("literal"),
        F.min_by("method", rank).alias("method"),
        F.sort_array(F.collect_set("row_id")).alias("row_ids"),
    )
    material = F.concat_ws("|", "node_id", F.col("start").cast("string"), F.col("end").cast("string"), "matched_text", "row_id")
    return out.withColumn("supporting_row_ids", F.filter("row_ids", lambda r: r != F.col("row_id"))).drop("row_ids").withColumn(
        "occurrence_id", F.concat(F.lit("unit:"), F.substring(F.sha2(material, 256), 1, 24))
    )


def monitoring(found: DataFrame) -> DataFrame:
    """Counts by component, by component and method, and in all."""
    out = found.groupingSets([["component", "method"], ["component"], []], "component", "method")
    return out.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def over_limit(found: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """Groups with more rows than allowed; must be empty."""
    return found.groupBy(*keys).count().filter(F.col("count") > most)
