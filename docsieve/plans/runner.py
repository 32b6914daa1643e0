"""A lexical run: components from presets, one plan for each family, results committed one by one, manifest last.

The dictionary components are independent: one that fails leaves its error in the manifest and the others are kept.
Parameter names, units and values are one family, as values need the units. Each component's blocks are written as
one dataset; a reader sees a run only through its manifest.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..functions.units import fixed_spellings, fixed_unit_table
from ..functions.values import value_expressions
from ..operators import aggregation, fuzzy, matching, merging
from ..operators.terms import COMPONENTS, NEEDS, eligible_terms
from ..session import stage

# Presets and their components.
PRESETS = {
    "unit_operations": ["unit_operations"],
    "unit_operations_with_steps": ["unit_operations", "process_steps"],
    "materials": ["materials"],
    "materials_with_quantities": ["materials", "quantity_expressions", "units"],
    "equipment": ["equipment"],
    "equipment_with_parameters": ["equipment", "parameter_names", "parameter_value_expressions", "units"],
    "full": COMPONENTS,
}
DICTIONARY = ["unit_operations", "process_steps", "materials", "equipment", "parameter_names"]
VALUES = ["quantity_expressions", "parameter_value_expressions"]


@dataclass
class Request:
    """What to run: presets and components, fuzzy matching, and the pages (doc_id, page_number) to look at."""

    presets: list[str] = field(default_factory=list)
    components: list[str] = field(default_factory=list)
    fuzzy: bool = False
    pages: DataFrame | None = None

    def resolved(self) -> list[str]:
        """The chosen components in their order; unknown and repeated names are errors."""
        unknown = [p for p in self.presets if p not in PRESETS] + [c for c in self.components if c not in COMPONENTS]
        if unknown or len(set(self.presets)) < len(self.presets) or len(set(self.components)) < len(self.components):
            raise ValueError(f"INVALID_SELECTION: {unknown or 'repeated names'}")
        chosen = {c for p in self.presets for c in PRESETS[p]} | set(self.components)
        if not chosen:
            raise ValueError("INVALID_SELECTION: nothing is chosen")
        return [c for c in COMPONENTS if c in chosen]


    def fingerprint(self) -> str:
        """The hex digest of what is run and by which fixed rules; pages count as restricted or not."""
        chosen = {"components": self.resolved(), "fuzzy": self.fuzzy, "restricted": self.pages is not None, "rules": fixed_rules()}
        return hashlib.sha256(json.dumps(chosen, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


#: What a request's mapping may hold, and of which kinds.
KEYS = {"presets": list, "components": list, "fuzzy": bool}


def load_request(text: str, pages: DataFrame | None = None) -> Request:
    """A request from JSON text: one object, known keys alone, none twice, each of its kind."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("INVALID_CONFIGURATION: a key is there twice")
        return dict(pairs)

    try:
        given = json.loads(text, object_pairs_hook=once)
    except json.JSONDecodeError:
        raise ValueError("INVALID_CONFIGURATION: no JSON") from None
    if not isinstance(given, dict) or set(given) - set(KEYS) or any(type(v) is not KEYS[k] for k, v in given.items()):
        raise ValueError("INVALID_CONFIGURATION: unknown keys or kinds")
    if any(type(x) is not str for k in ("presets", "components") for x in given.get(k, [])):
        raise ValueError("INVALID_CONFIGURATION: names are texts")
    request = Request(**given, pages=pages)
    request.resolved()
    return request


def fixed_rules() -> dict:
    """The fixed values that decide what a run finds."""
    return {
        "components": COMPONENTS, "needs": NEEDS, "presets": PRESETS, "units": [list(x) for x in fixed_spellings()], "methods": aggregation.METHODS,
        "least_term": fuzzy.LEAST_TERM, "least_word": fuzzy.LEAST_WORD, "number": values.NUMBER, "page_words": values.PAGE_WORDS,
        "comparators": list(values.COMPARATORS), "categories": list(values.CATEGORIES),
    }


def vocabulary_terms(spark: SparkSession) -> DataFrame:
    """The fixed units as terms."""
    return fixed_unit_table(spark).select(
        F.col("spelling").alias("literal"), F.lit("units").alias("component"), F.lit("unit_spelling").alias("term_role"),
        F.lit("vocabulary").alias("source_table"), F.lit("controlled_spelling").alias("source_field"), "row_id",
        F.lit(None).cast("string").alias("lexical_term_id"), F.lit("atomic_unit").alias("boundary_hint"), F.lit(False).alias("fuzzy_allowed"),
        F.lit(None).cast("string").alias("display_name"), F.create_map().cast("map<string,string>").alias("attributes"),
    )


def dictionary_hits(terms: DataFrame, blocks: DataFrame, with_fuzzy: bool) -> DataFrame:
    """Exact hits and, where asked for, hits at one edit."""
    hits = matching.exact_hits(terms, blocks)
    if not with_fuzzy:
        return hits
    keyed = matching.keyed_terms(terms)
    found = blocks.withColumn("w", F.explode(matching.letter_words("text"))).select(*blocks.columns, "w.*")
    near = fuzzy.fuzzy_hits(keyed, found).drop("word", "edit_distance")
    return hits.unionByName(near.select(*hits.columns))


def component_results(tables: dict[str, DataFrame], blocks: DataFrame, component: str, request: Request) -> DataFrame:
    """The occurrences of one component, by page and place."""
    spark = blocks.sparkSession
    if request.pages is not None:
        blocks = matching.restrict_pages(blocks, request.pages)
    span = ["doc_id", "node_id", "page_number", "block_order", "start", "end", "matched_text"]
    slim = blocks.select("doc_id", "node_id", "page_number", "block_order", "text")
    if component in DICTIONARY:
        terms = eligible_terms(tables, [component])
        found = aggregation.occurrences(dictionary_hits(terms, slim, request.fuzzy), span)
        return aggregation.best_per_page(found, ["doc_id", "page_number"])
    units = vocabulary_terms(spark)
    if any(t in tables for t, c in NEEDS.items() if "units" in c):
        units = units.unionByName(eligible_terms(tables, ["units"]))
    if component == "units":
        return aggregation.unit_mentions(matching.unit_hits(units, slim), span).withColumn("component", F.lit("units"))
    spellings = [r[0] for r in units.select("literal").distinct().limit(matching.MOST_UNITS + 1).collect()]
    if len(spellings) > matching.MOST_UNITS:
        raise ValueError("TOO_MANY_UNITS: the unit vocabulary is over its bound")
    found = slim.select(*[c for c in slim.columns if c != "text"], F.posexplode(value_expressions(F.col("text"), spellings)).alias("ordinal", "v"))
    material = F.concat_ws("|", "node_id", F.col("v.start").cast("string"), F.col("v.end").cast("string"), "v.raw", F.lit(component), F.col("ordinal").cast("string"))
    return found.select(
        *[c for c in slim.columns if c != "text"], "v.*", F.lit(component).alias("component"),
        F.concat(F.lit("value:"), F.substring(F.sha2(material, 256), 1, 24)).alias("occurrence_id"),
    )


def _counters(found: DataFrame) -> list:
    """What a component's results are counted by, on the pass that writes them."""
    times = [F.count(F.lit(1)).alias("occurrences")]
    if "method" in found.columns:
        times += [F.count_if(F.col("method") == m).alias(m) for m in aggregation.METHODS]
    if "ambiguity" in found.columns:
        times.append(F.count_if(F.col("ambiguity") == "unresolved").alias("unresolved"))
    return times


def _stream(hits: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """Every block with the spans of its hits, each once."""
    key = ["doc_id", "block_order", "node_id"]
    span = F.struct(F.col("start"), F.col("end"), F.col("matched_text"), F.col(name).alias("name"))
    spans = hits.groupBy(*key).agg(F.array_sort(F.collect_set(span)).alias("spans"))
    return blocks.join(spans, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{merging.SPAN}>")))


def parameter_unit_values(tables: dict[str, DataFrame], blocks: DataFrame) -> DataFrame:
    """Values of the blocks with the unit that stands in each and the parameter name ahead of it.

    Parameter names and units are found in streams of their own, which are merged with the blocks in document order; a
    document whose streams do not agree with its blocks gives nothing.
    """
    slim = stage(blocks.select("doc_id", "block_order", "node_id", "text"), "blocks")
    names = None
    if "equipment" in tables:
        names = _stream(matching.exact_hits(eligible_terms(tables, ["parameter_names"]), slim), slim, "literal")
    terms = vocabulary_terms(slim.sparkSession)
    if "equipment" in tables:
        terms = terms.unionByName(eligible_terms(tables, ["units"]))
    units = _stream(matching.unit_hits(terms, slim), slim, "literal")
    return merging.with_values(merging.merge_streams(slim, names, units))


def run(tables: dict[str, DataFrame], blocks: DataFrame, request: Request, path: str, run_id: str) -> dict:
    """Run, write each component under ``path/run_id`` and return the manifest, which is written last.

    Results are counted while they are written: by an observation on the plan, not by a second job. A component that
    fails in Spark, or by a code of its own, leaves its error and no counts; a mistake in a program is raised.
    """
    spark = blocks.sparkSession
    chosen, results = request.resolved(), []
    for component in chosen:
        where = f"{path}/{run_id}/component={component}"
        counts = Observation(f"{run_id}-{component}")
        try:
            found = component_results(tables, blocks, component, request).drop("component")
            found.observe(counts, *_counters(found)).write.mode("errorifexists").parquet(where)
            seen = dict(counts.get)
            results.append({"component": component, "outcome": "completed", "occurrences": seen.pop("occurrences"), "counts": seen, "error": None})
        except (PySparkException, ValueError) as why:
            code = str(why).split(":")[0].split("]")[0].strip("[ ")[:60]
            if isinstance(why, ValueError) and not isinstance(why, PySparkException) and not re.fullmatch("[A-Z_]+", code):
                raise
            results.append({"component": component, "outcome": "failed", "occurrences": 0, "counts": {}, "error": code})
    done = sum(r["outcome"] == "completed" for r in results)
    overall = "completed" if done == len(results) else "partial" if done else "failed"
    manifest = {"run_id": run_id, "outcome": overall, "components": results, "fuzzy": request.fuzzy, "configuration_sha256": request.fingerprint()}
    text = json.dumps(manifest, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/{run_id}/_manifest")
    return manifest


def open_run(spark: SparkSession, path: str, run_id: str) -> tuple[dict, dict[str, DataFrame]]:
    """A run's manifest and the results of its completed components."""
    manifest = json.loads(spark.read.text(f"{path}/{run_id}/_manifest").first()[0])
    done = [c["component"] for c in manifest["components"] if c["outcome"] == "completed"]
    return manifest, {c: spark.read.parquet(f"{path}/{run_id}/component={c}") for c in done}
