"""The registered queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tolerance, units, values
from ..operators import aggregation, classification, fuzzy, graph, matching, paging, review, terms
from ..session import read_table
from ..sources import reviewed_html

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rows of a large table for each task that groups them.
TASK_ROWS = 250_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- inputs shared by several queries -------------------------------------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a block."""
    docs = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("block_order", "text"))
    return lines.select("doc_id", F.col("block_order").cast("string").alias("node_id"), "block_order", "text")


def benchmark_terms(spark: SparkSession, sf_dir: str, upper: bool = False) -> DataFrame:
    """The distinct lower-case words of six letters or more of the benchmark, as terms of a catalogue."""
    items = read_table(spark, sf_dir, "benchmark")
    words = items.select(F.explode(F.expr(r"regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\-]+', 0)")).alias("w"))
    words = words.select(F.lower("w").alias("w")).filter(F.col("w").rlike(r"^\p{L}{6,}$")).distinct()
    literal = T.simple_upper(F.col("w")) if upper else F.col("w")
    return words.select(
        literal.alias("literal"), F.lit("materials").alias("component"), F.lit("material_name").alias("term_role"),
        F.lit("words").alias("source_table"), F.lit("word").alias("source_field"), F.concat(F.lit("W-"), "w").alias("row_id"),
        F.lit(None).cast("string").alias("lexical_term_id"), F.lit("default").alias("boundary_hint"), F.lit(False).alias("fuzzy_allowed"),
        literal.alias("display_name"), F.create_map().cast("map<string,string>").alias("attributes"),
    )


_FOLD = "replace(lower({0}), 'ß', 'ss')"
_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\-]+')"
_TERMS = f"""terms AS (
  SELECT DISTINCT lower(w) AS w FROM (SELECT unnest({_WORDS.format("text")}) AS w FROM benchmark)
  WHERE regexp_full_match(lower(w), '\\p{{L}}{{6,}}')
)"""
_LINES = f"""lines AS (
  SELECT doc_id, line - 1 AS line, lines[line] AS text FROM (
    SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line
    FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT doc_id, line, n, ws[n] AS w FROM (
    SELECT doc_id, line, ws, unnest(generate_series(1, len(ws))) AS n FROM (SELECT doc_id, line, {_WORDS.format("text")} AS ws FROM lines))
)"""


@query(
    f"""WITH {_TERMS}, {_LINES}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, t.w AS literal, CASE WHEN words.w = t.w THEN 'exact' ELSE 'normalized_exact' END AS method,
  count(*) AS n FROM words JOIN terms t ON {_FOLD.format("words.w")} = {_FOLD.format("t.w")} GROUP BY ALL"""
)
def exact_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms occur in which documents, how often and by which method."""
    hits = matching.exact_hits(benchmark_terms(spark, sf_dir), document_lines(spark, sf_dir))
    return hits.groupBy("doc_id", "literal", "method").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TERMS}, {_LINES}
SELECT upper(t.w) AS literal, CASE WHEN words.w = upper(t.w) THEN 'exact' ELSE 'normalized_exact' END AS method, count(*) AS n
FROM words JOIN terms t ON {_FOLD.format("words.w")} = {_FOLD.format("upper(t.w)")} GROUP BY ALL"""
)
def normalized_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in capitals: nearly all hits are by case folding."""
    hits = matching.exact_hits(benchmark_terms(spark, sf_dir, upper=True), document_lines(spark, sf_dir))
    return hits.groupBy("literal", "method").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TERMS}, {_LINES}, hits AS (
  SELECT doc_id, t.w AS literal, words.w AS matched_text, line, n, {_FOLD.format("words.w")} AS k
  FROM words JOIN terms t ON {_FOLD.format("words.w")} = {_FOLD.format("t.w")})
SELECT CAST(doc_id AS VARCHAR) AS doc_id, literal, matched_text, CAST(line AS INTEGER) AS block_order FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY line, n) AS r FROM hits) WHERE r = 1"""
)
def occurrence_best_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which terms occur in which page, each once, with its first occurrence."""
    hits = matching.exact_hits(benchmark_terms(spark, sf_dir), document_lines(spark, sf_dir))
    span = ["doc_id", "node_id", "block_order", "start", "end", "matched_text"]
    found = aggregation.occurrences(hits, span)
    best = aggregation.best_per_page(found, ["doc_id"])
    return best.select("doc_id", "literal", "matched_text", "block_order")


@query(
    f"""WITH {_TERMS}, {_LINES}, seen AS (
  SELECT DISTINCT {_FOLD.format("w")} AS word FROM words WHERE regexp_full_match({_FOLD.format("w")}, '\\p{{L}}{{5,}}')),
a AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM seen)),
b AS (SELECT w AS key, i, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM (SELECT w, unnest(generate_series(1, length(w))) AS i FROM terms))
SELECT word, key FROM a JOIN b ON a.i = b.i AND a.d = b.d WHERE length(word) = length(key) AND word <> key
UNION SELECT word, w FROM a JOIN terms ON d = w UNION SELECT word, key FROM seen JOIN b ON d = word"""
)
def fuzzy_word_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents at exactly one edit from a term."""
    lines = document_lines(spark, sf_dir)
    words = lines.select(F.explode(F.expr(r"regexp_extract_all(text, '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\-]+', 0)")).alias("w")).distinct()
    words = words.select(T.casefold("w").alias("word")).filter(F.col("word").rlike(r"^\p{L}{5,}$"))
    keys = benchmark_terms(spark, sf_dir).select(F.col("literal").alias("key"))
    return fuzzy.one_edit_pairs(words, keys)


@query(
    """SELECT p_name AS matched_text, min('P-' || p_partkey) AS row_id,
  CASE WHEN count(*) > 1 THEN 'unresolved' ELSE 'none' END AS ambiguity, count(*) AS n_blocks
FROM part GROUP BY p_name"""
)
def ambiguity_by_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue names that several rows share are unresolved; the least row id stands for them."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = parts.select(
        F.col("p_name").alias("literal"), F.lit("equipment").alias("component"), F.lit("equipment_type").alias("term_role"),
        F.lit("part").alias("source_table"), F.lit("p_name").alias("source_field"), F.concat(F.lit("P-"), "p_partkey").alias("row_id"),
        F.lit(None).cast("string").alias("lexical_term_id"), F.lit("default").alias("boundary_hint"), F.lit(False).alias("fuzzy_allowed"),
        F.col("p_name").alias("display_name"), F.create_map().cast("map<string,string>").alias("attributes"),
    )
    blocks = parts.groupBy("p_name").agg(F.count("*").alias("n_blocks")).select(
        F.lit("parts").alias("doc_id"), F.col("p_name").alias("node_id"), F.col("p_name").alias("text"), "n_blocks"
    )
    hits = matching.exact_hits(names, blocks).filter(F.col("matched_text") == F.col("text"))
    found = aggregation.occurrences(hits, ["doc_id", "node_id", "n_blocks", "start", "end", "matched_text"])
    return found.select("matched_text", "row_id", "ambiguity", "n_blocks")


def lot_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with three terms for each order line."""
    keys = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = lambda a, b, c="": F.concat(F.lit(a), "l_orderkey", F.lit(b), "l_linenumber", F.lit(c))
    return keys.select(F.explode(F.array(name("lot ", "-"), name("batch ", "/"), name("(", ".", ")-sample"))).alias("literal")).select(
        "literal", F.lit("equipment").alias("component"), F.lit("equipment_type").alias("term_role"), F.lit("lots").alias("source_table"),
        F.lit("lot").alias("source_field"), F.col("literal").alias("row_id"), F.lit(None).cast("string").alias("lexical_term_id"),
        F.lit("default").alias("boundary_hint"), F.lit(False).alias("fuzzy_allowed"), F.col("literal").alias("display_name"),
        F.create_map().cast("map<string,string>").alias("attributes"),
    )


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each order that names some of its lots between dots and brackets."""
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("Lot "), key, F.lit("-1, batch "), key, F.lit("/2 and lot  "), key, F.lit("-3 ........ ("), key, F.lit(".4)-Sample; not lot "), key, F.lit("-1-x"),
    )
    return read_table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.lit("n").alias("node_id"), text.alias("text"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CASE l_linenumber WHEN 1 THEN 'lot ' || o_orderkey || '-1' WHEN 2 THEN 'batch ' || o_orderkey || '/2'
    WHEN 3 THEN 'lot ' || o_orderkey || '-3' ELSE '(' || o_orderkey || '.4)-sample' END AS literal,
  CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 8 + length(CAST(o_orderkey AS VARCHAR)) WHEN 3 THEN 21 + 2 * length(CAST(o_orderkey AS VARCHAR))
    ELSE 38 + 3 * length(CAST(o_orderkey AS VARCHAR)) END AS start,
  CASE l_linenumber WHEN 2 THEN 'exact' ELSE 'normalized_exact' END AS method
FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4) ON l_orderkey = o_orderkey"""
)
def catalogue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of three terms for each order line, searched in a note for each order."""
    hits = matching.exact_hits(lot_terms(spark, sf_dir), order_notes(spark, sf_dir))
    return hits.select("doc_id", "literal", "start", "method")


def _part_catalogue(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Equipment rows made of parts: type from the name, parameter from the type, unit from the brand and size."""
    part = read_table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*(F.lit(x) for x in ("rpm", "mL/min", "n/a", "2-6", "bar or Pa", "min⁻¹", "12", ""))), (F.col("p_size") % 8 + 1).cast("int"))
    return {
        "equipment": part.select(
            F.col("p_name").alias("Equipment type (EN)"), F.col("p_type").alias("Operating parameter (EN)"), unit.alias("Unit"),
            F.lit("").alias("Source / section"), F.concat(F.lit("P-"), "p_partkey").alias("row_id"),
            F.col("p_partkey").cast("string").alias("equipment_type_id"), F.lit("").alias("parameter_id"),
        )
    }


@query(
    r"""WITH t AS (
  SELECT 'equipment_type' AS term_role, p_name AS literal FROM part WHERE length(p_name) >= 3
  UNION ALL SELECT 'parameter_name', p_type FROM part WHERE length(p_type) >= 3
  UNION ALL SELECT 'unit_spelling', ['rpm', 'mL/min', 'min⁻¹'][CASE p_size % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END] FROM part WHERE p_size % 8 IN (0, 1, 5)
)
SELECT term_role, literal, term_role <> 'unit_spelling' AND regexp_full_match(literal, '[A-Za-z]{6,}') AS fuzzy_allowed, count(*) AS n
FROM t GROUP BY ALL"""
)
def term_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of an equipment table: which cells may be searched, and which with one edit."""
    found = terms.eligible_terms(_part_catalogue(spark, sf_dir), ["equipment", "parameter_names", "units"])
    return found.groupBy("term_role", "literal", "fuzzy_allowed").agg(F.count("*").alias("n"))


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each order line whose text names a quantity."""
    q = F.col("l_quantity").cast("int").cast("string")
    more = (F.col("l_quantity").cast("int") + 5).cast("string")
    form = F.col("l_linenumber") % 6
    said = (
        F.when(form == 0, F.concat(F.lit("charge "), q, F.lit(" kg")))
        .when(form == 1, F.concat(F.lit("hold at "), q, F.lit("–"), more, F.lit(" °C")))
        .when(form == 2, F.concat(F.lit("with < "), q, F.lit(" %")))
        .when(form == 3, F.concat(F.lit("add "), q, F.lit(" ± 5 g")))
        .when(form == 4, F.concat(F.lit("Step "), q, F.lit(" rpm")))
        .otherwise(F.lit("pump OFF"))
    )
    table = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return table.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").cast("string").alias("node_id"), said.alias("text"))


@query(
    """WITH q AS (SELECT CAST(floor(l_quantity) AS INTEGER) AS q, l_linenumber % 6 AS f FROM lineitem)
SELECT form, low, high, comparator, unit, identity, label, count(*) AS n FROM (
  SELECT CASE f WHEN 0 THEN 'scalar' WHEN 1 THEN 'range' WHEN 2 THEN 'comparison' WHEN 3 THEN 'tolerance' ELSE 'category' END AS form,
    CASE WHEN f < 4 THEN CAST(q AS VARCHAR) END AS low,
    CASE f WHEN 1 THEN CAST(q + 5 AS VARCHAR) WHEN 3 THEN '5' END AS high,
    CASE f WHEN 2 THEN '<' END AS comparator,
    CASE f WHEN 0 THEN 'kg' WHEN 1 THEN '°C' WHEN 2 THEN '%' WHEN 3 THEN 'g' END AS unit,
    CASE f WHEN 0 THEN 'kg' WHEN 1 THEN 'deg_C' WHEN 2 THEN 'percent' WHEN 3 THEN 'g' END AS identity,
    CASE f WHEN 5 THEN 'OFF' END AS label
  FROM q WHERE f <> 4) GROUP BY ALL"""
)
def value_expression_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars, ranges, comparisons, tolerances and categories read from texts; a step number is none."""
    found = _quantities(spark, sf_dir).select(F.explode(values.value_expressions(F.col("text"))).alias("v")).select("v.*")
    return found.groupBy("form", "low", "high", "comparator", "unit", "identity", "label").agg(F.count("*").alias("n"))


def _unit_terms(spark: SparkSession) -> DataFrame:
    """The fixed units as terms."""
    table = units.fixed_unit_table(spark)
    return table.select(
        F.col("spelling").alias("literal"), F.lit("units").alias("component"), F.lit("unit_spelling").alias("term_role"),
        F.lit("vocabulary").alias("source_table"), F.lit("spelling").alias("source_field"), "row_id",
        F.lit(None).cast("string").alias("lexical_term_id"), F.lit("atomic_unit").alias("boundary_hint"), F.lit(False).alias("fuzzy_allowed"),
        F.lit(None).cast("string").alias("display_name"), F.create_map().cast("map<string,string>").alias("attributes"),
    )


@query(
    """WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 6 AS f, length(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS a,
  CASE WHEN l_linenumber % 6 = 1 THEN length(CAST(CAST(l_quantity AS INTEGER) + 5 AS VARCHAR)) ELSE 0 END AS b FROM lineitem),
s AS (SELECT DISTINCT l_orderkey, l_linenumber, a + b AS at, unnest(CASE f WHEN 0 THEN ['kg'] WHEN 1 THEN ['°C', 'C'] WHEN 2 THEN ['%'] WHEN 3 THEN ['g']
  WHEN 4 THEN ['rpm'] ELSE [] END) AS unit FROM q)
SELECT unit AS literal, unit AS matched_text, 'exact' AS method, count(*) AS n FROM s GROUP BY ALL"""
)
def unit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the fixed units, one for each span, the exact spelling first."""
    parts = 1 + read_table(spark, sf_dir, "lineitem").count() // TASK_ROWS
    found = aggregation.unit_mentions(matching.unit_hits(_unit_terms(spark), _quantities(spark, sf_dir)), parts=parts)
    return found.groupBy("literal", "matched_text", "method").agg(F.count("*").alias("n"))


_UNIT_ROWS = ", ".join(f"('{s}', '{c}', '{i}')" for s, c, i in units.fixed_spellings())


@query(
    f"""WITH v(spelling, controlled_spelling, identity) AS (VALUES {_UNIT_ROWS}),
u AS (SELECT unnest(CASE l_linenumber % 6 WHEN 0 THEN ['kg'] WHEN 1 THEN ['°C', 'C'] WHEN 2 THEN ['%'] WHEN 3 THEN ['g'] WHEN 4 THEN ['rpm'] ELSE [] END) AS spelling FROM lineitem),
n AS (SELECT spelling, count(*) AS n FROM u GROUP BY spelling)
SELECT spelling, controlled_spelling, identity, 'vocab:' || identity AS row_id, sha256('unit' || chr(10) || spelling) AS finding_id, coalesce(n, 0) AS lines FROM v LEFT JOIN n USING (spelling)"""
)
def unit_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controlled vocabulary with its identities, and how many order lines name each spelling."""
    table = units.fixed_unit_table(spark)
    named = matching.unit_blocks(_unit_terms(spark), _quantities(spark, sf_dir)).select(F.col("literal").alias("spelling"), F.col("blocks").alias("lines"))
    out = table.withColumn("finding_id", review.finding_id(F.lit("unit"), F.col("spelling"))).join(named, "spelling", "left")
    return out.withColumn("lines", F.coalesce("lines", F.lit(0)))


@query(
    """SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)"""
)
def page_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label excludes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(1).alias("page_number"))
    out = read_table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("page_number"), (F.col("toxic") != 1).alias("eligible"))
    return classification.allow_list(docs, out).select("doc_id", "source")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls for each document, their answers made from its id."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("call_id"))
    k = F.col("doc_id") * 7 + F.col("call_id") * 3
    status = F.when(F.col("doc_id") % 5 == 0, "empty").when(k % 11 == 0, "needs_review").when(k % 13 == 0, "empty").otherwise("ok")
    labels = F.when((status == "ok") & (F.col("doc_id") % 3 != 0), F.array(F.when(k % 4 == 0, "MATERIALS").otherwise("COVER_PAGE"))).otherwise(F.array().cast("array<string>"))
    return docs.select(
        "doc_id", F.lit(1).alias("page_number"), "call_id", F.when(k % 17 == 0, "failed").otherwise("valid").alias("availability"),
        status.alias("status"), labels.alias("labels"),
    )


@query(
    """WITH c AS (SELECT doc_id, call_id, doc_id * 7 + call_id * 3 AS k FROM documents, (VALUES (1), (2), (3)) v(call_id)),
o AS (SELECT doc_id, call_id, k, k % 17 <> 0 AS ok,
  CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN k % 11 = 0 THEN 'needs_review' WHEN k % 13 = 0 THEN 'empty' ELSE 'ok' END AS status FROM c),
p AS (SELECT doc_id, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND status = 'needs_review') AS review,
  count(*) FILTER (ok AND status = 'empty') AS empty, count(*) FILTER (ok AND status = 'ok') AS fine,
  count(*) FILTER (ok AND status = 'ok' AND doc_id % 3 <> 0) AS labels,
  count(*) FILTER (ok AND status = 'ok' AND doc_id % 3 <> 0 AND k % 4 = 0) AS kept FROM o GROUP BY doc_id),
m AS (SELECT *, CASE WHEN valid < 3 THEN 'incomplete' WHEN review > 0 THEN 'needs_review' WHEN empty = 3 THEN 'empty'
  WHEN empty > 0 AND fine > 0 THEN 'needs_review' WHEN labels = 0 THEN 'needs_review' ELSE 'completed' END AS kind FROM p)
SELECT doc_id, kind, NOT (kind = 'completed' AND kept = 0) AS eligible,
  CASE WHEN kind = 'incomplete' THEN 'incomplete' WHEN kind = 'needs_review' THEN 'requires_review' WHEN kind = 'empty' THEN 'empty'
  WHEN kept = 0 THEN 'excluded' ELSE 'labels' END AS eligibility_reason,
  CAST(CASE WHEN kind = 'empty' THEN 0 WHEN valid = 3 AND fine = 3 AND labels = 0 THEN 1 ELSE labels END AS INTEGER) AS n_labels FROM m"""
)
def page_merge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge three calls for each page and decide its eligibility."""
    found = classification.eligibility(classification.merge_pages(_calls(spark, sf_dir)))
    return found.select("doc_id", "kind", "eligible", "eligibility_reason", F.size("labels").alias("n_labels"))


@query(
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS page,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN trim(regexp_replace(substr(text, 5, 60), '\s+', ' ', 'g'))
  ELSE trim(regexp_replace('zz' || substr(text, 5, 60), '\s+', ' ', 'g')) END AS quote FROM documents)
SELECT doc_id, CASE WHEN quote <> '' AND contains(page, quote) THEN 'verified' ELSE 'unverified' END AS verification,
  CASE WHEN quote = '' THEN 'normalized quote is empty' WHEN NOT contains(page, quote) THEN 'quote not found in normalized page text' END AS verification_reason FROM n"""
)
def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence quotes checked against the text of their page."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = F.substring("text", 5, 60)
    quote = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, cut).otherwise(F.concat(F.lit("zz"), cut))
    evidence = docs.select("doc_id", F.lit(1).alias("page_number"), quote.alias("quote"), F.lit(None).cast("string").alias("element_id"))
    pages = docs.select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("readable_text"))
    return classification.check_quotes(evidence, pages).select("doc_id", "verification", "verification_reason")


@query()
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read web pages as reviewed documents: those that are none say why."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return reviewed_html.read_blocks(pages).groupBy("error_code").agg(F.countDistinct("doc_id").alias("documents"), F.count("node_id").alias("blocks"))


@query()
def html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render every document as reviewed HTML, read it back, and count its blocks."""
    import pandas as pd

    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                blocks = [{"node_id": f"n{k}", "element_id": f"n{k}", "kind": "text", "text": x} for k, x in enumerate(t.split("\n"))]
                facts = {"job_id": d, "revision_id": "r", "generation": 1, "status": "SUCCEEDED"}
                rows.append((d, reviewed_html.render(facts, [(1, blocks)]).encode()))
                size += len(rows[-1][1])
                if size >= reviewed_html.FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=["doc_id", "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "content"])

    files = docs.mapInPandas(run, "doc_id string, content binary")
    back = reviewed_html.read_blocks(files).groupBy("doc_id").agg(
        F.count("node_id").alias("blocks"), F.max("error_code").alias("error_code"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "text"))), lambda x: x["text"]), "\n"), 256).alias("text_sha256"),
    )
    return back


ORACLE_SQL["html_round_trip"] = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS blocks,
  CAST(NULL AS VARCHAR) AS error_code, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty orders after a key."""
    return paging.keyset_page(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 1000, 50)


@query(
    """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20"""
)
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of customers with their number."""
    return paging.offset_page(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 20, 10)


@query(
    """SELECT k.n_regionkey, r.r_name FROM (SELECT DISTINCT n_regionkey + 2 AS n_regionkey FROM nation) k LEFT JOIN region r ON k.n_regionkey = r.r_regionkey"""
)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with their rows; a key without one stays."""
    keys = read_table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 2).alias("n_regionkey")).distinct()
    table = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return paging.lookup(keys, table, "n_regionkey").select("n_regionkey", "r_name")


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    return table.select(
        F.col("conv_id").alias("job_id"), name(F.col("turn")).alias("revision_id"),
        F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_revision_id"), (F.col("turn") + 1).alias("generation"),
        ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("approved"),
    )


@query(
    """WITH r AS (SELECT conv_id AS job_id, turn, conv_id || ':' || turn AS revision_id,
  CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent, turn + 1 AS generation FROM conversations),
w AS (SELECT *, lag(revision_id) OVER (PARTITION BY job_id ORDER BY generation) AS before, row_number() OVER (PARTITION BY job_id ORDER BY generation) AS n FROM r)
SELECT job_id, max(generation) AS generation, arg_max(revision_id, generation) AS revision_id,
  count(*) FILTER (n <> generation OR parent IS DISTINCT FROM before) AS broken FROM w GROUP BY job_id"""
)
def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each chain and the number of its revisions that do not follow their parent."""
    revisions = _revisions(spark, sf_dir)
    broken = review.chain_violations(revisions).groupBy("job_id").agg(F.count("*").alias("broken"))
    heads = review.latest(revisions).select("job_id", "generation", "revision_id")
    return heads.join(broken, "job_id", "left").withColumn("broken", F.coalesce("broken", F.lit(0)).cast("long"))


@query(
    """WITH r AS (SELECT conv_id AS job_id, turn + 1 AS generation, (conv_id + turn) % 3 <> 0 AS approved FROM conversations),
w AS (SELECT *, lag(approved) OVER (PARTITION BY job_id ORDER BY generation) AS before FROM r)
SELECT job_id, generation FROM w WHERE before AND NOT approved"""
)
def invalidated_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals that a revision took back."""
    pages = _revisions(spark, sf_dir).withColumn("page_number", F.lit(1))
    return review.invalidated_approvals(pages).select("job_id", "generation")


@query(
    """SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
)
def last_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events of a kind the last."""
    table = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return review.last_edit(table, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS review_id, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
f AS (SELECT review_id, event_type, max(seq) AS last, arg_max(value, seq) AS value FROM e WHERE event_type <> 'error' GROUP BY ALL)
SELECT review_id, event_type AS finding_id, CAST(value AS VARCHAR) AS display_text FROM f"""
)
def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold every user's events over one finding for each kind of event: the last text stays."""
    from pyspark.sql import Window

    events = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    name = F.col("user_id").cast("string")
    findings = events.filter("event_type <> 'error'").select(name.alias("review_id"), F.col("event_type").alias("finding_id")).distinct()
    findings = findings.select(
        "review_id", (F.crc32(F.col("finding_id").cast("binary")) % 1000).cast("int").alias("position"), "finding_id", F.lit("materials").alias("component"),
        F.lit("").alias("display_text"), F.lit(1).alias("page"), F.lit("document_evidence").alias("evidence"),
        F.lit(False).alias("removed"), F.lit("lexical").alias("origin"),
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edits = events.withColumn("seq", F.row_number().over(order)).filter("event_type <> 'error'").select(
        name.alias("review_id"), "seq", F.lit("patch").alias("op"), F.col("event_type").alias("finding_id"), F.lit("materials").alias("component"),
        F.col("value").cast("string").alias("display_text"), F.lit(1).alias("page"), F.lit("document_evidence").alias("evidence"),
    )
    return review.fold_edits(findings, edits).select("review_id", "finding_id", "display_text")


@query(
    """SELECT user_id, event_id, CASE WHEN n <= 3 THEN n ELSE 0 END AS slot, CAST(least(300, 10 * pow(2, n - 1)) AS DOUBLE) AS wait FROM (
  SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS n FROM events
  WHERE event_type IN ('view', 'click') AND ts <= TIMESTAMP '2024-01-20')"""
)
def job_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due jobs with one of three slots for each owner, and the wait before a next try."""
    from pyspark.sql import Window

    phase = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "OCR").otherwise("FAILED")
    jobs = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").alias("due"), phase.alias("phase"))
    ready = paging.due(jobs, F.lit("2024-01-20").cast("timestamp"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("due", "event_id"))
    out = paging.slots(ready.withColumn("tries", n - 1), 3, ["user_id"], ["due", "event_id"])
    return out.select("user_id", "event_id", F.coalesce("slot", F.lit(0)).alias("slot"), paging.backoff_seconds(F.col("tries")).alias("wait"))


@query(
    """SELECT event_id, sha256('materials' || chr(10) || event_type || chr(10) || user_id || chr(10) || event_id) AS finding_id FROM events"""
)
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of findings from their fields."""
    table = read_table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return table.select("event_id", review.finding_id(F.lit("materials"), F.col("event_type"), F.col("user_id"), F.col("event_id")).alias("finding_id"))


@query(
    """SELECT event_type AS component, CAST(user_id % 3 AS VARCHAR) AS method, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id % 3), (event_type), ())"""
)
def run_monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by component and method, by component, and in all, in one pass."""
    table = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("component"), (F.col("user_id") % 3).cast("string").alias("method"))
    return aggregation.monitoring(table).select("component", "method", "n")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS review_id, string_agg('materials' || chr(9) || 'page ' || (turn + 1) || chr(9) || role, chr(10) ORDER BY turn, role) AS report
FROM conversations GROUP BY conv_id"""
)
def results_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text report for each review."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    findings = table.select(
        F.col("conv_id").cast("string").alias("review_id"), F.col("turn").cast("int").alias("position"), F.lit("materials").alias("component"),
        F.col("role").alias("display_text"), (F.col("turn") + 1).cast("int").alias("page"), F.lit("document_evidence").alias("evidence"),
        F.lit(False).alias("removed"),
    )
    return review.report(findings)


@query(
    """WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Toler +' || p_size || '%' WHEN 1 THEN 'Tolerance ±' || p_size || '%'
  WHEN 2 THEN 'Tolerance +' || p_size || ' / -' || p_size WHEN 3 THEN 'Tolerable +' || p_size || '%' WHEN 4 THEN 'Toler. + ' || p_size || ',5'
  ELSE 'Tolerance +/-' || p_size END AS text, p_size % 6 IN (0, 4) AS ambiguous, p_size FROM part)
SELECT p_partkey, ambiguous, CASE p_size % 6 WHEN 0 THEN 'Tolerance ±' || p_size || '%' WHEN 4 THEN 'Tolerance ± ' || p_size || ',5' END AS suggestion FROM t"""
)
def tolerance_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose plus sign may have been plus-minus, with the suggested text."""
    n = F.col("p_size").cast("string")
    texts = [
        F.concat(F.lit("Toler +"), n, F.lit("%")), F.concat(F.lit("Tolerance ±"), n, F.lit("%")),
        F.concat(F.lit("Tolerance +"), n, F.lit(" / -"), n), F.concat(F.lit("Tolerable +"), n, F.lit("%")),
        F.concat(F.lit("Toler. + "), n, F.lit(",5")), F.concat(F.lit("Tolerance +/-"), n),
    ]
    said = F.element_at(F.array(*texts), (F.col("p_size") % 6 + 1).cast("int"))
    table = read_table(spark, sf_dir, "part").select("p_partkey", said.alias("text"))
    found = tolerance.is_ambiguous_tolerance(F.col("text"))
    return table.select("p_partkey", found.alias("ambiguous"), F.when(found, tolerance.suggested_text(F.col("text"))).alias("suggestion"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + 10 AS b FROM lineitem),
e AS (SELECT DISTINCT l_orderkey, unnest([a, b]) AS p FROM s),
c AS (SELECT l_orderkey, p AS lo, lead(p) OVER (PARTITION BY l_orderkey ORDER BY p) AS hi FROM e)
SELECT c.l_orderkey, lo AS "from", hi AS "to", count(DISTINCT l_linenumber) AS covers, min(l_linenumber) AS first
FROM c JOIN s ON s.l_orderkey = c.l_orderkey AND s.a <= lo AND s.b >= hi WHERE hi IS NOT NULL GROUP BY ALL"""
)
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each order cut at all edges, with what covers each piece."""
    table = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    start = F.col("l_quantity").cast("int")
    spans = table.select("l_orderkey", F.col("l_linenumber").alias("finding_id"), start.alias("start"), (start + 10).alias("end"))
    out = review.highlight_segments(spans, ["l_orderkey"])
    return out.select("l_orderkey", "from", "to", F.size("finding_ids").cast("long").alias("covers"), F.element_at("finding_ids", 1).alias("first"))


_EDGES = """edges AS (
  SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    supplier = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    return nation.unionByName(supplier)


@query(
    f"""WITH RECURSIVE {_EDGES}, below(node, depth) AS (
  SELECT parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges)
  UNION SELECT e.child, b.depth + 1 FROM below b JOIN edges e ON e.parent = b.node)
SELECT node, max(depth) AS depth FROM below GROUP BY node"""
)
def graph_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth of every node of a relationship graph."""
    return graph.depths(_edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_EDGES}, below(root, node) AS (
  SELECT parent, child FROM edges WHERE parent LIKE 'r%' UNION SELECT b.root, e.child FROM below b JOIN edges e ON e.parent = b.node)
SELECT root, node FROM below"""
)
def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes below each region."""
    edges = _edges(spark, sf_dir)
    return graph.descendants(edges, edges.filter(F.col("parent").startswith("r")).select(F.col("parent").alias("node")).distinct())


@query(
    """SELECT n_name, o_orderpriority, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_cents, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY ALL"""
)
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and priority: filters and columns reach the scans, small sides are broadcast by size."""
    line = read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"))
    line = line.select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"))
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = line.join(orders, "l_orderkey").join(customer, "o_custkey").join(nation, "n_nationkey")
    return joined.groupBy("n_name", "o_orderpriority").agg(F.sum("cents").alias("revenue_cents"), F.count("*").alias("n"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""
)
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and quantities by flag and status with subtotals."""
    table = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return table.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("q").alias("sum_qty"))


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3"""
)
def newest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the three largest orders are kept."""
    table = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return paging.newest(table, 3, [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_custkey"])


@query(
    """SELECT k, 'left' AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT k, 'right' FROM (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)"""
)
def set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one of two sets holds."""
    a = read_table(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).distinct()
    b = read_table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return paging.disagreement(a, b)
