"""Registered queries of publications: nested artefacts, merged streams, findings, approvals and snapshot digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversion, digests, findings, merging
from ..session import read_table, stage_path
from ..sources import paged_json
from ..streaming import jobs
from .queries import _quantities, query


@query(
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id + 1 AS INTEGER) AS page_number, CAST(len(t) AS BIGINT) AS blocks, sha256(array_to_string(t, chr(10))) AS text_sha256 FROM d"""
)
def artifact_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the pages of one nested JSON file, a block for each line, read back by ranges of its bytes."""
    docs = read_table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    page = F.struct((F.col("doc_id") + 1).alias("page_number"))
    block = F.transform(F.split("text", "\n"), lambda t: F.to_json(F.struct(F.struct((F.col("doc_id") + 1).alias("page_number"), t.alias("text")).alias("block"))))
    path = stage_path(spark, "artifact")
    paged_json.write_artifact(docs.select(F.col("doc_id").alias("page_order"), F.to_json(page).alias("page"), block.alias("blocks")), path, {"schema_version": "1"})
    file = spark.read.format("binaryFile").load(path).select("path").first()[0]
    _, back = paged_json.read_artifact(spark, file)
    said = F.array_sort(F.collect_list(F.struct("block_order", F.get_json_object("block", "$.block.text").alias("t"))))
    return back.groupBy("page_number").agg(
        F.count("block").alias("blocks"), F.sha2(F.array_join(F.transform(said, lambda x: F.coalesce(x["t"], F.lit(""))), "\n"), 256).alias("text_sha256")
    )


@query(
    """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(CAST(floor(l_quantity) AS INTEGER)) AS q FROM lineitem GROUP BY ALL
), broken AS (SELECT DISTINCT o, min(n) AS n FROM l WHERE o % 50 = 7 AND n = 1 GROUP BY o
), v AS (SELECT CAST(o AS VARCHAR) AS doc_id, n AS block_order, CASE n % 6 WHEN 0 THEN 'scalar' WHEN 1 THEN 'range' WHEN 2 THEN 'comparison' WHEN 3 THEN 'tolerance' ELSE 'category' END AS form,
    CASE WHEN n % 6 < 4 THEN CAST(q AS VARCHAR) END AS low, CASE n % 6 WHEN 0 THEN 'unit kg' WHEN 1 THEN 'unit °C' WHEN 2 THEN 'unit %' WHEN 3 THEN 'unit g' END AS unit_name,
    CASE n % 6 WHEN 0 THEN 'charge' WHEN 1 THEN 'hold' WHEN 2 THEN 'with' WHEN 3 THEN 'add' ELSE 'pump' END AS parameter_name, NULL AS error_code
  FROM l WHERE n % 6 <> 4 AND o NOT IN (SELECT o FROM broken))
SELECT * FROM v UNION ALL SELECT CAST(o AS VARCHAR), n, NULL, NULL, NULL, NULL, 'BLOCK_IDENTITY_MISMATCH' FROM broken"""
)
def merged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of quantities merged with their parameter and unit streams; values with the unit and name beside them."""
    blocks = _quantities(spark, sf_dir).groupBy("doc_id", F.col("node_id").cast("int").alias("block_order")).agg(
        F.min_by("text", F.regexp_extract("text", r"(\d+)", 1).try_cast("int")).alias("text")
    )
    blocks = blocks.withColumn("text", F.coalesce("text", F.lit("pump OFF"))).withColumn("node_id", F.col("block_order").cast("string"))
    first, last = F.regexp_extract("text", r"^(\S+)", 1), F.regexp_extract("text", r"(\S+)$", 1)
    span = lambda a, b, t, n: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), t.alias("matched_text"), n.alias("name"))
    names = blocks.withColumn("spans", F.array(span(F.lit(0), F.length(first), first, F.lower(first))))
    unit = span(F.length("text") - F.length(last), F.length("text"), last, F.concat(F.lit("unit "), last))
    units = blocks.withColumn("spans", F.when(last != "OFF", F.array(unit)).otherwise(F.array().cast(f"array<{merging.SPAN}>")))
    units = units.filter(~((F.col("doc_id").cast("long") % 50 == 7) & (F.col("block_order") == 1)))
    merged = merging.merge_streams(blocks, names, units)
    values = merging.with_values(merged).select("doc_id", "block_order", "form", "low", "unit_name", "parameter_name", F.lit(None).cast("string").alias("error_code"))
    return values.unionByName(merged.filter("error_code is not null").select("doc_id", "block_order", "error_code"), allowMissingColumns=True)


_EVENTS = """e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'units' WHEN 'click' THEN 'quantity_expressions' ELSE 'materials' END AS component, 'o' || event_id % 500 AS occurrence_id,
  event_id % 5 AS page_number, event_id % 3 AS block_order, 'n' || event_id % 7 AS node_id, event_id % 100 AS s, event_id % 100 + 4 AS e, CASE WHEN event_id % 997 = 0 THEN props ELSE 'text' END AS t FROM events)"""


@query(
    f"""WITH {_EVENTS}, f AS (SELECT *, sha256(concat_ws(chr(10), component, CASE component WHEN 'units' THEN 'unit' WHEN 'materials' THEN 'dictionary' ELSE 'value' END, occurrence_id, page_number, node_id, s, e)) AS finding_id FROM e
), o AS (SELECT user_id, finding_id, any_value(component) AS component, any_value(occurrence_id) AS occurrence_id, any_value(page_number) AS page_number, min(block_order) AS block_order,
    any_value(s) AS s, any_value(e) AS e, any_value(node_id) AS node_id, min(t) AS t, count(DISTINCT t) > 1 AS differs FROM f GROUP BY ALL
), bad AS (SELECT DISTINCT user_id FROM o WHERE differs)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY page_number, block_order, s, e, component, occurrence_id, node_id, finding_id) AS INTEGER) AS position, finding_id, t AS display_text, NULL AS error_code
FROM o WHERE user_id NOT IN (SELECT user_id FROM bad) UNION ALL SELECT user_id, NULL, NULL, NULL, 'ARTIFACT_REJECTED' FROM bad"""
)
def projected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as published occurrences: their findings in page order, or why there are none."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    component = F.when(F.col("event_type") == "view", "units").when(F.col("event_type") == "click", "quantity_expressions").otherwise("materials")
    text = F.when(k % 997 == 0, F.col("props")).otherwise("text")
    found = e.select(
        "user_id", component.alias("component"), F.concat(F.lit("o"), k % 500).alias("occurrence_id"), (k % 5).alias("page_number"), (k % 3).alias("block_order"),
        F.concat(F.lit("n"), k % 7).alias("node_id"), (k % 100).alias("start"), (k % 100 + 4).alias("end"), text.alias("matched_text"),
    )
    return findings.project(found, ["user_id"]).select("user_id", "position", "finding_id", "display_text", "error_code")


@query(
    """WITH r AS (SELECT c_custkey AS review_id, 'r' || c_nationkey % 4 AS revision_id, CASE WHEN c_custkey % 6 = 0 THEN 'r' || c_nationkey % 4 END AS approved FROM customer
), c AS (SELECT o_orderkey AS seq, revision_id, approved, 'r' || o_orderkey % 4 AS expected, CASE WHEN o_orderkey % 5 = 0 THEN 'r9' ELSE revision_id END AS target, review_id
  FROM orders JOIN r ON review_id = o_custkey
), g AS (SELECT *, coalesce(max(CAST(expected = revision_id AND target = revision_id AS INTEGER)) OVER (PARTITION BY review_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
    OR coalesce(approved = revision_id, false) AS already FROM c
), o AS (SELECT *, CASE WHEN expected <> revision_id THEN 'CONFLICT' WHEN target <> revision_id THEN 'VALIDATION_ERROR' WHEN already THEN 'UNCHANGED' ELSE 'CHANGED' END AS outcome FROM g)
SELECT seq, outcome, CASE WHEN already OR outcome = 'CHANGED' THEN revision_id ELSE approved END AS approved_after FROM o"""
)
def approval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as approval commands on their customers' reviews: what each does."""
    revision = F.concat(F.lit("r"), F.col("c_nationkey") % 4)
    reviews = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("review_id"), revision.alias("revision_id"), F.when(F.col("c_custkey") % 6 == 0, revision).alias("approved_revision_id")
    )
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("review_id"), F.col("o_orderkey").alias("seq"))
    commands = orders.join(reviews.select("review_id", "revision_id"), "review_id").select(
        "review_id", "seq", F.concat(F.lit("r"), F.col("seq") % 4).alias("expected_revision_id"),
        F.when(F.col("seq") % 5 == 0, "r9").otherwise(F.col("revision_id")).alias("target_revision_id"),
    )
    return findings.approve(reviews, commands).select("seq", "outcome", "approved_after")


_CELLS = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("p_brand", "p_name", "p_partkey", "p_size", "p_type"))
_SUMS = ", ".join(
    f"sum(CAST('0x' || substr(h[{s + 1}], {1 + digests.DIGITS * k}, {digests.DIGITS}) AS BIGINT))" for s in range(digests.SALTS) for k in range(digests.SLICES)
)


@query(
    f"""WITH h AS (SELECT p_brand, [{", ".join(f"sha256('{s}|' || t)" for s in range(digests.SALTS))}] AS h FROM (SELECT p_brand, {_CELLS} AS t FROM part)
), l AS (SELECT p_brand, count(*) AS rows, [{_SUMS}] AS lanes FROM h GROUP BY p_brand UNION ALL SELECT 'all' AS p_brand, count(*) AS rows, [{_SUMS}] AS lanes FROM h)
SELECT p_brand AS part, rows, sha256(rows || ',' || array_to_string(lanes, ',')) AS digest FROM l"""
)
def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiset digest of the parts of each brand, and of all parts as the union of these."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    brands = digests.lanes(parts, ["p_brand"])
    every = digests.merged(brands).select(F.lit("all").alias("p_brand"), "rows", "lanes")
    return brands.unionByName(every).select(F.col("p_brand").alias("part"), "rows", digests.digest().alias("digest"))


@query()
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the events of a document job: all its transitions. The rule is a state machine, beyond SQL."""
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.row_number().over(w) == 1, "started").when(F.col("event_type") == "error", "retryable")
    kind = kind.when(F.col("event_type") == "purchase", "retry").when(F.col("event_type") == "click", "busy").otherwise("done")
    log = e.select(F.col("user_id").cast("string").alias("job_id"), F.unix_timestamp("ts").alias("at"), (F.row_number().over(w) - 1).alias("seq"), kind.alias("event"), F.col("props").alias("error"))
    return jobs.fold(log)


_FINDINGS = """n AS (SELECT l_orderkey AS o, l_linenumber AS k, CAST(floor(min(l_quantity)) AS INTEGER) AS q FROM lineitem GROUP BY ALL
), d AS (SELECT CAST(o AS VARCHAR) AS doc_id, o, 'n' || k AS node_id, 'b' || k % 4 AS block_id, k % 4 AS page, CASE k % 3 WHEN 0 THEN 'Toler. +' || q || ' %' WHEN 1 THEN 'plain ' || q ELSE '+ and +' END AS text FROM n
), w AS (SELECT DISTINCT doc_id, o, position, code, blocks, pages FROM d, (VALUES (1, 'POSSIBLE_TOLERANCE_SYMBOL_AMBIGUITY', ['b3'], [3]), (2, 'POSSIBLE_TOLERANCE_SYMBOL_AMBIGUITY', ['b2', 'b1'], []),
    (3, 'POSSIBLE_TOLERANCE_SYMBOL_AMBIGUITY', ['b3'], [3]), (4, 'AWS_X', [], [2, 1])) v(position, code, blocks, pages)
), i AS (SELECT *, sha256(code || chr(10) || array_to_string(list_sort(blocks), ',') || chr(10) || coalesce(array_to_string(list_sort(pages), ','), '')) AS identity FROM w
), f AS (SELECT *, 'finding_' || substr(sha256(identity || chr(0) || (row_number() OVER (PARTITION BY doc_id, identity ORDER BY position) - 1)), 1, 32) AS finding_id FROM i
), m AS (SELECT f.doc_id, finding_id, list(DISTINCT node_id ORDER BY node_id) AS node_ids, string_agg(node_id || ':' || length(text) || ':' || text, ',' ORDER BY node_id) AS said,
    sum(length(text) - length(replace(text, '+', ''))) AS pluses, list({'n': node_id, 't': text} ORDER BY node_id) FILTER (length(text) - length(replace(text, '+', '')) = 1) AS one
  FROM f JOIN d ON d.doc_id = f.doc_id AND list_contains(blocks, block_id) GROUP BY ALL
), r AS (SELECT f.doc_id, f.finding_id, list(DISTINCT page ORDER BY page) AS raw FROM f JOIN d ON d.doc_id = f.doc_id AND list_contains(blocks, block_id) GROUP BY ALL
), a AS (SELECT f.doc_id, f.o, f.finding_id, position, code, list_sort(list_distinct(list_concat(pages, coalesce(raw, [])))) AS pages, blocks, node_ids, said, pluses, one FROM f
  LEFT JOIN m USING (doc_id, finding_id) LEFT JOIN r USING (doc_id, finding_id)
), z AS (SELECT *, sha256(coalesce(said, '') || '|' || array_to_string(list_sort(blocks), ',') || '|' || array_to_string(pages, ',')) AS region_hash,
  code LIKE 'POSSIBLE%' AND len(one) = 1 AND pluses = 1 AS clear FROM a)"""


@query(
    f"""WITH {_FINDINGS} SELECT doc_id, position, finding_id, region_hash, coalesce(array_to_string(node_ids, ','), '') AS node_ids, array_to_string(pages, ',') AS pages,
  CASE WHEN clear THEN replace(replace(one[1].t, 'Toler.', 'Tolerance'), '+', '±') END AS suggested_text,
  CASE WHEN o % 3 = 0 AND position = 1 THEN 'DISMISSED' END AS decision, o % 6 = 3 AND position = 1 AS resolved FROM z"""
)
def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of four warnings for each order's document, some decided before on the same or on other texts."""
    t = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.min("l_quantity")).cast("int").alias("q"))
    k, q = F.col("l_linenumber"), F.col("q").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("Toler. +"), q, F.lit(" %"))).when(k % 3 == 1, F.concat(F.lit("plain "), q)).otherwise("+ and +")
    nodes = t.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("n"), k).alias("node_id"), F.concat(F.lit("b"), k % 4).alias("block_id"), (k % 4).alias("page"), text.alias("text"))
    blocks = nodes.select("doc_id", F.col("block_id").alias("Id"), F.col("page").alias("Page")).distinct()
    one = lambda p, c, b, n: F.struct(F.lit(p).alias("position"), F.lit(c).alias("code"), F.array(*map(F.lit, b)).cast("array<string>").alias("block_ids"), F.array(*map(F.lit, n)).cast("array<int>").alias("pages"))
    tolerance = conversion.TOLERANCE
    some = F.array(one(1, tolerance, ["b3"], [3]), one(2, tolerance, ["b2", "b1"], []), one(3, tolerance, ["b3"], [3]), one(4, "AWS_X", [], [2, 1]))
    warnings = nodes.select("doc_id").distinct().select("doc_id", F.explode(some).alias("w")).select("doc_id", "w.*")
    order = F.col("doc_id").cast("long")
    named = conversion.named_findings(warnings)
    first = conversion.current_findings(named.filter((order % 3 == 0) & (F.col("position") == 1)), nodes, blocks)  # those that were decided
    before = first.select(
        "doc_id", "finding_id", F.when(order % 6 == 3, F.col("region_hash")).otherwise("other").alias("region_hash"), F.lit("DISMISSED").alias("decision")
    )
    out = conversion.carry_decisions(conversion.current_findings(named, nodes, blocks), before)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("doc_id", "position", "finding_id", "region_hash", joined("node_ids").alias("node_ids"), joined("pages").alias("pages"), "suggested_text", "decision", "resolved")
