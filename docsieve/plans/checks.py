"""Registered queries of jobs' leases and slots, publication checks, review history and classification exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classification, publication
from ..session import read_table, stage_path
from ..sources import history
from ..streaming import leases
from .queries import _calls, query


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each order."""
    t = read_table(spark, sf_dir, "orders")
    phase = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("OCR")
    return t.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), "o_orderkey").alias("filename"), F.col("o_custkey").alias("owner"), phase.alias("phase"),
        (F.col("o_custkey") % 9).cast("int").alias("pages_available"), F.nullif(F.col("o_custkey") % 4, F.lit(0)).cast("int").alias("warning_count"),
        F.when(phase == "FAILED", F.col("o_orderpriority")).alias("error_code"),
        F.create_map(F.lit("z.html"), F.lit("1"), F.col("o_orderpriority"), F.lit("2")).alias("artifacts"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("h")).alias("handle"), (F.col("o_custkey") % 5 == 0).alias("unknown_submission"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).alias("slot"), (F.col("o_orderkey") % 7 == 0).alias("ocr_finished"),
    )


@query(
    """SELECT o_orderkey AS id, 'f' || o_orderkey AS filename, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' ELSE 'FAILED' END AS phase,
  CAST(o_custkey % 9 AS INTEGER) AS pages_available, CAST(o_custkey % 4 AS INTEGER) AS warning_count,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS error_code, o_orderpriority || ',z.html' AS artifacts FROM orders
WHERE o_orderstatus IN ('F', 'P')"""
)
def settled_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public status of jobs that reached an end."""
    out = leases.job_status(leases.settled(_jobs(spark, sf_dir)))
    return out.withColumn("artifacts", F.array_join("artifacts", ","))


@query(
    """SELECT o_orderkey AS id, (o_orderkey % 7 = 0) OR (o_orderstatus = 'P' AND o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_orderkey % 2 = 0) AS releasable,
  c_name AS owner FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def slot_release_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs' slots are free again, with their owners."""
    owners = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), "c_name")
    return _jobs(spark, sf_dir).join(owners, "owner").select("id", leases.slot_releasable().alias("releasable"), F.col("c_name").alias("owner"))


@query(
    """WITH held AS (SELECT CAST(n_nationkey * 2 AS INTEGER) AS slot, CAST(n_nationkey AS BIGINT) AS job_id FROM nation),
asked AS (SELECT user_id AS job_id, min(event_id) AS asked FROM events GROUP BY user_id),
free AS (SELECT CAST(range AS INTEGER) AS slot, row_number() OVER (ORDER BY range) AS n FROM range(200) WHERE range NOT IN (SELECT slot FROM held)),
wait AS (SELECT job_id, asked, row_number() OVER (ORDER BY asked, job_id) AS n FROM asked WHERE job_id NOT IN (SELECT job_id FROM held))
SELECT slot, job_id, 'g' || asked AS generation FROM asked JOIN held USING (job_id)
UNION ALL SELECT slot, job_id, 'g' || asked AS generation FROM wait JOIN free USING (n)"""
)
def slot_acquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 slots, some held, asked for by all users: holders keep theirs, the first others get the free ones."""
    held = read_table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") * 2).cast("int").alias("slot"), F.col("n_nationkey").cast("long").alias("job_id"), F.lit("old").alias("generation")
    )
    events = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("asked"))
    return leases.acquire_slots(held, events.withColumn("generation", F.concat(F.lit("g"), "asked")), 200)


@query(
    """WITH l AS (SELECT c_custkey AS job_id, 't' || c_nationkey AS lease, CAST(floor(c_acctbal) AS BIGINT) AS until FROM customer),
r AS (SELECT o_custkey AS job_id, min(('t' || o_orderpriority, CAST(floor(o_totalprice) AS BIGINT))) AS x FROM orders GROUP BY o_custkey),
c AS (SELECT coalesce(l.job_id, r.job_id) AS job_id, x IS NOT NULL AND (lease IS NULL OR until <= 3000) AS claimed, lease, until, x FROM l FULL JOIN r ON l.job_id = r.job_id)
SELECT job_id, CASE WHEN claimed THEN x[1] ELSE lease END AS lease, CASE WHEN claimed THEN x[2] ELSE until END AS until, claimed FROM c"""
)
def lease_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of leases: free and expired ones go to the first request."""
    held = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"), F.concat(F.lit("t"), "c_nationkey").alias("lease"), F.floor("c_acctbal").alias("until")
    )
    asks = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), F.concat(F.lit("t"), "o_orderpriority").alias("lease"), F.floor("o_totalprice").alias("until")
    )
    return leases.claim(held, asks, F.lit(3000))


@query(
    """WITH l AS (SELECT c_custkey AS job_id, 't' || c_nationkey AS lease, CAST(floor(c_acctbal) AS BIGINT) AS until FROM customer),
b AS (SELECT user_id AS job_id, 't' || event_id % 25 AS lease, max(event_id) AS later FROM events GROUP BY ALL)
SELECT job_id, lease, coalesce(later, until) AS until, later IS NOT NULL AS renewed FROM l LEFT JOIN b USING (job_id, lease)"""
)
def lease_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases renewed by beats that carry their token."""
    held = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"), F.concat(F.lit("t"), "c_nationkey").alias("lease"), F.floor("c_acctbal").alias("until")
    )
    beats = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("t"), F.col("event_id") % 25).alias("lease"), F.col("event_id").alias("until")
    )
    return leases.heartbeat(held, beats)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed")
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("component"), outcome.alias("outcome"))


@query(
    """WITH o AS (SELECT l_orderkey AS run, count(*) FILTER (l_returnflag <> 'R') AS done, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT run, CASE WHEN done = n THEN 'completed' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS overall, done > 0 AS usable FROM o),
c AS (SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'partial' ELSE 'failed' END AS claimed FROM orders)
SELECT c.run, claimed, r.overall AS of_components, usable FROM c LEFT JOIN r USING (run) WHERE claimed IS DISTINCT FROM r.overall"""
)
def disagreeing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose claimed outcome is not that of their components."""
    out = _outcomes(spark, sf_dir)
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed")
    claims = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), status.alias("overall"))
    wrong = publication.disagreeing_runs(claims, out, ["run"])
    usable = publication.overall_outcome(out, ["run"]).select("run", "usable")
    return wrong.join(usable, "run", "left").select("run", F.col("overall").alias("claimed"), "of_components", "usable")


@query(
    """WITH p AS (SELECT DISTINCT p_name AS component FROM part), c AS (SELECT c_mktsegment AS component, count(*) AS n FROM customer GROUP BY 1
  UNION ALL SELECT p_name, count(*) FROM part WHERE p_size < 3 GROUP BY 1)
SELECT coalesce(p.component, c.component) AS component, CASE WHEN n IS NULL THEN 'OUTCOME_MISSING' WHEN p.component IS NULL THEN 'OUTCOME_UNEXPECTED' ELSE 'OUTCOME_REPEATED' END AS code
FROM p FULL JOIN c ON p.component = c.component WHERE n IS NULL OR p.component IS NULL OR n > 1"""
)
def uncovered_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned components without one outcome, and outcomes that no plan has."""
    parts = read_table(spark, sf_dir, "part")
    done = read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("component"))
    done = done.unionByName(parts.filter("p_size < 3").select(F.col("p_name").alias("component")))
    return publication.uncovered_components(parts.select(F.col("p_name").alias("component")), done)


@query(
    """WITH c AS (SELECT doc_id, coalesce(text, '') AS t, CAST(doc_id % 40 AS INTEGER) AS a FROM documents),
s AS (SELECT doc_id, t, a, CAST(a + 1 + doc_id % 9 AS INTEGER) AS e, CASE WHEN doc_id % 3 = 0 THEN upper(substr(t, a + 1, 1 + doc_id % 9)) ELSE substr(t, a + 1, 1 + doc_id % 9) END AS m FROM c)
SELECT doc_id, a AS start, e AS "end", e <= length(t) AND length(m) = e - a AND substr(t, a + 1, e - a) = m AS holds FROM s"""
)
def span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans tested against the texts that they were read from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 40).cast("int").alias("start"))
    docs = docs.withColumn("end", (F.col("start") + 1 + F.col("doc_id") % 9).cast("int"))
    cut = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    docs = docs.withColumn("matched", F.when(F.col("doc_id") % 3 == 0, F.upper(cut)).otherwise(cut))
    return docs.select("doc_id", "start", "end", publication.offsets_match(*(F.col(c) for c in ("text", "start", "end", "matched"))).alias("holds"))


@query(
    """WITH w AS (SELECT a.p_name AS dictionary_term, b.p_name AS matched_text FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b
  WHERE abs(length(a.p_name) - length(b.p_name)) <= 1)
SELECT dictionary_term, matched_text, levenshtein(dictionary_term, matched_text) > 1 AS refused FROM w WHERE levenshtein(dictionary_term, matched_text) <> 1"""
)
def wrong_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that two part names of like length are one edit apart, counted anew."""
    names = read_table(spark, sf_dir, "part").select("p_name").distinct()
    one = names.select(F.col("p_name").alias("dictionary_term"), F.explode(F.array(*(F.length("p_name") + k for k in (-1, 0, 1)))).alias("n"))
    two = names.select(F.col("p_name").alias("matched_text"), F.length("p_name").alias("n"))
    claims = one.join(two, "n").select("dictionary_term", "matched_text", F.lit(1).alias("edit_distance"))
    out = publication.wrong_distances(claims)
    return out.select("dictionary_term", "matched_text", (F.col("true_distance") == -1).alias("refused"))


@query(
    """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS job_id, CAST(o_orderkey AS VARCHAR) AS revision_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS generation,
  o_orderpriority AS actor FROM orders), w AS (SELECT *, lag(revision_id) OVER (PARTITION BY job_id ORDER BY generation) AS parent_revision_id,
  count(*) OVER (PARTITION BY job_id) AS n FROM r)
SELECT job_id, revision_id, parent_revision_id, generation, actor, CASE n % 2 WHEN 0 THEN 'CURRENT' ELSE 'STALE' END AS state FROM w"""
)
def history_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history for each customer whose revisions are their orders, written as JSON lines, read back and compared to heads."""
    from pyspark.sql import Window

    orders = read_table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    records = orders.select(
        F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderkey").cast("string").alias("revision_id"),
        F.lag("o_orderkey").over(w).cast("string").alias("parent_revision_id"), F.row_number().over(w).cast("long").alias("generation"),
        F.col("o_orderpriority").alias("actor"),
    )
    path = stage_path(spark, "history")
    history.write_histories(records, path)
    state, body = history.read_histories(spark, path, "revision_id string, parent_revision_id string, generation long, actor string")
    heads = records.groupBy("job_id").agg(F.max_by("revision_id", "generation").alias("revision_id"), F.max("generation").alias("generation"))
    heads = heads.withColumn("generation", F.col("generation") + F.col("generation") % 2)
    return body.join(history.history_states(state, heads), "job_id")


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS revision_id, l_linenumber AS page_number FROM lineitem WHERE l_quantity < 40),
a AS (SELECT l_orderkey AS revision_id, l_linenumber AS page_number, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT coalesce(p.revision_id, a.revision_id) AS revision_id, coalesce(p.page_number, a.page_number) AS page_number,
  CASE WHEN n IS NULL THEN 'PAGE_MISSING' WHEN p.revision_id IS NULL THEN 'PAGE_UNKNOWN' ELSE 'PAGE_REPEATED' END AS code
FROM p FULL JOIN a ON p.revision_id = a.revision_id AND p.page_number = a.page_number WHERE n IS NULL OR p.revision_id IS NULL OR n > 1"""
)
def unequal_page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without one approval state, and states of other pages."""
    lines = read_table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("page_number")]
    return history.unequal_page_sets(lines.filter("l_quantity < 40").select(*keys), lines.filter("l_returnflag <> 'N'").select(*keys))


@query(
    """WITH c AS (SELECT doc_id, call_id, doc_id * 7 + call_id * 3 AS k FROM documents, (VALUES (1), (2), (3)) v(call_id))
SELECT doc_id, call_id, CASE WHEN (doc_id + call_id) % 6 = 0 THEN 'missing' WHEN k % 17 = 0 THEN 'failed' ELSE 'valid' END AS availability,
  CASE WHEN (doc_id + call_id) % 6 = 0 THEN 'classifier call response was not supplied' END AS failure_reason FROM c"""
)
def missing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls for every page, those that gave no outcome marked."""
    calls = _calls(spark, sf_dir).filter((F.col("doc_id") + F.col("call_id")) % 6 != 0)
    pages = read_table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"))
    return classification.with_missing_calls(pages, calls).select("doc_id", "call_id", "availability", "failure_reason")


@query(
    """WITH c AS (SELECT doc_id, call_id, doc_id * 7 + call_id * 3 AS k FROM documents, (VALUES (1), (2), (3)) v(call_id)),
o AS (SELECT *, k % 17 <> 0 AS ok, CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN k % 11 = 0 THEN 'needs_review' WHEN k % 13 = 0 THEN 'empty' ELSE 'ok' END AS status FROM c),
p AS (SELECT doc_id, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND status = 'needs_review') AS review, count(*) FILTER (ok AND status = 'empty') AS empty,
  count(*) FILTER (ok AND status = 'ok') AS fine, count(*) FILTER (ok AND status = 'ok' AND doc_id % 3 <> 0) AS labels,
  string_agg(CASE WHEN k % 4 = 0 THEN 'MATERIALS' ELSE 'COVER_PAGE' END, '; ' ORDER BY call_id) FILTER (ok AND status = 'ok' AND doc_id % 3 <> 0) AS names FROM o GROUP BY doc_id),
m AS (SELECT *, CASE WHEN valid < 3 THEN 'incomplete' WHEN review > 0 THEN 'needs_review' WHEN empty = 3 THEN 'empty' WHEN empty > 0 AND fine > 0 THEN 'needs_review'
  WHEN labels = 0 THEN 'needs_review' ELSE 'completed' END AS kind FROM p),
x AS (SELECT doc_id, CASE WHEN kind = 'empty' THEN NULL WHEN valid = 3 AND fine = 3 AND labels = 0 THEN 'OTHER_UNCLASSIFIED' ELSE names END AS named,
  CASE kind WHEN 'incomplete' THEN '[incomplete; provisional]' WHEN 'needs_review' THEN '[needs_review]' WHEN 'empty' THEN '[empty]' END AS marked FROM m)
SELECT doc_id, 'Page number' || chr(9) || 'Page classification' || chr(10) || '1' || chr(9) || concat_ws(' ', named, marked) || chr(10)
  || '2' || chr(9) || '[no completed classification result]' || chr(10) AS tsv FROM x"""
)
def classification_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's classifications as a TSV; a second page has no result."""
    pages = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_number"))
    decided = classification.classify(pages.filter("page_number = 1"), _calls(spark, sf_dir))
    return classification.classification_tsv(pages, decided)
