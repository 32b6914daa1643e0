"""Registered queries of document revisions: digests of every version of every page, and committed histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import revisions, trees
from ..session import read_table, stage
from .queries import query

#: Turns of a page.
PAGE_TURNS = 3


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    one = t.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    return one.select(F.col("conv_id").alias("job_id"), F.col("turn").cast("int").alias("turn"), "said.*")


def conversation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document tree for each conversation: its root, a page for each three turns, a node for each turn."""
    turns = _turns(spark, sf_dir)
    page = F.concat(F.lit("p"), F.floor(F.col("turn") / PAGE_TURNS).cast("string"))
    none = F.lit(None).cast("string")
    nodes = turns.select("job_id", F.concat(F.lit("t"), "turn").alias("id"), page.alias("parent"), F.col("turn").alias("place"), F.col("role").alias("kind"), "text")
    pages = turns.select("job_id", page.alias("id"), F.lit("d").alias("parent"), F.floor(F.col("turn") / PAGE_TURNS).cast("int").alias("place"), F.lit("page").alias("kind"), none.alias("text"))
    roots = turns.select("job_id", F.lit("d").alias("id"), none.alias("parent"), F.lit(0).alias("place"), F.lit("document").alias("kind"), none.alias("text"))
    return trees.with_paths(stage(nodes.unionByName(pages.distinct()).unionByName(roots.distinct()), "nodes"), ["job_id"])


def conversation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of generations 2 and 3: some change a text, some give it again, some take a change back."""
    t = _turns(spark, sf_dir).filter("turn < 2")
    text = F.coalesce("text", F.lit(""))
    second = F.struct(F.lit(2).alias("generation"), F.concat(F.lit("* "), text).alias("text"))
    third = F.when(F.col("turn") == 1, F.struct(F.lit(3).alias("generation"), F.when(F.col("job_id") % 2 == 0, text).otherwise(F.concat(text, F.lit("!"))).alias("text")))
    third = third.when(F.col("job_id") % 3 == 0, F.struct(F.lit(3).alias("generation"), text.alias("text")))
    some = F.array_compact(F.array(F.when(F.col("turn") == 0, second), third))
    return t.select("job_id", F.concat(F.lit("t"), "turn").alias("id"), F.explode(some).alias("e")).select("job_id", "id", "e.*")


_STATES = """t AS (SELECT conv_id AS job_id, turn, min(role) AS role, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), s AS (SELECT job_id, turn, role, generation, CASE WHEN turn = 0 AND (generation = 2 OR generation = 3 AND job_id % 3 <> 0) THEN '* ' || coalesce(text, '')
    WHEN turn = 1 AND generation = 3 AND job_id % 2 <> 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS text
  FROM t, (VALUES (1), (2), (3)) v(generation)
), n AS (SELECT job_id, generation, turn, sha256(coalesce(role, '') || chr(10) || length(text) || ':' || text || chr(10)) AS digest FROM s
), p AS (SELECT job_id, generation, turn // 3 AS page, sha256('page' || chr(10) || '0:' || chr(10) || string_agg(digest, ',' ORDER BY turn)) AS digest FROM n GROUP BY ALL
), d AS (SELECT job_id, generation, sha256('document' || chr(10) || '0:' || chr(10) || string_agg(digest, ',' ORDER BY page)) AS digest FROM p GROUP BY ALL
), v AS (SELECT job_id, 'p' || page AS id, generation, digest FROM p UNION ALL SELECT job_id, 'd', generation, digest FROM d
), c AS (SELECT *, lag(digest) OVER (PARTITION BY job_id, id ORDER BY generation) AS before FROM v)"""


@query(f"WITH {_STATES} SELECT job_id, id, CAST(generation AS BIGINT) AS generation, digest FROM c WHERE before IS NULL OR before <> digest")
def revision_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every page and document at first and at each generation that changed it."""
    found = revisions.replay(conversation_tree(spark, sf_dir), conversation_edits(spark, sf_dir), ["job_id"], 1)
    return found.filter("depth < 2").select("job_id", "id", "generation", "digest")


@query(f"""WITH {_STATES}, r AS (SELECT job_id, generation FROM (SELECT DISTINCT job_id FROM t), (VALUES (1), (2), (3)) v(generation)
), a AS (SELECT job_id, generation, page, (job_id + page + generation) % 2 = 0 AND (job_id + page + generation) % 5 <> 0 AS approved
  FROM (SELECT DISTINCT job_id, turn // 3 AS page FROM t), (VALUES (1), (2), (3)) v(generation)
), i AS (SELECT b.job_id, b.generation, list(CAST(b.page AS INTEGER) ORDER BY b.page) AS pages FROM a JOIN a AS b ON a.job_id = b.job_id AND a.page = b.page AND a.generation + 1 = b.generation
  WHERE a.approved AND NOT b.approved GROUP BY ALL
), h AS (SELECT job_id, generation, count(*) AS changes FROM (SELECT *, lag(text) OVER (PARTITION BY job_id, turn ORDER BY generation) AS was FROM s) WHERE was <> text GROUP BY ALL)
SELECT r.job_id, CAST(r.generation AS BIGINT) AS generation, r.job_id || ':' || r.generation AS revision_id, CASE WHEN r.generation > 1 THEN r.job_id || ':' || (r.generation - 1) END AS parent_revision_id,
  coalesce(changes, 0) AS changes, coalesce(array_to_string(pages, ','), '') AS invalidated, digest, NULL AS error_code
FROM r LEFT JOIN h USING (job_id, generation) LEFT JOIN i USING (job_id, generation) JOIN d USING (job_id, generation) WHERE r.job_id % 7 <> 3
UNION ALL SELECT DISTINCT job_id, NULL, NULL, NULL, NULL, NULL, NULL, 'INVALID_REVIEW_STATE' FROM t WHERE job_id % 7 = 3""")
def committed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three revisions of every conversation: effective changes, approvals taken back, digests; broken chains say so."""
    jobs = _turns(spark, sf_dir).select("job_id").distinct()
    generation = F.explode(F.array(*(F.lit(g).cast("long") for g in (1, 2, 3)))).alias("generation")
    name = lambda g: F.concat(F.col("job_id").cast("string"), F.lit(":"), g.cast("string"))
    g = F.col("generation")
    chain = jobs.select("job_id", generation).select(
        "job_id", name(g).alias("revision_id"), F.when((g > 1) & ~((g == 2) & (F.col("job_id") % 7 == 3)), name(g - 1)).alias("parent_revision_id"), "generation"
    )
    pages = _turns(spark, sf_dir).select("job_id", F.floor(F.col("turn") / PAGE_TURNS).cast("int").alias("page_number")).distinct().select("*", generation)
    k = F.col("job_id") + F.col("page_number") + g
    approvals = pages.filter(k % 5 != 0).withColumn("approved", k % 2 == 0)
    marks = chain.select("job_id", "generation", F.lit(-1).alias("page_number"), F.lit(False).alias("approved"))  # every revision has a page of its own
    out = revisions.committed_history(chain, conversation_tree(spark, sf_dir), conversation_edits(spark, sf_dir), approvals.unionByName(marks))
    return out.withColumn("invalidated", F.array_join(F.transform("invalidated", lambda x: x.cast("string")), ","))
