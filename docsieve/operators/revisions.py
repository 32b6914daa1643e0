"""Revisions of document trees: digests folded from the leaves up, edit logs replayed without touching what is unchanged.

A node's digest covers its kind, its text and its children's digests in order, so equal digests mean equal subtrees and
a page's or document's digest is its root's. A replay gives each node a version for each generation that changed
something in its subtree and no other: at each level the changed children of a parent meet its other children as they
were at that generation, by the span of generations in which a version holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .review import invalidated_approvals
from .trees import fold_up


def node_digest(kind: Column, text: Column, children: Column) -> Column:
    """The hex digest of a node; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    said = F.concat(F.coalesce(kind, F.lit("")), F.lit("\n"), F.length(text).cast("string"), F.lit(":"), text, F.lit("\n"), F.array_join(children, ","))
    return F.sha2(said, 256)


def tree_digests(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """``nodes`` (as ``trees.with_paths`` gives them, with kind and text) with the digest of each node's subtree."""
    return fold_up(nodes, tree, node_digest(F.col("kind"), F.col("text"), F.col("children")), "digest")


def effective_edits(nodes: DataFrame, edits: DataFrame, tree: list[str]) -> DataFrame:
    """Edits (tree, generation, id, text) of known nodes that change the node's text as it was, with text_before.

    Of several edits of a node in one generation the greatest text counts.
    """
    keys = [*tree, "id"]
    one = edits.groupBy(*keys, "generation").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    base = nodes.select(*keys, F.coalesce("text", F.lit("")).alias("_base"))
    before = F.coalesce(F.lag("text").over(Window.partitionBy(*keys).orderBy("generation")), F.col("_base"))
    out = one.join(base, keys).withColumn("text_before", before)
    return out.filter(F.col("text") != F.col("text_before")).select(*keys, "generation", "text_before", "text")


def replay(nodes: DataFrame, edits: DataFrame, tree: list[str], base: int = 0) -> DataFrame:
    """(tree, id, parent, depth, generation, digest): every node at generation ``base``, and at each that changed it.

    ``nodes`` is as ``trees.with_paths`` gives them; ``edits`` has tree, generation (over ``base``), id and text.
    """
    keys = [*tree, "id"]
    changed = stage(effective_edits(nodes, edits, tree), "edits")
    depths = sorted((r[0] for r in nodes.select("depth").distinct().collect()), reverse=True)
    out, below = [], None
    for depth in depths:
        level = nodes.filter(F.col("depth") == depth).select(*keys, "parent", "place", "depth", "kind", "text")
        own = level.select(*keys, F.lit(base).cast("long").alias("generation"), F.coalesce("text", F.lit("")).alias("own")).unionByName(
            changed.join(level.select(*keys), keys, "left_semi").select(*keys, F.col("generation").cast("long").alias("generation"), F.col("text").alias("own"))
        )
        if below is None:
            points = own.withColumn("children", F.array().cast("array<string>"))
        else:
            at = own.select(*keys, "generation").unionByName(below.select(*tree, F.col("parent").alias("id"), "generation").join(level.select(*keys), keys, "left_semi")).distinct()
            holds = Window.partitionBy(*tree, "id").orderBy("generation")
            kids = below.select(*tree, "parent", "id", "place", F.col("generation").alias("since"), F.lead("generation").over(holds).alias("until"), "digest")
            kids = kids.select(*tree, F.col("parent").alias("id"), F.col("id").alias("child"), "place", "since", "until", "digest")
            met = at.join(kids, keys).filter((F.col("generation") >= F.col("since")) & (F.col("until").isNull() | (F.col("generation") < F.col("until"))))
            given = met.groupBy(*keys, "generation").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("place", "child", "digest"))), lambda x: x["digest"]).alias("children")
            )
            upto = Window.partitionBy(*keys).orderBy("generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            points = at.join(own, [*keys, "generation"], "left").withColumn("own", F.last("own", True).over(upto)).join(given, [*keys, "generation"], "left")
            points = points.withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
        versions = points.join(level.drop("text"), keys).withColumn("digest", node_digest(F.col("kind"), F.col("own"), F.col("children")))
        below = stage(versions.select(*keys, "parent", "place", "depth", "generation", "digest"), "versions")
        out.append(below)
    if not out:
        return nodes.select(*keys, "parent", "place", "depth", F.lit(base).cast("long").alias("generation"), F.lit(None).cast("string").alias("digest"))
    return reduce(DataFrame.unionByName, out)


def as_of(versions: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, generation) with the digest of the version that holds there."""
    holds = Window.partitionBy(*keys).orderBy("generation")
    spans = versions.select(*keys, F.col("generation").alias("_since"), F.lead("generation").over(holds).alias("_until"), "digest")
    met = points.join(spans, keys).filter((F.col("generation") >= F.col("_since")) & (F.col("_until").isNull() | (F.col("generation") < F.col("_until"))))
    return met.drop("_since", "_until")


def chain_error(revisions: DataFrame) -> DataFrame:
    """job_id and error_code (null: whole) of each job's revisions (job_id, revision_id, parent_revision_id, generation).

    A whole chain has generations from 1 without gaps or repeats, distinct ids, no parent at first, and each other
    revision's parent the one before it.
    """
    w = Window.partitionBy("job_id").orderBy("generation", "revision_id")
    rows = revisions.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag("revision_id").over(w))
    bad = (F.col("_n") != F.col("generation")) | ~F.col("parent_revision_id").eqNullSafe(F.col("_before")) | F.col("revision_id").isNull()
    out = rows.groupBy("job_id").agg(F.max(F.coalesce(bad, F.lit(True))).alias("bad"), (F.count_distinct("revision_id") < F.count("*")).alias("repeated"))
    return out.select("job_id", F.when(F.col("bad") | F.col("repeated"), "INVALID_REVIEW_STATE").alias("error_code"))


def committed_history(revisions: DataFrame, nodes: DataFrame, edits: DataFrame, approvals: DataFrame) -> DataFrame:
    """One record for each revision of jobs whose chain is whole, one row with error_code for each other job.

    ``revisions`` has job_id, revision_id, parent_revision_id and generation (from 1, the document as it came);
    ``nodes`` the first document's tree by job_id (as ``with_paths`` gives it, one root), ``edits`` job_id, generation,
    id, text; ``approvals`` job_id, generation, page_number, approved. A record has the number of effective changes, the
    pages whose approval it took back, and the digest of the document as it was committed.
    """
    state = stage(chain_error(revisions), "chains")
    broken = state.filter("error_code is not null")
    whole = revisions.join(state.filter("error_code is null").select("job_id"), "job_id", "left_semi")
    changes = effective_edits(nodes, edits, ["job_id"]).groupBy("job_id", "generation").agg(F.count("*").alias("changes"))
    lost = invalidated_approvals(approvals).groupBy("job_id", "generation").agg(F.sort_array(F.collect_set("page_number")).alias("invalidated"))
    roots = replay(nodes, edits, ["job_id"], 1).filter("depth = 0").select("job_id", "generation", "digest")
    held = as_of(roots, whole.select("job_id", "generation"), ["job_id"])
    out = whole.join(changes, ["job_id", "generation"], "left").join(lost, ["job_id", "generation"], "left").join(held, ["job_id", "generation"], "left")
    nothing = F.array().cast(dict(lost.dtypes)["invalidated"])
    out = out.select(
        "job_id", "generation", "revision_id", "parent_revision_id", F.coalesce("changes", F.lit(0)).alias("changes"),
        F.coalesce("invalidated", nothing).alias("invalidated"), "digest", F.lit(None).cast("string").alias("error_code"),
    )
    return out.unionByName(broken, allowMissingColumns=True)
