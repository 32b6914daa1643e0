"""Conversation prefix trie by prefix doubling.

Turns are named densely by role and text. Two neighbouring blocks of 2^k turns make a block of 2^(k+1), named densely
by its pair of names, so all aligned blocks have names after a logarithmic number of joins. A prefix of d turns is its
blocks by the binary digits of d, the largest first: it is named by the pair of the prefix without its last block and
that block. As every even block ends exactly one prefix, each level names its prefixes by one more join, from the
largest blocks down. Equal prefixes then have equal names, and nodes are groups of them.

Sums over subtrees double as well: after round k a node holds the sums of its descendants fewer than 2^k levels below,
and knows its ancestor 2^k levels above, to which it gives them. Places in a conversation come from a range-sorted
table, not from a window, so one conversation may hold any share of the rows.

Defined results: rows are ordered by turn (nulls first), then role, then text; null role and text are empty; repeated
rows are turns of their own; rows without conv_id take no part; an empty table has no nodes; extra columns are
ignored. Turns are told apart by SHA-256 of role and text, so texts of any length are moved once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .naming import dense_index, dense_names

WORD = r"[^\x20\x09-\x0D]+"
#: Ids that are joined into one text before they meet a node's other ids.
CHUNK = 1 << 16
ROOT = 0


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn name, words of each turn."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", empty("role"), empty("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.select("conv_id", F.unhex(F.sha2(said, 256)).alias("said"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    placed, _ = dense_index(rows, "at")
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    placed = placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "said", "words")
    return stage(dense_names(placed, ["said"], "name")[0], "turns")


def rebuilt_turns(placed: DataFrame, family: Column, shared: Column, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``shared`` turns are those of conversation ``family``: (conv_id, length), turns.

    ``family`` and ``shared`` (at most ``most_shared``) are columns of conv_id. Turns of a conversation after its own
    first ``shared`` follow those that the family has.
    """
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", family.alias("family"), shared.alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("family"), F.col("n").alias("there")), "family", "left")
    taken = F.least(F.col("h"), F.coalesce("there", F.lit(0)))
    convs = convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stage(convs, "convs")
    heads = placed.filter(F.col("pos") < most_shared).withColumnRenamed("conv_id", "family")
    heads = convs.select("conv_id", "family", "taken").join(heads, "family").filter(F.col("pos") < F.col("taken"))
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").filter(F.col("pos") >= F.col("h"))
    own = own.withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    columns = ["conv_id", "pos", "name", "words"]
    return convs.select("conv_id", "length"), stage(heads.select(*columns).unionByName(own.select(*columns)), "rebuilt")


def block_levels(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each k the named blocks of 2^k turns: conv_id, i (from 0, in blocks), name."""
    levels = [turns.select("conv_id", F.col("pos").alias("i"), "name")]
    while 2 ** len(levels) <= longest:
        odd = F.col("i") % 2 == 1
        pairs = levels[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b")
        )
        pairs = pairs.filter(F.col("b").isNotNull())
        levels.append(stage(dense_names(pairs, ["a", "b"], "name")[0], "blocks"))
    return levels


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """conv_id, depth, node for each prefix of one turn or more; nodes from 1, equal for equal prefixes alone."""
    found, free = None, ROOT + 1
    for k in range(len(levels) - 1, -1, -1):
        last = levels[k].filter(F.col("i") % 2 == 0)
        depth = F.shiftleft(F.col("i") + 1, k).cast("long").alias("depth")
        rows = last.filter(F.col("i") == 0).select("conv_id", depth, F.lit(ROOT).cast("long").alias("before"), "name")
        if found is not None:
            before = found.select("conv_id", F.col("depth").alias("shorter"), F.col("node").alias("before"))
            longer = last.filter(F.col("i") > 0).select("conv_id", depth, F.shiftleft("i", k).cast("long").alias("shorter"), "name")
            rows = rows.unionByName(longer.join(before, ["conv_id", "shorter"]).select("conv_id", "depth", "before", "name"))
        named, free = dense_names(rows, ["before", "name"], "node", free)
        named = stage(named.select("conv_id", "depth", "node"), "prefixes")
        found = named if found is None else found.unionByName(named)
    return found


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids as texts, from rows sorted by node and id."""
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            some = b.slice(at, CHUNK)
            node, conv = some.column("node").to_numpy(), some.column("conv_id")
            cuts = np.flatnonzero(np.diff(node, prepend=node[:1] - 1))
            texts = pc.cast(conv, pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(node)), pa.int32()), texts)
            yield pa.record_batch([pa.array(node[cuts]), conv.take(pa.array(cuts)), pc.binary_join(lists, ",")], names=["node", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, from rows sorted by node and first id; one digest is open at a time."""
    node, digest = None, None
    for b in batches:
        out = []
        for k, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of rows node, conv_id: the hex SHA-256 of each node's ids in ascending order, comma-joined."""
    ends = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = ends.mapInArrow(_joined_ids, "node long, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """node and, for each column of ``sums``, its sum over the node's subtree, itself included."""
    table = nodes.select("node", F.col("parent").alias("up"), *sums)
    reach = 1
    while reach <= deepest:
        below = table.filter(F.col("up").isNotNull())
        given = below.groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"{c}_below") for c in sums))
        higher = table.select(F.col("node").alias("up"), F.col("up").alias("next"))
        table = table.join(given, "node", "left").join(higher, "up", "left").select(
            "node", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums)
        )
        table = stage(table, "sums")
        reach *= 2
    return table.drop("up")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    longest = convs.agg(F.max("length")).first()[0] or 0
    found = prefixes(block_levels(turns, longest))
    nodes = found.groupBy("node", "depth").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    above = found.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    said = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    nodes = nodes.join(above, ["conv_id", "depth"], "left").join(said, ["conv_id", "depth"])
    nodes = nodes.withColumn("parent", F.coalesce("parent", F.lit(ROOT).cast("long")))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter(F.col("n_convs") > 0).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("node"), "n_convs",
        F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("words"),
    )
    nodes = nodes.unionByName(root)
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
    nodes = nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = stage(nodes, "nodes")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"], longest)
    last = convs.filter(F.col("length") > 0).withColumnRenamed("length", "depth").join(found, ["conv_id", "depth"]).select("node", "conv_id")
    last = last.unionByName(convs.filter(F.col("length") == 0).select(F.lit(ROOT).cast("long").alias("node"), "conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens", "words").join(sums, "node").join(end_digests(last), "node", "left")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return out.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
