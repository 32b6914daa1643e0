"""Ordered merge of block streams: blocks, parameter names and units of the same blocks, read side by side.

The streams are laid together and grouped once by document and place, in a sort by these keys; the records of one block
meet there. A stream that leaves a block out, repeats one, has one that is not there, or disagrees on its node or text,
is an error of its document: nothing of such a document is given as if it were whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import value_expressions
from ..session import stage

SPAN = "struct<start:int,end:int,matched_text:string,name:string>"
STREAMS = ["blocks", "parameters", "units"]
MERGED = f"doc_id string, block_order int, node_id string, text string, parameters array<{SPAN}>, units array<{SPAN}>, error_code string"
MISMATCH = "BLOCK_IDENTITY_MISMATCH"


def merge_streams(blocks: DataFrame, parameters: DataFrame | None, units: DataFrame | None) -> DataFrame:
    """Blocks with the spans of both streams; MERGED.

    ``blocks`` has doc_id, block_order, node_id and text; a stream has these and ``spans``, an array of SPAN, for every
    block, also for those in which it found nothing. A stream that was not asked for is None. Documents with a mismatch
    have one row, with their error_code and the place of the first. Texts of the streams are compared by their digests.
    """
    given = [x for x in (parameters, units) if x is not None]
    kinds = [0, *(k for k, x in ((1, parameters), (2, units)) if x is not None)]
    none = F.lit(None).cast(f"array<{SPAN}>").alias("spans")
    rows = []
    for k, table in zip(kinds, [blocks, *given], strict=True):
        spans = F.col("spans").cast(f"array<{SPAN}>").alias("spans") if k else none
        text = F.col("text") if k == 0 else F.lit(None).cast("string").alias("text")
        rows.append(table.select(F.col("doc_id").cast("string").alias("doc_id"), "block_order", F.lit(k).alias("stream"), "node_id", text, F.sha2(F.coalesce("text", F.lit("")), 256).alias("said"), spans))
    key = ["doc_id", "block_order"]
    of = lambda k, c: F.max(F.when(F.col("stream") == k, F.col(c)))
    spans = lambda k: F.coalesce(of(k, "spans"), F.array().cast(f"array<{SPAN}>"))
    one = (F.count("*") == len(kinds)) & (F.sum(F.pow(F.lit(4), "stream")) == sum(4**k for k in kinds))  # each stream once
    nodes = F.min("node_id").eqNullSafe(F.max("node_id")) & F.count("node_id").isin(0, len(kinds))
    good = one & nodes & (F.min("said") == F.max("said"))
    merged = reduce(DataFrame.unionByName, rows).repartition(*key).groupBy(*key).agg(
        F.min_by("node_id", "stream").alias("node_id"), of(0, "text").alias("text"), spans(1).alias("parameters"), spans(2).alias("units"),
        F.when(~good, MISMATCH).alias("error_code"),
    )
    merged = stage(merged, "merged")
    wrong = merged.filter("error_code is not null").groupBy("doc_id").agg(F.min_by(F.struct("block_order", "node_id"), "block_order").alias("at"))
    whole = merged.join(wrong.select("doc_id"), "doc_id", "left_anti")
    broken = wrong.select("doc_id", "at.*", F.lit(MISMATCH).alias("error_code"))
    return whole.unionByName(broken, allowMissingColumns=True)


def with_values(merged: DataFrame) -> DataFrame:
    """The value expressions of merged blocks, each with the last unit of its block's stream that lies in it
    (``unit_name``), and with the last parameter name before it.
    """
    found = merged.filter("error_code is null").withColumn("v", F.explode(value_expressions(F.col("text"))))
    inside = F.filter("units", lambda u: (u["start"] >= F.col("v.start")) & (u["end"] <= F.col("v.end")))
    unit = F.element_at(F.array_sort(F.transform(inside, lambda u: F.struct(u["end"], u["start"], u["name"].alias("name")))), -1)["name"]
    ahead = F.filter("parameters", lambda p: p["end"] <= F.col("v.start"))
    name = F.element_at(F.array_sort(F.transform(ahead, lambda p: F.struct(p["end"], p["start"], p["name"].alias("name")))), -1)["name"]
    has = lambda some, x: F.when(F.size(some) > 0, x)
    return found.select("doc_id", "block_order", "node_id", "v.*", has(inside, unit).alias("unit_name"), has(ahead, name).alias("parameter_name"))
