"""Secret scans over a content-addressed blob ledger.

Every version of a file is a blob, named by the SHA-256 of its text. The ledger holds one row for each
(blob, rule version) pair that was scanned, with its findings. A scan takes only pairs that the ledger lacks,
reads each such blob once, and joins the findings back to all paths that hold the blob, so copies and old
versions cost nothing. The shuffle of ids is small; texts move once, dealt by their row's own id and blob, so a
group of copies, or the versions of one path, do not meet in one task.

Defined results: null texts count as empty; repeated rows each get their findings; empty tables give empty
results; extra columns are ignored. Offsets are code points, ends exclusive; very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import parts

# The rules by version. A kind's rank is its place in KINDS.
RULES: dict[str, list[tuple[str, str, int, int]]] = {
    # version: (kind, pattern, group whose length counts, least length)
    "base-1": [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    ],
    "more-1": [
        ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ],
}
KINDS = ["assign", "access", "hex", "pem", "jwt"]
FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = f"blob_id string, rule_version string, findings {FINDINGS}"
#: A run of one class with a least length has the same matches as the bare run filtered by that length.
_FAST = {"[0-9a-f]+": "[0-9a-f]{32,}"}


def scan_text(text: str, rules: list[tuple[str, str, int, int]]) -> list[tuple[int, int, int, str]]:
    """All findings of one text: leftmost non-overlapping for each kind, short ones dropped after matching."""
    found = []
    for kind, pattern, group, least in rules:
        rank = KINDS.index(kind)
        for m in re.finditer(_FAST.get(pattern, pattern), text, re.A):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def blob_ids(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Address each version by its content: path (the id), blob_id."""
    return versions.select(
        F.col(id_col).alias("path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob_id")
    )


def scan_unseen(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rule_versions: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """New ledger rows: one for each (blob, rule version) pair of ``versions`` that ``ledger`` lacks."""
    spark = versions.sparkSession
    wanted = list(RULES) if rule_versions is None else rule_versions
    versions = versions.select(
        F.col(id_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # One path stands for each blob: min() folds copies on the map side.
    one = blob_ids(versions, "path").groupBy("blob_id").agg(F.min("path").alias("path"))
    todo = one.withColumn("rule_version", F.explode(F.array(*map(F.lit, wanted))))
    if ledger is not None:
        todo = todo.join(ledger.select("blob_id", "rule_version").distinct(), ["blob_id", "rule_version"], "left_anti")
    # A path may stand for several blobs, its versions; each has its own rules to run.
    todo = todo.groupBy("path", "blob_id").agg(F.collect_set("rule_version").alias("rules"))
    texts = versions.filter(F.col("path").isNotNull()).withColumn("blob_id", F.sha2("text", 256))
    picked = texts.join(todo.filter(F.col("path").isNotNull()).hint("shuffle_hash"), ["path", "blob_id"])
    # Blobs without any path: one of their rows, folded on the map side.
    nowhere = versions.filter(F.col("path").isNull()).groupBy(F.sha2("text", 256).alias("blob_id")).agg(F.any_value("text").alias("text"))
    nowhere = nowhere.join(todo.filter(F.col("path").isNull()).drop("path"), "blob_id")
    columns = ["text", "blob_id", "rules"]
    picked = picked.select(*columns).unionByName(nowhere.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finding = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        kinds = pa.string(), pa.string(), pa.list_(finding)
        for b in parts(batches):
            rows = [
                (blob, v, [dict(zip(("start", "rank", "end", "kind"), x, strict=True)) for x in scan_text(text, RULES[v])])
                for text, blob, versions_ in zip(*(b.column(c).to_pylist() for c in ("text", "blob_id", "rules")), strict=True)
                for v in versions_
            ]
            if rows:
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch(made, names=["blob_id", "rule_version", "findings"])

    out = picked.mapInArrow(run, LEDGER)
    return spark.createDataFrame([], LEDGER) if not wanted else out


def findings_by_path(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join the ledger's findings to every path: path, findings (of all rule versions, by start and kind)."""
    rows = ledger.filter(F.size("findings") > 0).groupBy("blob_id").agg(F.collect_set("findings").alias("parts"))
    rows = rows.select("blob_id", F.array_sort(F.array_distinct(F.flatten("parts"))).alias("findings"))
    return blob_ids(versions, id_col, text_col).join(rows, "blob_id", "left").select(
        "path", "blob_id", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")
    )


def spans_text(findings: str, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    keep = F.col(findings) if kinds is None else F.filter(findings, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(keep, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
