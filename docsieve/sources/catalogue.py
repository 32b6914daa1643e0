"""Catalogue sources: strict CSV, Parquet snapshots with a manifest, and SQLite files of flat text tables."""

from __future__ import annotations

import hashlib
import json
import sqlite3
from collections.abc import Iterator

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import blank
from ..operators.digests import digest, lanes
from .schemas import CATALOGUE


class CatalogueError(ValueError):
    """A source or snapshot that may not be used, with a short code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message[:200]}")
        self.code = code


def check_header(columns: list[str]) -> None:
    """Headers must be named and distinct."""
    if any(not c.strip() for c in columns):
        raise CatalogueError("BLANK_HEADER", "a column has no name")
    if len(set(columns)) != len(columns):
        raise CatalogueError("DUPLICATE_HEADER", "two columns have one name")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of text cells with exactly these columns; malformed records fail, empty cells are ''."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
    table = reader.option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return table.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def clean_rows(table: DataFrame) -> DataFrame:
    """Rows with any content; a row without id fails."""
    full = table.filter(~F.forall(F.array(*(F.col(f"`{c}`") for c in table.columns)), blank))
    return full.withColumn(
        "row_id", F.when(blank(F.col("row_id")), F.raise_error(F.lit("BLANK_ROW_ID"))).otherwise(F.col("row_id"))
    )


def duplicate_ids(table: DataFrame) -> DataFrame:
    """Ids of more than one row; must be empty."""
    return table.groupBy("row_id").count().filter("count > 1")


def content_digest(table: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever the order of its rows."""
    return lanes(table).select("rows", digest().alias("digest"))


def snapshot_id(identity: dict) -> str:
    """A version name from what identifies a snapshot."""
    text = json.dumps(identity, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "flat-v1-" + hashlib.sha256(text.encode()).hexdigest()[:20]


def build_snapshot(tables: dict[str, DataFrame], path: str) -> dict:
    """Write tables as Parquet under ``path`` and return the manifest; the manifest file is written last."""
    facts = {}
    for name, table in tables.items():
        table = clean_rows(table)
        if not duplicate_ids(table).isEmpty():
            raise CatalogueError("DUPLICATE_ROW_ID", name)
        r = content_digest(table).first()
        table.write.mode("errorifexists").option("parquet.enable.dictionary", True).parquet(f"{path}/{name}")
        facts[name] = {"columns": table.columns, "rows": r["rows"], "digest": r["digest"]}
    manifest = {"snapshot_id": snapshot_id(facts), "tables": facts}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/_manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A snapshot's manifest, whose name must follow from its facts."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
        if snapshot_id(manifest["tables"]) != manifest["snapshot_id"]:
            raise CatalogueError("IDENTITY_MISMATCH", path)
    except (AnalysisException, TypeError, KeyError, ValueError) as why:
        if isinstance(why, CatalogueError):
            raise
        raise CatalogueError("MANIFEST_INVALID", path) from None
    return manifest


def _stored(spark: SparkSession, path: str, name: str, facts: dict) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` string" for c in facts["columns"])).parquet(f"{path}/{name}")


def snapshot_problems(spark: SparkSession, path: str, expected: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(table, code) for all that is wrong with a snapshot: one entry at most for each table; none if it may be used.

    ``expected`` names the tables that must be there with their columns. Counts and digests are computed anew from the
    stored rows.
    """
    try:
        facts = read_manifest(spark, path)["tables"]
    except CatalogueError as why:
        return [("", why.code)]
    expected = {n: f["columns"] for n, f in facts.items()} if expected is None else expected
    found = [(n, "TABLE_UNKNOWN") for n in sorted(set(facts) - set(expected))]
    for name, columns in sorted(expected.items()):
        if name not in facts:
            found.append((name, "TABLE_MISSING"))
            continue
        if facts[name]["columns"] != columns:
            found.append((name, "COLUMNS_MISMATCH"))
            continue
        try:
            table = _stored(spark, path, name, facts[name])
            r = content_digest(table).first()
            ids = duplicate_ids(table).isEmpty() if "row_id" in columns else True
        except PySparkException:
            found.append((name, "TABLE_UNREADABLE"))
            continue
        if r["rows"] != facts[name]["rows"]:
            found.append((name, "ROW_COUNT_MISMATCH"))
        elif r["digest"] != facts[name]["digest"]:
            found.append((name, "CONTENT_MISMATCH"))
        elif not ids:
            found.append((name, "DUPLICATE_ROW_ID"))
    return found


def reusable_snapshot(tables: dict[str, DataFrame], path: str) -> dict | None:
    """The manifest of the snapshot at ``path`` if it is sound and holds just these tables' rows, else nothing.

    Sources are compared by their digests, whatever the order of their rows and files.
    """
    spark = next(iter(tables.values())).sparkSession
    if snapshot_problems(spark, path, {n: t.columns for n, t in tables.items()}):
        return None
    manifest = read_manifest(spark, path)
    for name, table in tables.items():
        r = content_digest(clean_rows(table)).first()
        if (r["rows"], r["digest"]) != (manifest["tables"][name]["rows"], manifest["tables"][name]["digest"]):
            return None
    return manifest


def prepare_snapshot(tables: dict[str, DataFrame], path: str, candidates: list[str]) -> tuple[dict, str]:
    """The first of ``candidates`` that can be used as it is, else a snapshot built at ``path``: its manifest and path."""
    for old in candidates:
        if (manifest := reusable_snapshot(tables, old)) is not None:
            return manifest, old
    return build_snapshot(tables, path), path


def open_snapshot(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot whose columns, counts and digests agree with its manifest."""
    manifest = read_manifest(spark, path)
    problems = snapshot_problems(spark, path) if verify else []
    for name, code in problems:
        raise CatalogueError("CONTENT_MISMATCH" if code == "ROW_COUNT_MISMATCH" else code, name)
    return {name: _stored(spark, path, name, facts) for name, facts in manifest["tables"].items()}


class RowRange(InputPartition):
    """Rows after ``low`` up to ``high``."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class FlatSqliteReader(DataSourceReader):
    """Reads one table by ranges of row numbers, each in its own task."""

    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        if self.table not in CATALOGUE:
            raise CatalogueError("UNKNOWN_TABLE", self.table)

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[RowRange]:
        with self._open() as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 1), coalesce(max(rowid), 0) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(k - 1, min(high, k + step - 1)) for k in range(low, high + 1, step)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        columns = ", ".join(f'"{c}"' for c in CATALOGUE[self.table])
        with self._open() as db:
            yield from db.execute(
                f'SELECT rowid, {columns} FROM "{self.table}" WHERE rowid > ? AND rowid <= ? ORDER BY rowid',
                (partition.low, partition.high),
            )


class FlatSqlite(DataSource):
    """``spark.read.format("flat_sqlite").option("table", ...).load(path)``: scan_cursor and the table's columns."""

    @classmethod
    def name(cls) -> str:
        return "flat_sqlite"

    def schema(self) -> str:
        return "scan_cursor bigint, " + ", ".join(f"`{c}` string" for c in CATALOGUE[self.options["table"]])

    def reader(self, schema) -> FlatSqliteReader:
        return FlatSqliteReader(dict(self.options))
