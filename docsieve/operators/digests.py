"""Digests of tables as multisets: the same for any order of rows and any partitioning, changed by any change of a cell.

Each row becomes a text that tells its cells apart (nulls too), four salted SHA-256 of it give forty numbers of 24 bits,
and a table's lanes are their sums: partial aggregates alone meet in the shuffle, and the lanes of two tables add up to
those of their union, so an append needs its new rows only. The digest hashes the row count and all lanes. Sums of up to
2^39 rows fit in 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS, SLICES, DIGITS = 4, 10, 6
LANES = SALTS * SLICES


def row_text(columns: list[str]) -> Column:
    """A row as one text: each cell's length and text, nulls as a mark of their own."""
    cell = lambda c: F.col(f"`{c}`").cast("string")
    return F.concat(*(F.coalesce(F.concat(F.length(cell(c)).cast("string"), F.lit(":"), cell(c)), F.lit("-")) for c in columns)) if columns else F.lit("")


def lanes(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows and lanes (an array of sums) of a table, or of each group of the columns ``by``.

    All columns count, those of ``by`` too; columns are taken by name, so their order in the table does not matter.
    """
    text = row_text(sorted(table.columns))
    salted = table.select(*(by or []), *(F.sha2(F.concat(F.lit(f"{s}|"), text), 256).alias(f"_h{s}") for s in range(SALTS)))
    part = lambda s, k: F.conv(F.substring(f"_h{s}", 1 + DIGITS * k, DIGITS), 16, 10).cast("long")
    sums = [F.coalesce(F.sum(part(s, k)), F.lit(0)) for s in range(SALTS) for k in range(SLICES)]
    return salted.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.array(*sums).alias("lanes"))


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The rows and lanes of the union of what the parts (rows, lanes) stand for."""
    sums = [F.coalesce(F.sum(F.element_at("lanes", k + 1)), F.lit(0)) for k in range(LANES)]
    return parts.groupBy(*(by or [])).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.array(*sums).alias("lanes"))


def digest() -> Column:
    """The hex digest of the columns rows and lanes."""
    return F.sha2(F.concat_ws(",", F.col("rows").cast("string"), F.transform("lanes", lambda x: x.cast("string"))), 256)
