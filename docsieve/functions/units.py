"""The fixed unit vocabulary and the predicates of unit cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import blank

#: Fixed values: (identity, controlled spelling, further spellings).
FIXED_UNITS = [
    ("kg", "kg", []),
    ("g", "g", []),
    ("mg", "mg", []),
    ("ug", "µg", ["ug"]),
    ("L", "L", []),
    ("mL", "mL", ["ml"]),
    ("uL", "µL", ["uL", "ul"]),
    ("percent", "%", []),
    ("deg_C", "°C", ["C"]),
    ("deg_F", "°F", ["F"]),
    ("K", "K", []),
    ("Pa", "Pa", []),
    ("kPa", "kPa", []),
    ("bar", "bar", []),
    ("atm", "atm", []),
    ("mol", "mol", []),
    ("mmol", "mmol", []),
    ("IU", "IU", []),
    ("CFU", "CFU", []),
    ("rpm", "rpm", []),
    ("min", "min", []),
    ("s", "s", []),
    ("h", "h", []),
]
#: Phrases that mark a cell as no unit.
PLACEHOLDERS = ["unknown", "not applicable", "n/a", "unverified", "indicative", "versus"]


def fixed_spellings() -> list[tuple[str, str, str]]:
    """(spelling, controlled spelling, identity), each spelling once, in vocabulary order."""
    out: dict[str, tuple[str, str, str]] = {}
    for identity, controlled, more in FIXED_UNITS:
        for spelling in (controlled, *more):
            out.setdefault(spelling, (spelling, controlled, identity))
    return list(out.values())


def controlled(spelling: str, folded: bool = False) -> tuple[str, str] | None:
    """(controlled spelling, identity) of a spelling, exactly or under case folding; the first entry wins."""
    for identity, main, more in FIXED_UNITS:
        for s in (main, *more):
            if s == spelling or folded and s.casefold() == spelling.casefold():
                return main, identity
    return None


def fixed_unit_table(spark: SparkSession) -> DataFrame:
    """The vocabulary as rows: spelling, controlled_spelling, identity, row_id."""
    rows = [(s, c, i, f"vocab:{i}") for s, c, i in fixed_spellings()]
    return spark.createDataFrame(rows, "spelling string, controlled_spelling string, identity string, row_id string")


def is_unit_cell(c: Column) -> Column:
    """Whether a catalogue cell is one unit spelling: no placeholder, alternative, footnote, range or prose."""
    low = F.lower(c)
    bad = low.contains(" or ")
    for p in PLACEHOLDERS:
        bad = bad | low.contains(p)
    for p in (";", " / ", "—", "–", "*"):
        bad = bad | c.contains(p)
    bad = bad | (c.contains("¹") & ~c.contains("⁻¹"))
    bad = bad | c.rlike(r"(?U)[\s\x1c-\x1f]") | c.rlike(r"(?U)^[\d.,]+$") | c.rlike(r"(?U)\d+(?:[.,]\d+)?\s*[-–—]\s*\d+(?:[.,]\d+)?")
    return ~blank(c) & ~bad
