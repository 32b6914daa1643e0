"""Tolerances whose sign may have been lost: a cue and a plus sign, but no plus-minus and no second bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The cue words, the abbreviation that is written out, a second bound, and a plus before a number.
CUE = r"(?iU)\b(?:tolerance|allowable\s+deviation|toler\.?)(?!\w)"
ABBREVIATION = r"(?iU)^((?s:.*?))\btoler\.?(?!\w)"
SECOND_BOUND = r"(?U)\+\s*\d+[.,]?\d*\s*%?\s*/\s*-\s*\d+"
PLUS_NUMBER = r"(?U)(?<!±)\+\s*\d"


def is_ambiguous_tolerance(text: Column) -> Column:
    """``Toler +0.1 %`` may have been ``± 0.1 %``; ``+0.1 / -0.2`` and ``±`` are plain."""
    return text.rlike(CUE) & ~text.contains("±") & ~text.rlike(SECOND_BOUND) & text.rlike(PLUS_NUMBER)


def suggested_text(text: Column) -> Column:
    """The abbreviation written out once, and the first plus sign as plus-minus."""
    long = F.regexp_replace(text, ABBREVIATION, "$1Tolerance")
    return F.regexp_replace(long, r"^([^+]*)\+", "$1±")
