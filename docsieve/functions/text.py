"""Comparison surfaces and boundary tests.

A comparison surface is a text as it is compared: each character with its combining marks is composed (NFC) and case
folded; with ``collapse`` a run of white space becomes one space. Composition and case folding are absent from Spark
SQL, so surfaces come from one Arrow-batched function; everything after it (substring checks, projection of a range
back to the text, boundary tests) is built-in expressions on its arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SURFACE = "struct<cmp:string,collapse:boolean,os:array<int>,oe:array<int>,cs:array<int>,ce:array<int>>"
#: Character classes that continue a word or code, and a unit.
WORD_CLASS = r"\p{L}\p{M}\p{Nd}\p{Pc}\-"
UNIT_CLASS = WORD_CLASS + r"\p{No}/·⁻⁺₊₋"

#: Characters below the combining marks, but for those whose folded form is longer.
_PLAIN = re.compile("[\x00-\xde\xe0-\u012f\u0131-\u0148\u014a-\u01ef\u01f1-\u02ff]*")
_GAPS, _WHITE = re.compile(r"\s\s"), re.compile(r"\s")


def arrow_function(ddl: str) -> Callable:
    """A function of series as a function of columns; made when it is first called, as it needs a session.

    With ``once`` a filter on the result is not pushed below the call, where it would call the function again.
    """

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns, once: bool = False) -> Column:
            made = F.pandas_udf(f, ddl)
            return (made.asNondeterministic() if once else made)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap


def plain_surface(text: str, collapse: bool) -> str | None:
    """The compared text where each character is one unit that stays one character, as in most texts; else None."""
    if not _PLAIN.fullmatch(text) or (collapse and _GAPS.search(text)):
        return None
    return (_WHITE.sub(" ", text) if collapse else text).casefold()


class _Same(dict):
    """Places that are their own projections."""

    def get(self, at, default=None):
        return at


def places(text: str, collapse: bool) -> tuple[str, dict[int, int], dict[int, int]]:
    """The compared text, and the original places of its units' starts and ends."""
    if (cmp := plain_surface(text, collapse)) is not None:
        return cmp, _Same(), _Same()
    cmp, os_, oe, cs, ce = build_surface(text, collapse)
    return cmp, dict(zip(cs, os_, strict=True)), dict(zip(ce, oe, strict=True))


def build_surface(text: str, collapse: bool) -> tuple[str, list[int], list[int], list[int], list[int]]:
    """The compared text and, for each of its units, the original and compared ranges."""
    if (cmp := plain_surface(text, collapse)) is not None:
        at = list(range(len(text) + 1))
        return cmp, at[:-1], at[1:], at[:-1], at[1:]
    parts: list[str] = []
    starts, ends, low, high = [], [], [], []
    at = i = 0
    while i < len(text):
        j = i + 1
        if collapse and text[i].isspace():
            while j < len(text) and text[j].isspace():
                j += 1
            piece = " "
        else:
            while j < len(text) and unicodedata.combining(text[j]):
                j += 1
            piece = unicodedata.normalize("NFC", text[i:j]).casefold()
        parts.append(piece)
        starts.append(i)
        ends.append(j)
        low.append(at)
        at += len(piece)
        high.append(at)
        i = j
    return "".join(parts), starts, ends, low, high


@arrow_function(SURFACE)
def surface(text: pd.Series, collapse: pd.Series) -> pd.DataFrame:
    """The comparison surface of a text (null: of an empty text)."""
    made = [(*build_surface(t or "", bool(c)), bool(c)) for t, c in zip(text, collapse, strict=True)]
    return pd.DataFrame(
        [(m[0], m[5], m[1], m[2], m[3], m[4]) for m in made], columns=["cmp", "collapse", "os", "oe", "cs", "ce"]
    )


@arrow_function("string")
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding."""
    return text.map(lambda t: None if t is None else t.casefold())


@arrow_function("string")
def comparison_key(literal: pd.Series, collapse: pd.Series) -> pd.Series:
    """A term's key: its surface without white space at the ends."""
    made = ((t.strip(), bool(c)) if t else None for t, c in zip(literal, collapse, strict=True))
    return pd.Series([None if x is None else build_surface(*x)[0] if (cmp := plain_surface(*x)) is None else cmp for x in made])


def project(surf: Column, start: Column, end: Column) -> Column:
    """Original (start, end) of a compared range; null unless it begins and ends with whole units."""
    first, last = F.array_position(surf["cs"], start), F.array_position(surf["ce"], end)
    return F.when(
        (first > 0) & (last > 0),
        F.struct(
            F.element_at(surf["os"], first.cast("int")).alias("start"), F.element_at(surf["oe"], last.cast("int")).alias("end")
        ),
    )


def respects_boundary(text: Column, start: Column, end: Column, hint: Column) -> Column:
    """Whether the characters around [start, end) leave it a whole word, code or unit."""
    left, right = F.substring(text, start, F.lit(1)), F.substring(text, end + 1, F.lit(1))
    left = F.when(start > 0, left).otherwise("")
    word = lambda c: c.rlike(f"^[{WORD_CLASS}]$")
    unit = lambda c: c.rlike(f"^[{UNIT_CLASS}]$")
    atomic = (left.rlike(r"^\p{Nd}$") | ~unit(left)) & ~unit(right)
    return F.when(hint == "atomic_unit", atomic).otherwise(~word(left) & ~word(right))


#: Letters in small that several capitals stand for in full mapping, with the one letter of the simple mapping.
_ONE_CAPITAL = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0xDF, 0xFB18)) if len(c.upper()) > 1}


def simple_upper(c: Column) -> Column:
    """Capitals letter by letter, so that a text keeps its length (Spark's upper makes SS of ß)."""
    few = F.create_map(*(F.lit(x) for kv in _ONE_CAPITAL.items() for x in kv))
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(few[x], F.upper(x))), "")


def blank(c: Column) -> Column:
    """Null, empty or white space alone (in any script)."""
    return F.coalesce(c.rlike(r"(?U)^[\s\x1c-\x1f]*$"), F.lit(True))


def optional(c: Column) -> Column:
    """A blank cell as null, any other untouched."""
    return F.when(~blank(c), c)


def evidence_text(c: Column) -> Column:
    """White-space runs as one space, none at the ends, of a text whose entities are decoded."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


@arrow_function("string")
def decode_entities(text: pd.Series) -> pd.Series:
    """HTML entities decoded once."""
    import html

    return text.map(lambda t: None if t is None else html.unescape(t))


def escape_html(c: Column) -> Column:
    """A text for HTML, quotes included."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def tsv_cell(c: Column) -> Column:
    """A text for one cell: tabs and line ends become spaces, runs of spaces one, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\t\r\n]+", " "), " +", " "))
