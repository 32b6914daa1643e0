"""The grammar of value expressions.

Six forms are read from a text, the most specific first: tolerance (``100 ± 5 g``), range (``20–25 °C``), comparison
(``< 2.0 %``), scalar (``2.5 kg``), category (``OFF``) and cued number (``Speed: 120``). A form claims its span; later
forms may not overlap it. The grammar needs Python's regular expressions (Unicode digits, lookbehind), so it runs as
an Arrow-batched function that gives an array of structs; callers explode it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import controlled, fixed_spellings

VALUES = (
    "array<struct<form:string,start:int,end:int,raw:string,low:string,high:string,ambiguous:boolean,comparator:string,"
    "unit:string,unit_start:int,unit_end:int,controlled_spelling:string,identity:string,label:string>>"
)
_VALUES = pa.list_(
    pa.struct(
        [(n, pa.string()) if k == "string" else (n, pa.int32()) if k == "int" else (n, pa.bool_()) for n, k in (x.split(":") for x in VALUES[13:-2].split(","))]
    )
)
# Fixed values of the grammar.
NUMBER = r"(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\d*\.\d+)"
DASHES = ["–", "-", "—"]
COMPARATORS = ["<=", ">=", "<", ">", "="]
CATEGORIES = ["OFF", "under vacuum"]
CUES = ["Speed:"]
SPREAD = "±"
PAGE_WORDS = ["page", "p.", "step", "stage"]
LOOK_BACK = 8  # characters before a number in which such a word counts

# Each form's patterns with the sign that a text must hold for it; a unit follows.
_FORMS: list[tuple[str, str | None, re.Pattern]] = [
    ("tolerance", SPREAD, rf"(?P<low>{NUMBER})\s*{SPREAD}\s*(?P<high>{NUMBER})"),
    *(("range", dash, rf"(?P<low>{NUMBER})\s*{dash}\s*(?P<high>{NUMBER})") for dash in DASHES),
    *(("comparison", sign, rf"(?<![<>=]){sign}\s*(?P<low>{NUMBER})") for sign in COMPARATORS),
    ("scalar", None, rf"(?P<low>{NUMBER})"),
]
_FORMS = [(form, sign, re.compile(pattern + r"\s*(?P<unit>\S+)")) for form, sign, pattern in _FORMS]
_COUNTED = re.compile("(?:" + "|".join(rf"\b{re.escape(w)}" for w in PAGE_WORDS) + r")\s*\Z", re.I)
_RIGHT = re.compile(rf"{NUMBER}\s*[{SPREAD}{''.join(map(re.escape, DASHES))}]\s*")
_ANY = re.compile("|".join([r"\d", *map(re.escape, CATEGORIES)]))
_LABELS = [(label, re.compile(rf"(?<![^\W]){re.escape(label)}(?!\w)")) for label in CATEGORIES]
_CUED = [(cue, re.compile(rf"(?<!\w){re.escape(cue)}\s*(?P<low>{NUMBER})")) for cue in CUES]


class Units:
    """Known unit spellings, the longest first; catalogue spellings come before the fixed ones."""

    def __init__(self, spellings: list[str] = ()):
        known: dict[str, str] = {}
        for s in sorted(spellings, key=lambda s: (-len(s), s)):
            known.setdefault(s.casefold(), s)
        for s in sorted((x[0] for x in fixed_spellings()), key=lambda s: (-len(s), s)):
            known.setdefault(s.casefold(), s)
        self.by_length: dict[int, set[str]] = {}
        for key, s in known.items():
            self.by_length.setdefault(len(s), set()).add(key)
        self.lengths = sorted(self.by_length, reverse=True)

    def at(self, text: str, start: int) -> tuple[str, int] | None:
        """The longest unit that begins at ``start`` and is not part of a longer word or unit, and its end."""
        for n in self.lengths:
            part = text[start : start + n]
            if len(part) == n and part.casefold() in self.by_length[n] and unit_boundary(text, start, start + n):
                return part, start + n
        return None


def _goes_on(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return kind[0] in "LM" or kind in ("Pc", "Nd", "No") or ch in "/·-⁻⁺₊₋"


def unit_boundary(text: str, start: int, end: int) -> bool:
    """A digit may stand before a unit; nothing that continues one may stand around it."""
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    return (not left or unicodedata.category(left) == "Nd" or not _goes_on(left)) and not (right and _goes_on(right))


def _candidates(text: str, units: Units) -> Iterator[tuple]:
    """All forms in their order of precedence: form, start, end, low, high, comparator, unit, unit start, label.

    A number counts pages or steps where it follows such a word, and is the second of two where it follows a number
    and a dash or spread; these places are found once for the text. A number that hangs on letters, digits,
    underscores or hyphens before it is part of an identifier or date. A page or step word counts within ``LOOK_BACK``
    characters.
    """
    counted = lambda at: _COUNTED.search(text[max(0, at - LOOK_BACK) : at]) is not None
    second = {m.end() for m in _RIGHT.finditer(text)}
    for form, sign, pattern in _FORMS:
        if sign is not None and sign not in text:
            continue
        for m in pattern.finditer(text):
            start, at = m.start(), m.start("unit")
            hangs = form != "comparison" and start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_-")
            if hangs or counted(start) or (form == "scalar" and start in second):
                continue
            unit = units.at(text, at)
            if unit is not None:
                comparator = sign if form == "comparison" else None
                yield form, start, unit[1], m.group("low"), m.groupdict().get("high"), comparator, unit[0], at, None
    for label, pattern in _LABELS:
        for m in pattern.finditer(text):
            yield "category", m.start(), m.end(), None, None, None, None, None, label
    for cue, pattern in _CUED:
        for m in pattern.finditer(text):
            if not counted(m.start()):
                yield "cued", m.start(), m.end(), m.group("low"), None, None, None, None, cue


def read_values(text: str | None, units: Units) -> list[dict]:
    """The value expressions of a text, by span."""
    taken: list[tuple] = []
    if not text or not _ANY.search(text):
        return []
    for c in _candidates(text, units):
        if all(c[2] <= t[1] or c[1] >= t[2] for t in taken):
            taken.append(c)
    out = []
    for form, start, end, low, high, comparator, unit, unit_start, label in sorted(taken, key=lambda c: (c[1], c[2])):
        known = controlled(unit, folded=True) if unit else None
        out.append(
            {
                "form": form, "start": start, "end": end, "raw": text[start:end], "low": low, "high": high,
                "ambiguous": any("," in x for x in (low, high) if x), "comparator": comparator, "unit": unit,
                "unit_start": unit_start, "unit_end": None if unit is None else unit_start + len(unit),
                "controlled_spelling": known and known[0], "identity": known and known[1], "label": label,
            }
        )
    return out


def value_expressions(text: Column, spellings: list[str] = ()) -> Column:
    """Array of the value expressions of a text; ``spellings`` are the catalogue's (a bounded list).

    Of a batch's equal texts one is read; the others take its array.
    """
    units = Units(list(spellings))

    @F.arrow_udf(VALUES)
    def run(texts: pa.Array) -> pa.Array:
        some = texts.dictionary_encode()
        read = pa.array([read_values(t, units) for t in some.dictionary.to_pylist()] + [[]], _VALUES)
        return read.take(some.indices.fill_null(len(read) - 1))

    return run(text)
