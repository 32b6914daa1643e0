"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised: lower case, every run of characters other than letters and digits becomes one space. An item of
m characters may occur with up to ``budget(m)`` edits. It is cut into that many pieces plus one; whoever contains the
item within the budget contains one piece exactly, so an Aho-Corasick automaton over all pieces finds every
candidate place. Each is verified by Myers' bit-parallel edit distance of the whole item against the text around it
(the distance to the best substring), so no occurrence within the budget is lost.

The items are the small side: their automaton goes to the executors in groups of at most ``GROUP_CHARS`` characters,
one pass over the texts for each group, whatever the number of items. Documents are read in place, without a shuffle.

Defined results: items without a letter or digit and null items match nothing; null and empty texts are clean; items
too short for pieces of ``PIECE`` characters must occur exactly; repeated items and documents each give their own
rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parts, table_of

PIECE = 16
GROUP_CHARS = 8_000_000
HITS = "doc_id long, item_id long, distance int, end_at int, item_chars int"
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower-cased words with one space before, between and after."""
    return " " + _OTHER.sub(" ", (text or "").lower()).strip() + " "


def budget(m: int) -> int:
    """The edits allowed for an item of m characters: one less than its pieces of ``PIECE`` characters."""
    return max(0, m // PIECE - 1)


def pieces(item: str) -> list[tuple[int, str]]:
    """Budget-plus-one pieces that cover the item, with their offsets."""
    k = budget(len(item)) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.m, self.high, self.mask = len(item), 1 << (len(item) - 1), (1 << len(item)) - 1
        self.peq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the item to a substring of ``text``, and where the first such substring ends."""
        pv, mv, score, best, end = self.mask, 0, self.m, self.m, 0
        peq, mask, high = self.peq, self.mask, self.high
        for j, c in enumerate(text):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & high:
                score -= -1
            elif mh & high:
                score -= 1
            ph = ph << 1 & mask
            pv = (mh << 1 & mask) | ~(xv | ph) & mask
            mv = ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end


class Matcher:
    """All items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, x) for i, x in ((i, normalise(x)) for i, x in items) if x.strip()]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for at, piece in pieces(item):
                found.setdefault(piece, []).append((k, at))
        self.patterns = [Pattern(x) for _, x in self.items]
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, least distance, end of the match in the normalised text, item length) of each item found."""
        if self.empty or not text:
            return []
        text = normalise(text)
        places: dict[int, set[int]] = {}
        for end, (n, owners) in self.automaton.iter(text):
            for k, at in owners:
                places.setdefault(k, set()).add(end + 1 - n - at)
        out = []
        for k, starts in places.items():
            item_id, item = self.items[k]
            m, most = len(item), budget(len(item))
            best, end, done = most + 1, 0, -1
            for s in sorted(starts):  # a window inside the one before needs no second look
                a, b = max(0, s - most), s + m + most
                if b <= done:
                    continue
                if s >= 0 and text.startswith(item, s):
                    best, end = 0, s + m
                    break
                d, e = self.patterns[k].best(text[a:b])
                if d < best:
                    best, end = d, a + e
                done = b
            if best <= most:
                out.append((item_id, best, end, m))
        return out


def item_groups(benchmark: DataFrame, most: int = GROUP_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of at most ``most`` characters, read to the driver one group at a time."""
    group, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        size = len(r["text"] or "")
        if group and held + size > most:
            yield group
            group, held = [], 0
        group.append((r["item_id"], r["text"]))
        held += size
    if group:
        yield group


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, distance, end_at, item_chars."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for group in item_groups(benchmark):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(group)
            for b in parts(batches):
                both = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                found = [(d, *hit) for d, text in both for hit in matcher.search(text)]
                if found:
                    yield table_of(HITS, zip(*found, strict=True))

        part = rows.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], HITS) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that hold no item; decided in place, row by row."""
    groups = list(item_groups(benchmark))
    schema = docs.schema

    for group in groups:

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(group)
            for b in parts(batches):
                yield b.filter(pa.array([not matcher.search(x) for x in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
