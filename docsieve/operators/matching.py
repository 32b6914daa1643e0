"""The multi-pattern string join: which terms occur where in which blocks, overlaps kept.

The keys of all terms become a dictionary of hashes (``scanning``), broadcast behind a check of its size: about 24
bytes for each key. Blocks are scanned where they are, in Arrow batches, for all keys at once, with the boundaries
checked there; only hits leave, as arrays beside their block, and meet the terms in an equi-join on the compared text,
which broadcasts few terms and sorts and merges many; hits are never broadcast. No text is shuffled. Of a catalogue of
more than ``HELD_KEYS`` terms no dictionary is made: tasks set bitmaps of the keys' hashes, a few megabytes each whatever
the catalogue's size, and the places that pass them meet the keys in the same join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_CLASS, arrow_function, build_surface, comparison_key, places
from .fuzzy import LEAST_WORD
from .scanning import BLOCK_BITS, FILTER_BITS, WHOLE, Dictionary, Filter, ascending, bits, find, head_lengths, key_numbers, short_heads, sized
from .terms import NATURAL_ROLES

_HEAD = regex.compile(rf"[{WORD_CLASS}]+|[^{WORD_CLASS}\s]")
_WORD = regex.compile(rf"[{WORD_CLASS}]")
_LETTERS = regex.compile(rf"\p{{L}}{{{LEAST_WORD},}}")

FOUND = "array<struct<collapse:boolean,start:int,end:int,matched_text:string,key:string>>"
WORDS = "array<struct<start:int,end:int,matched_text:string,word:string>>"
MOST_UNITS = 10_000
#: Keys of a dictionary, which passes through the driver; terms that are broadcast to their hits.
HELD_KEYS, SENT_TERMS = 500_000, 50_000
#: Bits that a task holds before it hands them on.
HELD_BITS = 1 << 22
#: Bytes of texts that are held as Python strings with their hits.
SLICE_BYTES = 1 << 20


def collapses(role: Column, hint: Column) -> Column:
    """Whether a term is compared with white-space runs as one space."""
    return (hint == "default") & role.isin([*NATURAL_ROLES, "generic_cue"])


def keyed_terms(terms: DataFrame) -> DataFrame:
    """Terms with their profile and comparison key."""
    out = terms.withColumn("collapse", collapses(F.col("term_role"), F.col("boundary_hint")))
    return out.withColumn("key", comparison_key("literal", "collapse", once=True)).filter(F.length("key") > 0)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            made = [b.column("collapse"), *(pa.array(x.astype(np.int64)) for x in key_numbers(b.column("key").to_pylist()))]
            yield pa.record_batch(made, names=["collapse", "length", "head", "whole"])


def _dictionaries(numbers: pa.Table) -> dict[bool, Dictionary]:
    """A dictionary for each profile from its keys' lengths and hashes."""
    collapse = numbers["collapse"].to_numpy()
    columns = [numbers["length"].to_numpy(), *(numbers[c].to_numpy().view(np.uint64) for c in ("head", "whole"))]
    return {bool(c): Dictionary(*(x[collapse == c] for x in columns)) for c in np.unique(collapse)}


def scan(text: pa.Array, dictionaries: dict[bool, Dictionary | Filter], units: bool = False) -> pa.ListArray:
    """All hits of each text under each profile."""
    texts = [t or "" for t in text.to_pylist()]
    hits = [(r, c, a, b, texts[r][a:b], key) for c, d in dictionaries.items() for r, a, b, key in find(d, texts, c, units)]
    hits.sort(key=lambda h: h[0])
    row, collapse, start, end, matched, key = zip(*hits, strict=True) if hits else [()] * 6
    kinds = {"collapse": pa.bool_(), "start": pa.int32(), "end": pa.int32(), "matched_text": pa.string(), "key": pa.string()}
    flat = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip((collapse, start, end, matched, key), kinds.values(), strict=True)], list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)) if hits else np.zeros(len(texts) + 1), pa.int32()), flat)


def _slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A column in runs of rows that have, single rows aside, at most ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.append(0, np.cumsum(sizes)), 0
    while at < len(text):
        to = max(int(np.searchsorted(ends, ends[at] + most, "right")) - 1, at + 1)
        yield text.slice(at, to - at)
        at = to


def _scanned(blocks: DataFrame, held: Broadcast, units: bool = False) -> DataFrame:
    """Blocks with their hits in an array ``found``; blocks without hits go."""

    @F.arrow_udf(FOUND)
    def found(text: pa.Array) -> pa.Array:
        made = [scan(part, held.value, units) for part in _slices(text)]
        return pa.concat_arrays(made) if made else scan(text, held.value, units)

    # Else the filter would be pushed below the scan, with a scan of its own.
    return blocks.withColumn("found", found.asNondeterministic()("text")).filter(F.size("found") > 0)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of a task's keys, or of the numbers of keys, by blocks of bitmaps; as block -1 the lengths of a kind."""
    held: dict[tuple[bool, int], list[np.ndarray]] = {}
    lengths: dict[tuple[bool, int], set[int]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (c, kind), parts in held.items():
            found = ascending(np.concatenate(parts))
            block = ascending(found >> BLOCK_BITS)
            first = np.searchsorted(found, block << BLOCK_BITS)
            at = (found & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            yield _marked(c, kind, block, [x.tobytes() for x in np.split(at, first[1:])])
        held.clear()

    for b in batches:
        collapse = b.column("collapse").to_numpy(zero_copy_only=False).astype(bool)
        for c in np.unique(collapse).tolist():
            own = b.filter(pa.array(collapse == c))
            if "key" in own.schema.names:
                keys = own.column("key").to_pylist()
                (length, head, whole), hashes = key_numbers(keys), short_heads(keys)
            else:
                length, hashes = own.column("length").to_numpy(), {}
                head, whole = (own.column(x).to_numpy().view(np.uint64) for x in ("head", "whole"))
            power = head_lengths(length)
            for k in np.unique(power).tolist():
                hashes[k] = sized(head[power == k], length[power == k])
                lengths.setdefault((c, k), set()).update(np.unique(length[power == k]).tolist())
            for kind, found in (hashes | {WHOLE: whole}).items():
                held.setdefault((c, kind), []).append(made := bits(found))
                size += len(made)
        if size > HELD_BITS:
            yield from out()
            size = 0
    yield from out()
    for (c, kind), some in lengths.items():
        yield _marked(c, kind, np.array([-1]), [np.array(sorted(some), np.int64).tobytes()])


def _marked(collapse: bool, kind: int, block: np.ndarray, marks: list[bytes]) -> pa.RecordBatch:
    n = len(marks)
    columns = [pa.array([collapse] * n, pa.bool_()), pa.array([kind] * n, pa.int64()), pa.array(block.astype(np.int64)), pa.array(marks, pa.binary())]
    return pa.record_batch(columns, names=["collapse", "kind", "block", "marks"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of bitmaps, and the lengths of a kind, from the marks of all tasks."""
    made: dict[tuple[bool, int, int], np.ndarray] = {}
    lengths: dict[tuple[bool, int], set[int]] = {}
    for b in batches:
        for c, kind, block, marks in zip(*(b.column(x).to_pylist() for x in ("collapse", "kind", "block", "marks")), strict=True):
            if block < 0:
                lengths.setdefault((c, kind), set()).update(np.frombuffer(marks, np.int64).tolist())
            else:
                if (c, kind, block) not in made:
                    made[c, kind, block] = np.zeros(1 << BLOCK_BITS - 3, np.uint8)
                at = np.zeros(1 << BLOCK_BITS, np.uint8)
                at[np.frombuffer(marks, np.uint16)] = 1
                made[c, kind, block] |= np.packbits(at, bitorder="little")
    for (c, kind, block), whole in made.items():
        yield _marked(c, kind, np.array([block]), [whole.tobytes()])
    for (c, kind), some in lengths.items():
        yield _marked(c, kind, np.array([-1]), [np.array(sorted(some), np.int64).tobytes()])


def _filters(keys: DataFrame) -> dict[bool, Filter]:
    """A filter for each profile, of keys or of their numbers: bits are set and merged in tasks, bitmaps alone come here."""
    kinds = "collapse boolean, kind long, block long, marks binary"
    marks = keys.mapInArrow(_marks, kinds).repartition("collapse", "kind", "block").mapInArrow(_merged, kinds).toArrow()
    maps: dict[tuple, np.ndarray] = {}
    lengths: dict[tuple, np.ndarray] = {}
    for b in marks.to_batches():
        for c, kind, block, found in zip(*b.columns, strict=True):
            c, kind, block = c.as_py(), kind.as_py(), block.as_py()
            if block < 0:
                lengths[c, kind] = np.frombuffer(found.as_buffer(), np.int64)
            else:
                at = block << BLOCK_BITS - 3
                whole = maps.setdefault((c, kind), np.zeros(1 << FILTER_BITS - 3, np.uint8))
                whole[at : at + (1 << BLOCK_BITS - 3)] = np.frombuffer(found.as_buffer(), np.uint8)
    return {c: Filter({k: b for (d, k), b in maps.items() if d == c}, {k: n for (d, k), n in lengths.items() if d == c}) for c in {c for c, _ in maps}}


def key_hits(keys: DataFrame, blocks: DataFrame, held_keys: int = HELD_KEYS, rows: int | None = None) -> DataFrame:
    """Blocks with each place of a key: collapse, start, end, matched_text, key (equal hashes of other texts included).

    ``rows`` is the number of keys, repeats included, where it is known.
    """
    if (keys.count() if rows is None else rows) > held_keys:
        made = _filters(keys)
    else:
        made = _dictionaries(keys.distinct().mapInArrow(_numbered, "collapse boolean, length long, head long, whole long").toArrow())
    return _scanned(blocks, blocks.sparkSession.sparkContext.broadcast(made)).withColumn("h", F.explode("found")).select(*blocks.columns, "h.*")


def _is_word(ch: str) -> bool:
    return bool(ch) and _WORD.fullmatch(ch) is not None


@arrow_function(WORDS)
def letter_words(text: pd.Series) -> pd.Series:
    """The words of letters alone in a text's collapsed surface that may be one edit from a term, as ranges of the text."""
    out = []
    for t in text:
        cmp, begin, finish = places(t or "", True)
        words = []
        for m in _HEAD.finditer(cmp):
            start, end = begin.get(m.start()), finish.get(m.end())
            if not _LETTERS.fullmatch(m.group()) or start is None or end is None:
                continue
            if _is_word(t[start - 1 : start] if start else "") or _is_word(t[end : end + 1]):
                continue
            words.append({"start": start, "end": end, "matched_text": t[start:end], "word": m.group()})
        out.append(words)
    return pd.Series(out, dtype=object)


def _method(hits: DataFrame) -> DataFrame:
    return hits.withColumn("method", F.when(F.col("matched_text") == F.col("literal"), "exact").otherwise("normalized_exact"))


def exact_hits(terms: DataFrame, blocks: DataFrame, held_keys: int = HELD_KEYS) -> DataFrame:
    """Every occurrence of every term: block columns, term columns, start, end, matched_text, method.

    ``blocks`` has a text besides its other columns; ``terms`` is as ``eligible_terms`` gives it. Empty texts and those
    of spaces alone have no hits.
    """
    searched = terms.filter(F.col("boundary_hint") != "atomic_unit")
    keyed, rows = keyed_terms(searched), searched.count()
    full = blocks.filter(F.length(F.trim("text")) > 0)
    found = key_hits(keyed.select("collapse", "key"), full, held_keys, rows)
    # Spark takes hits to be as small as the table their blocks are made of, and would broadcast them.
    found, keyed = (found, F.broadcast(keyed)) if rows <= SENT_TERMS else (found.hint("merge"), keyed)
    return _method(found.join(keyed, ["collapse", "key"]))


def _units_found(terms: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks with the unit spellings found in them, the spellings with their keys, and the unit terms."""
    units = terms.filter(F.col("boundary_hint") == "atomic_unit")
    literals = [r[0] for r in units.select("literal").distinct().limit(MOST_UNITS + 1).collect()]
    if len(literals) > MOST_UNITS:
        raise ValueError("TOO_MANY_UNITS: the unit vocabulary is over its bound")
    names = [(x, key) for x in literals if (key := build_surface(x, False)[0])]
    dictionary = Dictionary(*key_numbers([key for _, key in names])) if names else Dictionary(*[np.zeros(0, np.int64)] * 3)
    found = _scanned(blocks, blocks.sparkSession.sparkContext.broadcast({False: dictionary}), True)
    return found, blocks.sparkSession.createDataFrame(names, "literal string, key string"), units


def unit_hits(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Occurrences of unit spellings. The vocabulary is bounded; more than ``MOST_UNITS`` spellings fail."""
    found, spelled, units = _units_found(terms, blocks)
    found = found.withColumn("h", F.explode("found")).select(*blocks.columns, "h.*").drop("collapse")
    hits = found.join(F.broadcast(spelled), "key").drop("key").join(units, "literal")
    return _method(hits)


def unit_blocks(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """literal and the number of blocks (rows) in which it occurs; a block is counted where it is scanned."""
    found, spelled, units = _units_found(terms, blocks)
    keys = found.select(F.explode(F.array_distinct(F.transform("found", lambda h: h["key"]))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("blocks")).join(spelled, "key").join(units.select("literal").distinct(), "literal", "left_semi").select("literal", "blocks")


def restrict_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of the allowed pages (doc_id, page_number)."""
    return blocks.join(pages.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_semi")
