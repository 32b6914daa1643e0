"""Source divergence audit: how far the sources of a language are apart in their words, and by which words.

One pass counts, for each part of the texts, the terms of its (lang, source) groups; the counts meet by language and
term, where the terms of too few documents go. A kept term is then its sparse vector of (source, count). Terms of one
vector have the same shares in every source, so they are grouped by it: each pair of sources is evaluated once for
each distinct vector and multiplied by the number of its terms, and a vector's least terms stand for all of them in
the ranks. Distinct vectors are dealt by their hash to blocks of some thousands, and each block meets the sources and
totals of its language; blocks give partial sums of all pairs and the first terms of each source.

Defined results: null text, lang and source count as empty texts, which may be a language and a source; a document is
a row, so repeated rows count again; a term that runs over the part size of a very long text is not cut; groups
without terms still have their pairs; extra columns are ignored. Shares and values are exact in 64 bits as long as a
group has fewer than 9 * 10^15 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .batches import parts, utf8

LEAST_DOCS, RANKS = 10, 10
#: Bytes of text that are counted at once, rows that a task merges before it sends them, vectors of a block.
PART, MERGE_ROWS, BLOCK = 8 << 20, 1 << 20, 8192
SCALE = 1_000_000_000

#: Each byte of a term as it is compared, 0 for all that separate terms.
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[*range(65), *range(91, 97), *range(123, 128)]] = 0
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The row of each term, and the terms, of rows that lie end to end in ``data``."""
    folded = _FOLDED[data]
    inside = folded > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(folded[inside]))
    return np.searchsorted(ends[1:], starts, "right"), terms


def _by_row(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of distinct (row, term): row, code of the term; the terms; how often each occurs."""
    data, ends = utf8(column)
    if len(data) <= 2 * PART or len(column) > 1:
        row, terms = tokens(data, ends)
        coded = terms.dictionary_encode()
        pair, n = np.unique(row * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
        return *np.divmod(pair, max(len(coded.dictionary), 1)), coded.dictionary, n
    at, found = 0, None  # one very long text, in pieces that end between terms
    while at < len(data):
        to = min(at + PART, len(data))
        while to < len(data) and _FOLDED[data[to]]:
            gap = np.flatnonzero(_FOLDED[data[to : to + 4096]] == 0)
            to = to + (int(gap[0]) if len(gap) else min(4096, len(data) - to))
        counted = pc.value_counts(tokens(data[at:to], np.array([0, to - at]))[1])
        piece = pa.table({"t": counted.field("values"), "n": counted.field("counts")})
        found = piece if found is None else pa.concat_tables([found, piece.rename_columns(found.column_names)])
        found = found.group_by("t").aggregate([("n", "sum")]).rename_columns(["t", "n"])
        at = to
    n = found["n"].to_numpy()
    return np.zeros(len(n), np.int64), np.arange(len(n)), found["t"].combine_chunks(), n


def count_part(batch: pa.RecordBatch) -> pa.Table:
    """The terms of each (lang, source) of a batch: in how many of its rows, and how often."""
    row, code, terms, n = _by_row(batch.column("text"))
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    key = group[row] * len(terms) + code
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(cuts, len(key)))
    sums = np.add.reduceat(n, cuts) if len(cuts) else np.zeros(0, np.int64)
    group, code = np.divmod(key[cuts], max(len(terms), 1))
    named = [lang.dictionary.take(pa.array(group // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(group % max(len(source.dictionary), 1)))]
    return pa.table([*named, terms.take(pa.array(code)).cast(pa.string()), pa.array(times, pa.int64()), pa.array(sums, pa.int64())], schema=_COUNTS)


def _merged(tables: list[pa.Table]) -> pa.Table:
    some = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
    return some.rename_columns(_COUNTS.names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows, merged in bounded tables before they are sent."""
    held: list[pa.Table] = []
    for b in parts(batches, PART, 1 << 14):
        held.append(count_part(b))
        if sum(t.num_rows for t in held) > MERGE_ROWS:
            held = [_merged(held)]
            if held[0].num_rows > MERGE_ROWS // 2:
                yield from held.pop().to_batches(1 << 16)
    if held:
        yield from _merged(held).to_batches(1 << 16)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term and vector (source, count) of the terms in enough of the language's documents."""
    counts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.filter(F.col("docs") >= least_docs).select("lang", "term", "vector")


def distinct_vectors(kept: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, vector, terms: how many terms have it, least: the first of them."""
    sizes = kept.groupBy("lang", "vector").agg(F.count("*").alias("terms"))
    nth = F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))
    least = kept.withColumn("nth", nth).filter(F.col("nth") <= ranks).groupBy("lang", "vector").agg(F.sort_array(F.collect_list("term")).alias("least"))
    return sizes.join(least, ["lang", "vector"])


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) for 0 <= count <= total, as a long division by thousands."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


_FOUND = "lang string, source string, part string, item string, value long"


def _evaluated(ranks: int):
    """What a block of a language's vectors gives: partial sums of all pairs, the first terms of each source."""

    def run(vectors: pa.Table, langs: pa.Table) -> pa.Table:
        lang, groups, kept = (langs[c][0].as_py() for c in ("lang", "groups", "terms"))
        names = [g["source"] for g in groups]
        totals = np.array([g["n"] for g in groups], np.int64)
        width = len(names)
        sums = np.zeros((width, width), np.int64)
        best: list[list[tuple[int, bytes]]] = [[] for _ in names]
        for at in range(0, vectors.num_rows, rows := max(1, (1 << 21) // width)):
            some = vectors.slice(at, rows).combine_chunks()
            lists = some["vector"].combine_chunks()
            flat = lists.flatten()
            counts = np.zeros((some.num_rows, width), np.int64)
            where = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())
            counts[where, pc.index_in(flat.field("source"), pa.array(names)).to_numpy()] = flat.field("n").to_numpy()
            p, times = shares(counts + 2, totals + 2 * kept), some["terms"].to_numpy()
            for a in range(width - 1):
                sums[a, a + 1 :] += times @ divergence(p[:, a, None], p[:, a + 1 :])
            q = shares(counts.sum(1) + 2, totals.sum() + 2 * kept)
            least = some["least"]
            for a in range(width):
                more = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
                if not len(more):
                    continue
                value = divergence(p[more, a], q[more])
                if len(value) > ranks:
                    high = value >= np.partition(value, -ranks)[-ranks]
                    more, value = more[high], value[high]
                terms = least.take(pa.array(more)).to_pylist()
                best[a] = sorted([*best[a], *((-int(v), t.encode()) for v, ts in zip(value, terms, strict=True) for t in ts)])[:ranks]
        sums += sums.T
        out = [(names[a], "pair", names[b], int(sums[a, b])) for a in range(width) for b in range(width) if a != b]
        out += [(names[a], "term", t.decode(), -v) for a in range(width) for v, t in best[a]]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array([lang] * len(out), pa.string()), *map(pa.array, columns, kinds)], names=["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, ranks: int = RANKS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank from ``docs`` with text, lang and source.

    Part ``pair`` ranks the other sources of the language by the summed divergence of all kept terms, part ``term``
    the kept terms that the source uses more than its language does (the first ``ranks``).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    kept = stage(kept_terms(docs, least_docs), "terms")
    blocks = max(1, -(-kept.count() // block))
    words = kept.select("lang", F.explode("vector").alias("v")).groupBy("lang", F.col("v.source").alias("source")).agg(F.sum("v.n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(words, ["lang", "source"], "left")
    groups = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    langs = groups.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    langs = langs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("lang", "block", "groups", "terms")
    vectors = distinct_vectors(kept, ranks).withColumn("block", F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int"))
    found = vectors.groupBy("lang", "block").cogroup(langs.groupBy("lang", "block")).applyInArrow(_evaluated(ranks), _FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    out = found.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return out.select("lang", "source", "part", "item", "value", "rank")
