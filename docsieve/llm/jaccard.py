"""N-gram Jaccard join with signature trees.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches a threshold. The join is exact:

1. Documents with equal sets are one candidate, named by their least id.
2. A set's tokens are put in one global order, the most frequent last. Sets that reach the threshold share a token
   of their prefixes (size - ceil(threshold * size) + 1 tokens), so tokens are the buckets in which pairs can meet.
   Frequent tokens come from counts over all documents; the table of them is bounded by ``HEAVY`` entries and only
   orders tokens, so it has no part in what links.
3. In each bucket every set is compared to the bucket's least one by size and bitmap. That gives most links of a
   family in a number of comparisons that grows with its size, and first components.
4. Buckets whose sets still lie in more than one component are joined by signature trees. A tree's nodes hold the
   OR and AND of their sets' token bitmaps, their range of sizes and their component if it is one. Two trees (or a
   tree with itself) are traversed together; a pair of nodes is pruned if it is of one component, if its sizes
   cannot reach the threshold, or if its largest possible overlap is too small. Buckets of more than ``TREE`` sets
   are split into blocks, and each pair of blocks is a group of its own.
5. What is left is verified on the whole sets, which are made for these documents alone. Where links did not hold,
   the trees are asked once more with the true components. Components are then taken over all links.

Defined results: null texts and texts without a word have an empty set, link with nothing and are their own
component; null ids link only through equal sets; rows with one id count as that id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, stage
from .batches import parts, table_of, utf8
from .components import connected_components, tidy

HEAVY, HEAVY_LOCAL, HEAVY_LEAST, TREE, LEAF = 1 << 16, 4, 16, 512, 8
#: Rows of small groups that one call handles.
GROUPED = 20_000
_STEP, _FOLD, _STRIPE = 1 << 19, 1 << 18, 1 << 20
#: Parts of the rows of one set, so that a large group of copies is no single task's.
SALTS = 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Rule:
    """n words make a token; sets link when ``den`` times their overlap reaches ``num`` times their union."""

    n: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1 if size else 0

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's hash and row; words are runs of bytes other than ASCII white space, ASCII letters in one case.

    A word's hash sums mixed (byte, place in the word) pairs. Long texts are read in stripes that end between words.
    """
    hashes, rows, at, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(data)
    while at < n:
        size = _STRIPE
        while at + size < n and not (gaps := np.flatnonzero(_WHITE[data[at : at + size]])).size:
            size *= 2
        to = n if at + size >= n else at + int(gaps[-1]) + 1
        some = data[at:to]
        ink = ~_WHITE[some]
        cut = np.zeros(len(some), bool)  # rows begin here
        inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, to)] - at
        cut[inner] = True
        first = ink.copy()
        first[1:] &= cut[1:] | ~ink[:-1]
        start = np.flatnonzero(first)
        if len(start):
            place = np.arange(len(some)) - start[np.maximum(np.cumsum(first) - 1, 0)]
            pairs = _mixed(_BYTES[some] + place.astype(np.uint64) * _M1)
            pairs[~ink] = 0
            hashes.append(np.add.reduceat(pairs, start))
            rows.append(np.searchsorted(ends, start + at, "right") - 1)
        at = to
    return np.concatenate(hashes), np.concatenate(rows)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text, ascending; texts lie end to end in ``data``."""
    h, row = word_hashes(data, ends)
    counts = np.bincount(row, minlength=len(ends) - 1)
    grams = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        grams = (grams ^ (grams >> np.uint64(29))) * _M1 + h[k : k + len(grams)]
    grams = _mixed(grams)
    out, at = [], 0
    for size in counts.tolist():
        if size >= n:
            s = np.sort(grams[at : at + size - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif size:
            one = size
            for x in h[at : at + size].tolist():
                one = (one * 0x94D049BB133111EB + x) & (2**64 - 1)
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def heavy_tokens(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent tokens (ascending) with their ranks (the least frequent first), and the number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, new, held, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0

        def fold() -> None:
            nonlocal tokens, counts, new, held
            both = np.concatenate([tokens, *new])
            by = np.argsort(both)
            both, sums = both[by], np.concatenate([counts, np.ones(held, np.int64)])[by]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            sums = np.add.reduceat(sums, first) if len(both) else sums
            keep = sums > (1 if len(first) > 2 * _FOLD else 0)
            tokens, counts, new, held = both[first][keep], sums[keep], [], 0

        for b in parts(batches):
            sets = shingle_sets(*utf8(b.column("text")), rule.n)
            new += sets
            n = sum(map(len, sets))
            held, total = held + n, total + n
            if held > _FOLD:
                fold()
        fold()
        keep = counts >= HEAVY_LOCAL
        yield table_of(COUNTS, (tokens[keep].view(np.int64), counts[keep], np.zeros(keep.sum(), np.int64)))
        yield table_of(COUNTS, ([0], [0], [total]))

    seen = docs.select("text").mapInArrow(count, COUNTS)
    sums = seen.groupBy("token").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).checkpoint()
    total = sums.agg(F.sum("total")).first()[0] or 0
    top = sums.filter(F.col("n") >= HEAVY_LEAST).orderBy(F.desc("n"), "token").limit(HEAVY).select("token").collect()
    tokens = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    ranks = np.arange(len(tokens), 0, -1)
    by = np.argsort(tokens)
    return tokens[by], ranks[by], int(total)


def _squeeze(x: np.ndarray) -> bytes:
    """Long integers as zstandard-compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueeze(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


COUNTS = "token long, n long, total long"
SIGNATURES = "doc_id long, n long, s1 long, s2 long, bits binary, part int, tokens binary, docs binary, token long"
PAIRS = "a long, b long"


def signatures(docs: DataFrame, rule: Rule, heavy: tuple[np.ndarray, np.ndarray], parts_: int) -> DataFrame:
    """Three kinds of rows: a document (n and the digest of its set); a pack of prefix tokens of one range of
    tokens with their documents; a frequent prefix token with its document."""
    heavy_set, heavy_rank = heavy

    def rows(size: int, **columns) -> pa.RecordBatch:
        return table_of(SIGNATURES, [columns.get(x.split()[0], [None] * size) for x in SIGNATURES.split(", ")])

    def flush(packs_t: list, packs_d: list) -> pa.RecordBatch:
        t, d = np.concatenate(packs_t), np.concatenate(packs_d)
        by = np.argsort(t)
        t, d = t[by], d[by]
        part = ((t >> np.uint64(32)) * np.uint64(parts_) >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(cuts[1:], len(t))
        both = list(zip(cuts.tolist(), ends.tolist(), strict=True))
        tokens = [_squeeze(np.diff(t[a:b], prepend=np.uint64(0))) for a, b in both]
        return rows(len(cuts), part=part[cuts], tokens=tokens, docs=[_squeeze(d[a:b]) for a, b in both])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, packs_t, packs_d, seen, known = 0, [], [], set(), 0
        for b in parts(batches):
            sets = shingle_sets(*utf8(b.column("text")), rule.n)
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            s12 = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield rows(
                b.num_rows, doc_id=b.column("doc_id"), n=[len(s) for s in sets], s1=s12[:, 0], s2=s12[:, 1],
                bits=[bitmap(s) if len(s) else b"" for s in sets],
            )
            hot_t, hot_d = [], []
            for doc, s, digest in zip(b.column("doc_id").to_pylist(), sets, digests, strict=True):
                if not len(s) or doc is None or digest in seen:  # an equal set speaks for it
                    continue
                seen.add(digest)
                k = rule.prefix(len(s))
                at = np.searchsorted(heavy_set, s)
                at[at == len(heavy_set)] = 0
                hot = heavy_set[at] == s if len(heavy_set) else np.zeros(len(s), bool)
                cold = s[~hot][:k]
                packs_t.append(cold)
                packs_d.append(np.full(len(cold), doc, np.int64))
                held += len(cold)
                if len(cold) < k:
                    warm = s[hot][np.argsort(heavy_rank[at[hot]])][: k - len(cold)]
                    hot_t.append(warm)
                    hot_d.append(np.full(len(warm), doc, np.int64))
            if hot_t:
                docs_, tokens_ = np.concatenate(hot_d), np.concatenate(hot_t).view(np.int64)
                yield rows(len(docs_), doc_id=docs_, token=tokens_)
            if len(seen) > 1 << 16:
                seen = set()
            if held > _STEP:
                yield flush(packs_t, packs_d)
                held, packs_t, packs_d = 0, [], []
        if held:
            yield flush(packs_t, packs_d)

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURES)


def _shared(packs: pa.Table) -> pa.Table:
    """The (token, doc) rows of one range of tokens whose token has more than one document."""
    t = np.concatenate([np.cumsum(_unsqueeze(x, np.uint64)) for x in packs.column("tokens").to_pylist()])
    d = np.concatenate([_unsqueeze(x, np.int64) for x in packs.column("docs").to_pylist()])
    by = np.argsort(t)
    t, d = t[by], d[by]
    same = t[1:] == t[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    t, d = t[keep], d[keep]
    by = np.lexsort((d, t))
    t, d = t[by], d[by]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])[: len(t)]
    return pa.Table.from_batches([table_of("token long, doc long", (t[new].view(np.int64), d[new]))])


def _width(n: int) -> int:
    return 1 << min(18, max(8, (4 * n - 1).bit_length()))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each token; the width is four to eight times the size of the set."""
    width = _width(len(s))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = bits >> width | bits & ((1 << width) - 1)
    return bits


def can_link(rule: Rule, a: tuple[int, int, int], b: tuple[int, int, int]) -> bool:
    """Whether two sets (size, width, bitmap) may reach the threshold: their largest possible overlap."""
    width = min(a[1], b[1])
    x, y = _fold(a[2], a[1], width), _fold(b[2], b[1], width)
    least = rule.least_overlap(a[0], b[0])
    return a[0] - (x & ~y).bit_count() >= least and b[0] - (y & ~x).bit_count() >= least


class Node:
    """A node of a signature tree over sets (id, size, width, bitmap, component, block)."""

    __slots__ = ("low", "high", "any", "all", "component", "children", "rows")

    def __init__(self, rows: list[tuple], children: list[Node]):
        self.rows, self.children = rows, children
        if children:
            self.low, self.high = min(c.low for c in children), max(c.high for c in children)
            ors, ands, names = [c.any for c in children], [c.all for c in children], {c.component for c in children}
        else:
            self.low, self.high = min(r[1] for r in rows), max(r[1] for r in rows)
            ors = ands = [r[3] for r in rows]
            names = {r[4] for r in rows}
        self.any, self.all = 0, -1
        for x, y in zip(ors, ands, strict=True):
            self.any |= x
            self.all &= y
        self.component = names.pop() if len(names) == 1 else None


def build_tree(rows: list[tuple]) -> Node:
    """Leaves of ``LEAF`` sets that are alike by component and size, and nodes of as many below the root."""
    rows = sorted(rows, key=lambda r: (r[4], r[1], r[3]))
    level = [Node(rows[k : k + LEAF], []) for k in range(0, len(rows), LEAF)]
    while len(level) > 1:
        level = [Node([], level[k : k + LEAF]) for k in range(0, len(level), LEAF)]
    return level[0]


def traverse(rule: Rule, a: Node, b: Node) -> Iterator[tuple[int, int]]:
    """Pairs of ids of different components that may link; ``a is b`` joins a tree with itself."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.component is not None and x.component == y.component:
            continue
        if rule.den * x.high < rule.num * y.low or rule.den * y.high < rule.num * x.low:
            continue
        least = rule.least_overlap(x.low, y.low)
        if x is not y and min(x.high - (x.all & ~y.any).bit_count(), y.high - (y.all & ~x.any).bit_count()) < least:
            continue
        if x.children and y.children:
            if x is y:
                stack += [(p, q) for k, p in enumerate(x.children) for q in x.children[k:]]
            else:
                stack += [(p, q) for p in x.children for q in y.children]
        elif x.children:
            stack += [(p, y) for p in x.children]
        elif y.children:
            stack += [(x, q) for q in y.children]
        else:
            for i, p in enumerate(x.rows):
                for q in x.rows[i + 1 :] if x is y else y.rows:
                    if p[4] != q[4] and can_link(rule, (p[1], p[2], p[3]), (q[1], q[2], q[3])):
                        yield p[0], q[0]


def tree_join(rule: Rule, rows: list[tuple], cross: bool) -> set[tuple[int, int]]:
    """All pairs that may link, by trees of one bitmap width each and of two widths folded to the lesser.

    Rows are (id, size, width, bitmap, component, block); with ``cross`` only pairs of different blocks count. Two
    widths meet if the least set of the greater and the largest of the lesser may link.
    """
    out: set[tuple[int, int]] = set()
    by: dict[tuple, list[tuple]] = {}
    for r in rows:
        by.setdefault((r[2], r[5] if cross else None), []).append(r)

    def tree(some: list[tuple], to: int) -> Node:
        return build_tree([(r[0], r[1], to, _fold(r[3], r[2], to), r[4]) for r in some])

    for (w, side), some in by.items():
        mine = tree(some, w)
        for (w2, side2), others in by.items():
            if w2 < w or (cross and (side == side2 or (w2 == w and side > side2))):
                continue
            if rule.den * max(r[1] for r in some) < rule.num * min(r[1] for r in others):
                continue
            theirs = mine if others is some else tree(others, w)
            out.update((min(p, q), max(p, q)) for p, q in traverse(rule, mine, theirs) if p != q)
    return out


def few_join(rule: Rule, rows: list[tuple], cross: bool) -> set[tuple[int, int]]:
    """The same for a few sets, pair by pair in order of size."""
    out, rows = set(), sorted(rows, key=lambda r: r[1])
    for k, x in enumerate(rows):
        for y in rows[k + 1 :]:
            if rule.den * x[1] < rule.num * y[1]:
                break
            if x[4] != y[4] and not (cross and x[5] == y[5]) and x[0] != y[0] and can_link(rule, x[1:4], y[1:4]):
                out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


def _verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b) those whose whole sets link."""
    one = sets.select(F.col("doc").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(rule.den * same >= rule.num * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, PAIRS)


def _may_link(pairs: DataFrame, light: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b) those that size and bitmap (doc, n, bits) allow."""
    size = light.select("doc", "n")
    sized = pairs.join(size.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    sized = sized.join(size.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").filter(
        rule.den * F.least("na", "nb") >= rule.num * F.greatest("na", "nb")
    )
    bits = light.select("doc", "bits")
    sized = sized.join(bits.select(F.col("doc").alias("b"), F.col("bits").alias("xb")), "b")
    sized = sized.join(bits.select(F.col("doc").alias("a"), F.col("bits").alias("xa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            columns = (t.column(c).to_pylist() for c in ("na", "xa", "nb", "xb"))
            keep = [
                can_link(rule, (na, 8 * len(xa), int.from_bytes(xa, "little")), (nb, 8 * len(xb), int.from_bytes(xb, "little")))
                for na, xa, nb, xb in zip(*columns, strict=True)
            ]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.select("a", "b", "na", "xa", "nb", "xb").mapInArrow(run, PAIRS)


def jaccard_components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    rule = rule or Rule()
    spark = docs.sparkSession
    shared_folder(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    *heavy, total = heavy_tokens(docs, rule)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Intermediate tables are written in a number of files that goes with the corpus, not with the width of exchanges.
    files = max(spark.sparkContext.defaultParallelism, total >> 20)
    ranges = max(width, rule.prefix(total) // _STEP)
    sig = stage(signatures(docs, rule, tuple(heavy), ranges), "signatures")

    # A set's documents are dealt to SALTS parts: the rows of a large group of copies meet in no single task.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    base = sig.filter(F.col("n").isNotNull()).select("doc_id", "n", "s1", "s2", salt.alias("salt"))
    dealt = base.filter(F.col("n") > 0).groupBy("s1", "s2", "salt").agg(F.min("doc_id").alias("low"))
    reps = dealt.groupBy("s1", "s2").agg(F.min("low").alias("rep"))
    dealt = dealt.join(reps, ["s1", "s2"]).select("s1", "s2", "salt", "rep")
    named = base.join(dealt, ["s1", "s2", "salt"], "left").select(
        "doc_id", "n", "salt", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")
    )

    packs = sig.filter(F.col("part").isNotNull()).select("part", "tokens", "docs")
    shared = packs.groupBy("part").applyInArrow(_shared, "token long, doc long")
    hot = sig.filter(F.col("token").isNotNull()).select("token", F.col("doc_id").alias("doc"))
    copies = named.filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("doc"), "rep").distinct()
    buckets = shared.unionByName(hot).join(copies, "doc", "left").select("token", F.coalesce("rep", "doc").alias("doc"))
    buckets = stage(buckets.distinct().coalesce(files), "buckets")
    tidy(spark)

    light = sig.filter(F.col("n") > 0).select(F.col("doc_id").alias("doc"), "n", "bits")
    hubs = buckets.groupBy("token").agg(F.min("doc").alias("a"), F.max("doc").alias("last")).filter("a != last").select("token", "a")
    stars = buckets.join(hubs, "token").filter(F.col("doc") != F.col("a")).select("a", F.col("doc").alias("b")).distinct()
    stars = _may_link(stars, light, rule).coalesce(files).checkpoint()
    tidy(spark)
    # Components as they would be if all these links held: what else may link is looked for between them.
    rest = _tree_pairs(buckets, connected_components(stars, files), light, rule, files)
    pairs = stars.unionByName(rest).distinct().coalesce(files).checkpoint()
    tidy(spark)
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = shingle_sets(*utf8(b.column("text")), rule.n)
            yield table_of("doc long, items binary", (b.column("doc_id"), [s.tobytes() for s in sets]))

    texts = docs.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text")
    sets = stage(texts.mapInArrow(make_sets, "doc long, items binary").coalesce(files), "sets")
    tidy(spark)
    links = _verify(pairs, sets, rule).coalesce(files).checkpoint()
    tidy(spark)
    names = connected_components(links, files)
    # Links that did not hold may have hidden others between their sides, all of them among these documents.
    known = buckets.join(sets.select("doc").distinct(), "doc", "left_semi")
    more = _verify(_tree_pairs(known, names, light, rule, files).join(pairs, ["a", "b"], "left_anti"), sets, rule)
    more = more.coalesce(files).checkpoint()
    if not more.isEmpty():
        names = connected_components(links.unionByName(more), files)
    names = dealt.select("rep", "salt").distinct().join(names.withColumnRenamed("id", "rep"), "rep")
    out = named.join(names, ["rep", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _tree_pairs(buckets: DataFrame, names: DataFrame, light: DataFrame, rule: Rule, files: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a bucket and may link, found by signature trees."""
    rows = buckets.join(names.withColumnRenamed("id", "doc"), "doc", "left").select(
        "token", "doc", F.coalesce("component", "doc").alias("component")
    )
    mixed = rows.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.expr("sum(cast(xxhash64(doc) as decimal(38,0)))").alias("h1"),
        F.expr("sum(cast(xxhash64(doc, 1) as decimal(38,0)))").alias("h2"),
    ).filter("low != high")
    # Buckets with the same documents are joined once.
    once = mixed.groupBy("n", "h1", "h2").agg(F.min("token").alias("token"))
    blocks = once.select("token", "n", F.ceil(F.col("n") / TREE).cast("int").alias("blocks")).coalesce(files).checkpoint()
    total = blocks.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    bins = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // GROUPED)
    members = rows.join(blocks.drop("n"), "token").withColumn("block", F.expr("cast(pmod(xxhash64(doc), blocks) as int)"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "component"
    ).join(light.select("doc", "n"), "doc")
    # Who has no neighbour of a like size in its group has no partner there.
    w = Window.partitionBy("token", "i", "j").orderBy("n", "doc")
    below = rule.num * F.col("n") <= rule.den * F.lag("n").over(w)
    above = rule.num * F.lead("n").over(w) <= rule.den * F.col("n")
    members = members.withColumn("like", F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False)))
    members = members.filter("like").drop("like").join(light.select("doc", "bits"), "doc")
    members = members.withColumn("bin", F.pmod(F.xxhash64("token", "i", "j"), F.lit(bins)))

    def run(group: pa.Table) -> pa.Table:
        """Many small groups (token, i, j) at a time."""
        t, i, j = (group.column(c).to_numpy() for c in ("token", "i", "j"))
        by = np.lexsort((j, i, t))
        new = (np.diff(t[by]) != 0) | (np.diff(i[by]) != 0) | (np.diff(j[by]) != 0)
        cuts = np.flatnonzero(np.concatenate([[True], new])).tolist()
        docs, sizes, names, sides = (group.column(c).to_pylist() for c in ("doc", "n", "component", "block"))
        known: dict[int, tuple[int, int]] = {}
        for d, x in zip(docs, group.column("bits"), strict=True):
            if d not in known:
                x = x.as_py()
                known[d] = (8 * len(x), int.from_bytes(x, "little"))
        cross, by, pairs = (i != j).tolist(), by.tolist(), set()
        for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
            some = [(docs[k], sizes[k], *known[docs[k]], names[k], sides[k]) for k in by[a:b]]
            pairs |= tree_join(rule, some, cross[by[a]]) if len(some) > 3 * LEAF else few_join(rule, some, cross[by[a]])
        return pa.Table.from_batches([table_of(PAIRS, zip(*sorted(pairs), strict=True) if pairs else [[], []])])

    return members.groupBy("bin").applyInArrow(run, PAIRS).distinct()


def drop_near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents (all columns) that are the least of their component; rows without id stay."""
    found = jaccard_components(docs, rule)
    extra = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti")
