"""Removal of repeated passages with suffix order over a difference cover.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. The work is dealt out so
that equal strings meet and little else moves:

1. Rows with equal texts are one candidate, named by their least id. A copy is all repeated if it has 50 bytes.
2. Each 50-byte window has an anchor: its least hashed 20-byte string, the leftmost on ties. Equal windows have equal
   anchors. Anchors of at least two documents are found from packed (anchor, document) lists by ranges of anchors.
3. Windows of neighbouring starts with one anchor make a segment of at most 80 bytes. Segments at shared anchors go
   to the bucket of their anchor; of equal segments in a batch only the least document's go, the others are repeated
   for certain. So a passage of many documents sends one segment for each batch.
4. In a bucket the distinct segments are one text (an anchor's only segment needs no order). Its suffixes are ordered
   by the difference-cover algorithm (see ``suffixes``), neighbours' 50-byte prefixes are compared, and of each class
   of equal windows those of documents above the least one are repeated.
5. A document's repeated windows are united to spans and cut out where the document is read.

So the order over the difference cover is one of a bucket's segments in one task, not of all the corpus's suffixes
over keyed exchanges: those would move every suffix several times (see the README).

Defined results: null texts count as empty; texts of fewer than 50 bytes are kept; rows without id are kept and
remove nothing; rows with one id remove nothing from one another, and each keeps its own spans (their texts lie one
after the other in one count of positions); an empty table gives an empty result; extra columns are ignored; texts
of any length are taken whole, in stripes of bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .batches import parts, table_of, utf8
from .suffixes import equal_prefixes

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1
#: Window starts handled at a time, and anchors or segments of one sorted pack.
STRIPE, PACKED, SENT = 1 << 16, 1 << 18, 1 << 16
ANCHORS = "kind int, bucket int, data binary, more binary"
PAIRS = "bucket int, docs binary, data binary"
SEGMENTS = "kind int, bucket int, doc_id long, data binary, more binary, third binary"
LISTS = "doc_id long, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_LOW = np.uint64((1 << 28) - 1)
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(17)]
_WRITER, _READER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of each 20-byte string."""
    h = _TABLE[data]
    for k in (1, 2):
        h = h[:-k] * _R[k] + h[k:]
    four = h
    for k in (4, 8):
        h = h[:-k] * _R[k] + h[k:]
    h = h[: len(four) - 16] * _R[4] + four[16:]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts that lie end to end in ``data`` (row k from ends[k] to ends[k + 1]).

    For each run: the anchor's 48-bit hash, the row, the first window's start in ``data`` and the last one's.
    """
    hashes, rows, firsts, lasts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    upto = ends[1:] - WINDOW  # a row's last window start
    for at in range(0, len(data) - WINDOW + 1, STRIPE):
        n = min(STRIPE, len(data) - WINDOW + 1 - at)
        g = _grams(data[at : at + n + WINDOW - 1])
        m = g & ~_LOW | np.arange(len(g), dtype=np.uint64)
        for k in (1, 2, 4, 8, SPAN - 16):
            m = np.minimum(m[:-k], m[k:])
        anchor = (m & _LOW).astype(np.int64)
        a, b = np.searchsorted(ends, at, "right") - 1, np.searchsorted(ends, at + n, "left")
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        inner = ends[a + 1 : b] - at
        new[inner[inner < n]] = True
        first = np.flatnonzero(new)
        row = np.searchsorted(ends, first + at, "right") - 1
        last = np.minimum(np.append(first[1:], n) - 1 + at, upto[row])
        keep = first + at <= last
        hashes.append((g[anchor[first[keep]]] >> np.uint64(16)).astype(np.int64))
        rows.append(row[keep])
        firsts.append(first[keep] + at)
        lasts.append(last[keep])
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(firsts), np.concatenate(lasts)


def _squeeze(x: bytes) -> bytes:
    return _WRITER.compress(x)


def _planes(x: np.ndarray) -> bytes:
    return _squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_READER.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.int64)


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> 16) * n >> 32).astype(np.int32)


def _cuts(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """The runs of equal values."""
    at = _firsts(x)
    return zip(at.tolist(), [*at[1:].tolist(), len(x)], strict=True) if len(x) else iter(())


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _of_two(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs by hash, where each hash begins, its least document, and which pairs' hash has another document."""
    by = np.argsort(h)
    h, d = h[by], d[by]
    first = _firsts(h)
    low = np.minimum.reduceat(d, first)
    many = np.repeat(low != np.maximum.reduceat(d, first), np.diff(np.append(first, len(h))))
    return h, d, first, low, many


def _dealt(docs: np.ndarray, values: np.ndarray, n: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Pairs (document, value) packed by a bucket of the documents; a long pack in several."""
    bucket = docs % n
    by = np.argsort(bucket, kind="stable")
    bucket, docs, values = bucket[by], docs[by], values[by]
    for a, b in _cuts(bucket):
        for k in range(a, b, 1 << 16):
            yield int(bucket[a]), _planes(docs[k : min(b, k + (1 << 16))]), _planes(values[k : min(b, k + (1 << 16))])


def _anchors(buckets: int):
    """Kind 0: a bucket's anchors (data) with documents (more). Kind 1: documents (more) and anchors that are shared for certain."""

    def flush(hs: list, ds: list) -> Iterator[pa.RecordBatch]:
        h, d, first, low, sure = _of_two(np.concatenate(hs), np.concatenate(ds))
        once = h[first]
        bucket = _bucket(once, buckets)
        rows = [(0, int(bucket[a]), _planes(np.diff(once[a:b], prepend=0)), _planes(low[a:b])) for a, b in _cuts(bucket)]
        # Anchors of two or more documents of this batch.
        rows += [(1, at, data, more) for at, more, data in _dealt(d[sure], h[sure], buckets)]
        yield table_of(ANCHORS, zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, held = [], [], 0
        for b in parts(batches):
            h, row, _, _ = segments(*utf8(b.column("text")))
            if len(h):
                hs.append(h)
                ds.append(b.column("doc_id").to_numpy()[row])
                held += len(h)
            if held > PACKED:
                yield from flush(hs, ds)
                hs, ds, held = [], [], 0
        if held:
            yield from flush(hs, ds)

    return run


def _shared(buckets: int):
    """The anchors of one bucket that two documents have, dealt by buckets of the documents."""

    def run(group: pa.Table) -> pa.Table:
        out, hs, ds = [], [], []
        for kind, at, data, more in zip(*(group.column(c).to_pylist() for c in ("kind", "bucket", "data", "more")), strict=True):
            if kind:
                out.append((at, more, data))
            else:
                hs.append(np.cumsum(_unplanes(data)))
                ds.append(_unplanes(more))
        if hs:
            h, d, _, _, keep = _of_two(np.concatenate(hs), np.concatenate(ds))
            out += _dealt(d[keep], h[keep], buckets)
        return pa.Table.from_batches([table_of(PAIRS, zip(*out, strict=True) if out else [[]] * 3)])

    return run


def _by_document(group: pa.Table) -> pa.Table:
    """Each document's shared anchors, in packs of bounded size."""
    d = np.concatenate([_unplanes(x) for x in group.column("docs").to_pylist()])
    h = np.concatenate([_unplanes(x) for x in group.column("data").to_pylist()])
    by = np.argsort(d, kind="stable")
    d, h = d[by], h[by]
    out = [(int(d[a]), h[k : min(b, k + (1 << 16))].tobytes()) for a, b in _cuts(d) for k in range(a, b, 1 << 16)]
    return pa.Table.from_batches([table_of(LISTS, zip(*out, strict=True))])


def _send(buckets: int):
    """Kind 2: segments of a bucket (documents and starts, lengths, text). Kind 3: spans of a document that are repeated for certain."""

    def flush(held: list[np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        place = np.concatenate(held, 1)  # documents, starts, anchors
        by = np.argsort(place[0], kind="stable")
        place, texts, seen = place[:, by], [texts[k] for k in by.tolist()], {}
        sizes = np.array([len(x) for x in texts], np.int64)
        least = np.array([seen.setdefault(x, d) for x, d in zip(texts, place[0].tolist(), strict=True)], np.int64)
        sure = least < place[0]
        rows = [(3, d % buckets, d, x, None, None) for d, x in _spans(place[0, sure], place[1, sure], (place[1] + sizes)[sure])]
        sent = np.flatnonzero(~sure)
        bucket = _bucket(place[2, sent], buckets)
        by = np.argsort(bucket, kind="stable")
        bucket, sent = bucket[by], sent[by]
        for a, b in _cuts(bucket):
            some = sent[a:b]
            text = _squeeze(b"".join([texts[k] for k in some.tolist()]))
            rows.append((2, int(bucket[a]), None, _planes(place[:, some].reshape(-1)), sizes[some].astype(np.uint8).tobytes(), text))
        yield table_of(SEGMENTS, zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        texts: list[bytes] = []
        for b in parts(batches):
            data, ends = utf8(b.column("text"))
            h, row, first, last = segments(data, ends)
            lists = [[np.frombuffer(x, np.int64) for x in some] for some in b.column("shared").to_pylist()]
            known = [np.concatenate(x) | k << 48 for k, x in enumerate(lists)]
            keep = np.flatnonzero(np.isin(h | row << 48, np.concatenate(known)))
            row, first, last = row[keep], first[keep], last[keep]
            starts = first - ends[row] + b.column("base").to_numpy()[row]
            place, stops, text = np.array([b.column("doc_id").to_numpy()[row], starts, h[keep]]), last + WINDOW, data.tobytes()
            for k in range(0, len(keep), SENT):
                held.append(place[:, k : k + SENT])
                texts += [text[i:j] for i, j in zip(first[k : k + SENT].tolist(), stops[k : k + SENT].tolist(), strict=True)]
                if len(texts) >= SENT:
                    yield from flush(held, texts)
                    held, texts = [], []
        if texts:
            yield from flush(held, texts)

    return run


def repeated_spans(
    docs: np.ndarray, starts: np.ndarray, anchors: np.ndarray, texts: list[bytes]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, start, end) of the windows in the segments whose string a smaller document has as well.

    Equal windows have equal anchors, so the windows of an anchor's only segment are all its own; the distinct
    segments of other anchors are put in suffix order together.
    """
    index: dict[bytes, int] = {}
    which = np.array([index.setdefault(p, len(index)) for p in texts], np.int64)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    anchor = np.empty(len(index), np.int64)
    anchor[which] = anchors
    _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
    alone = size[group] == 1
    sizes = np.array([len(p) for p in index], np.int64)
    whole = docs > least[which]  # the very segment is a smaller document's
    out = [(docs[whole], starts[whole], (starts + sizes[which])[whole])]
    open_ = np.flatnonzero(~whole & ~alone[which])
    if len(open_):
        some = np.flatnonzero(~alone)
        text = np.frombuffer(b"".join(p for p, x in zip(index, alone, strict=True) if not x), np.uint8)
        at, n = np.cumsum(sizes[some]) - sizes[some], sizes[some] - WINDOW + 1
        base = np.cumsum(n) - n
        owner = np.repeat(some, n)
        within = np.arange(n.sum()) - np.repeat(base, n)
        classes = equal_prefixes(text, np.repeat(at, n) + within, WINDOW)
        del text, within
        limit = np.full(classes.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(limit, classes, least[owner])
        limit = limit[classes]  # for each window of a distinct segment, the least document that has its string
        place = np.empty(len(index), np.int64)
        place[some] = np.arange(len(some))
        mine = place[which[open_]]
        n = n[mine]
        owner = np.repeat(open_, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = docs[owner] > limit[np.repeat(base[mine], n) + within]
        at = (starts[owner] + within)[hit]
        out.append((docs[owner[hit]], at, at + WINDOW))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def unite_all(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching half-open spans of a document as one, by document and start."""
    if not len(docs):
        return docs, starts, ends
    by = np.lexsort((starts, docs))
    docs, starts, ends = docs[by], starts[by], ends[by]
    new = np.concatenate([[True], docs[1:] != docs[:-1]])
    step = np.cumsum(new) * (int(ends.max()) + 1)
    upto = np.maximum.accumulate(ends + step) - step
    new[1:] |= starts[1:] > upto[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(docs) - 1)
    return docs[new], starts[new], upto[last]


def unite(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching half-open spans as one."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def _spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Each document's united spans, packed."""
    d, x, y = unite_all(docs, starts, ends)
    both = np.column_stack([x, y])
    for a, b in _cuts(d):
        yield int(d[a]), both[a:b].tobytes()


def _judge(group: pa.Table) -> pa.Table:
    """Spans of documents (doc_id, data) from a bucket's segments; spans that are certain pass through."""
    out, places, texts = [], [], []
    columns = (group.column(c).to_pylist() for c in ("kind", "doc_id", "data", "more", "third"))
    for kind, doc, data, more, third in zip(*columns, strict=True):
        if kind == 3:
            out.append((doc, data))
        else:
            places.append(_unplanes(data).reshape(3, -1))
            stops = np.cumsum(np.frombuffer(more, np.uint8).astype(np.int64)).tolist()
            text = _READER.decompress(third)
            texts += [text[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
    if places:
        docs, starts, anchors = np.concatenate(places, 1)
        out += _spans(*repeated_spans(docs, starts, anchors, texts))
    return pa.Table.from_batches([table_of(LISTS, zip(*out, strict=True) if out else [[], []])])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        rows = []
        data, ends = utf8(b.column("text"))
        text = memoryview(data)
        columns = (b.column(c).to_pylist() for c in ("doc_id", "base", "spans"))
        for doc, base, spans, a, z in zip(*columns, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            kept, removed, n, at = hashlib.sha256(), 0, 0, a
            if spans:
                both = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in spans]) + (a - base)
                both = np.clip(both, a, z)  # texts of one id lie end to end; a row takes its own part
                both = both[both[:, 0] < both[:, 1]]
                for x, y in zip(*(v.tolist() for v in unite(both[:, 0], both[:, 1])), strict=True):
                    kept.update(text[at:x])
                    removed, n, at = removed + y - x, n + 1, y
            kept.update(text[at:z])
            rows.append((doc, z - a, removed, n, kept.hexdigest()))
        yield table_of(RESULT, zip(*rows, strict=True))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    # A cast that does nothing would leave an alias in one plan and not in another, and cost the exchange's reuse.
    ident = F.col("doc_id") if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(ident, F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, buckets = max(width, total >> 23), max(width, total >> 19)

    keyed = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    least = keyed.groupBy("sha").agg(F.min("doc_id").alias("least"), F.first("n_bytes").alias("size"))
    named = keyed.join(least.select("sha", "least"), "sha")
    is_copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    copies = named.filter(is_copy).select(
        "doc_id", "n_bytes",
        F.when(F.col("n_bytes") >= WINDOW, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("n_bytes") >= WINDOW, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(F.col("n_bytes") >= WINDOW, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    # The different texts of one id lie end to end: base is where a text begins.
    before = Window.partitionBy("doc_id").orderBy("want").rowsBetween(Window.unboundedPreceding, -1)
    firsts = least.filter(F.col("least").isNotNull()).select(F.col("least").alias("doc_id"), F.col("sha").alias("want"), "size")
    firsts = firsts.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    # The texts move once, by id; the later joins on the id use the same exchange again.
    single = docs.join(firsts.hint("shuffle_hash"), "doc_id")
    # Not written as an equality, which would become part of the join's key and of the exchange.
    single = single.filter(F.instr(F.col("want"), F.sha2("text", 256)) == 1).select("doc_id", "text", "base")

    anchors = single.select("doc_id", "text").mapInArrow(_anchors(ranges), ANCHORS)
    dealt = anchors.groupBy("bucket").applyInArrow(_shared(ranges), PAIRS)
    shared = dealt.groupBy("bucket").applyInArrow(_by_document, LISTS).groupBy("doc_id").agg(F.collect_list("data").alias("shared"))
    sent = single.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "base", "shared")
    spans = sent.mapInArrow(_send(buckets), SEGMENTS).groupBy("bucket").applyInArrow(_judge, LISTS)
    spans = spans.groupBy("doc_id").agg(F.collect_list("data").alias("spans"))
    rest = single.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "base", "spans")
    none = docs.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", F.lit(0).cast("long").alias("base"), F.lit(None).cast("array<binary>").alias("spans")
    )
    return rest.unionByName(none).mapInArrow(_cut_out, RESULT).unionByName(copies)
