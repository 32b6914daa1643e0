"""Mixing sources to target weights, in blocks of words.

The words of a source, in a fixed order of its documents, are packed into blocks of ``BLOCK`` words. For each output
shard the number of blocks from each source is drawn from a multinomial distribution with the target shares; the
draws are then balanced over the shards so that each source's total is its target. A source's slots are numbered
over all shards and mapped to its blocks by a keyed permutation of the indices, one for each pass over the source,
so no block is taken a second time before all were taken once. Blocks join the slots by index, and documents the
blocks that they overlap.

No source is handled by one task: its documents are dealt into chunks by a hash, at least ``CHUNKS`` and one for every
``CHUNK_ROWS`` documents of the corpus, and prefix sums are taken in a chunk and over the chunks. The driver sees one row for each source.

Defined results: null texts have size 0; documents of size 0 are never taken; sources are ordered by code point
with null last; repeated rows are documents of their own; an empty table gives an empty result; extra columns are
ignored. The same input and seed give the same mix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .batches import parts, table_of

BLOCK, CHUNKS, SHARDS, MOST = 64, 512, 64, 3
CHUNK_ROWS = 1 << 16
SHARD_WORDS = 1 << 24
WEIGHTS = [5, 2, 1]
SLOTS = "rank int, shard int, slot long, block long"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Share the total of ``sizes`` by weight; who would get over ``most`` times its size stops there."""
    got, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        total = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / total > most * sizes[k]}
        if not over:
            for k in open_:
                got[k] = left * weights[k] / total
            break
        for k in over:
            got[k] = float(most * sizes[k])
        left -= sum(got[k] for k in over)
        open_ -= over
    return got


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (row) in each shard (column): multinomial draws, balanced to give ``slots`` in all."""
    total = sum(slots)
    each = np.array([total * (k + 1) // shards - total * k // shards for k in range(shards)])
    if not total:
        return np.zeros((len(slots), shards), np.int64)
    counts = np.random.default_rng(seed).multinomial(each, np.array(slots) / total).T.astype(np.int64)
    excess = counts.sum(1) - np.array(slots)
    for k in range(shards):  # move what is over to what is short, shard by shard
        give = np.minimum(np.maximum(excess, 0), counts[:, k])
        take = np.maximum(-excess, 0)
        n = min(give.sum(), take.sum())
        for side, sign in ((give, -1), (take, 1)):
            used = np.diff(np.minimum(np.cumsum(np.concatenate([[0], side])), n))
            counts[:, k] += sign * used
            excess += sign * used
    return counts


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutations of 0..n-1: a Feistel network on the next even number of bits, walked back into range."""
    x, n, key = (np.asarray(v).astype(np.uint64) for v in (x, n, key))
    half = np.ones(len(x), np.uint64)
    while (small := np.left_shift(np.uint64(1), 2 * half) < n).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            f = (right + k + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(source: str | None, turn: int, seed: int) -> int:
    data = f"{seed}:{turn}:".encode() + (b"-" if source is None else b"+" + source.encode("utf-8", "surrogatepass"))
    return int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "little")


@dataclass
class Mix:
    """sources: source, rank, source_size, target. docs: rank, doc_id, size, start. slots: shard, slot, rank, block."""

    sources: DataFrame
    docs: DataFrame
    slots: DataFrame
    block: int


def plan(
    docs: DataFrame,
    *,
    block: int = BLOCK,
    chunks: int = CHUNKS,
    shards: int = SHARDS,
    seed: int = 11,
    weights: list[float] | None = None,
) -> Mix:
    """Plan a mix of ``docs`` (doc_id, source, size); ``shards`` is the least number of output shards.

    A column ``row`` of ``docs``, if there is one, orders rows with one id and size and is kept in the plan's ``docs``.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    weights = weights or WEIGHTS
    row = [c for c in docs.columns if c == "row"]
    sized = docs.select("doc_id", "source", F.col("size").cast("long").alias("size"), *row).checkpoint()
    chunks = max(chunks, sized.count() // CHUNK_ROWS)
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)).cast("int"))
    sums = sized.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    found = sums.groupBy("source").agg(F.sum("words").alias("n")).collect()  # one row for each source
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["n"]) for r in found]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))])
    blocks = [-(-n // block) for n in sizes]
    slots = [min(MOST * b, round(t / n * b)) if n else 0 for n, t, b in zip(sizes, goal, blocks, strict=True)]
    shards = max(shards, sum(sizes) // SHARD_WORDS)
    counts = draw(slots, shards, seed)
    names = [r["source"] for r in found]
    sources = spark.createDataFrame(
        [(s, k, n, float(t)) for k, (s, n, t) in enumerate(zip(names, sizes, goal, strict=True))],
        "source string, rank int, source_size long, target double",
    )
    total = Window.partitionBy("source").orderBy("chunk")
    before = sums.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), (F.sum("words").over(total) - F.col("words")).alias("before")
    )
    inner = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("upto", F.sum("size").over(inner))
        .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        .select("doc_id", "source", "size", *row, (F.col("before") + F.col("upto") - F.col("size")).alias("start"))
    )
    # Slots are numbered in a source over all shards; each pair of source and shard is filled on the executors.
    ends = np.cumsum(counts, 1)
    seeds = [[_key(s, turn, seed) for turn in range(MOST)] for s in names]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rank, shard in (divmod(k, shards) for k in b.column("id").to_pylist()):
                n = int(counts[rank, shard])
                first = int(ends[rank, shard]) - n
                for at in range(first, first + n, 1 << 16):
                    slot = np.arange(at, min(first + n, at + (1 << 16)))
                    key = np.array(seeds[rank], np.uint64)[slot // blocks[rank]]
                    got = permute(slot % blocks[rank], np.full(len(slot), blocks[rank]), key)
                    yield table_of(SLOTS, (np.full(len(slot), rank), np.full(len(slot), shard), slot, got))

    pairs = len(names) * shards
    tasks = max(1, min(pairs, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    filled = spark.range(0, pairs, 1, tasks).mapInArrow(fill, SLOTS)
    return Mix(sources, placed, filled, block)


def taken_words(mix: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    block = mix.block
    docs = mix.docs.join(mix.sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    times = mix.slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    spread = docs.filter(F.col("size") > 0).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    keys = ["rank", "start", "doc_id", "size", "source_size", "target"]
    # The slots come from a small table of counts; without the hint their size is taken for that table's.
    joined = spread.select(*keys, "block", (high - low).alias("overlap")).join(times.hint("merge"), ["rank", "block"], "left")
    taken = joined.groupBy(*keys).agg(F.coalesce(F.sum(F.col("overlap") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    none = docs.filter(F.col("size") == 0).select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).drop("rank", "start")


def _parts_of(text: str, spans: list[tuple[int, int, int]]) -> str | None:
    """The text's taken words: pass by pass, slices of the text; None if nothing is taken."""
    most = max((t for _, _, t in spans), default=0)
    if not most:
        return None
    if all(t == most for _, _, t in spans):
        return "\n".join([text] * most)
    words = [m.span() for m in re.finditer(WORD, text)]
    out = []
    for turn in range(most):
        run: list[list[int]] = []
        for a, b, t in spans:
            if t > turn:
                if run and run[-1][1] == a:
                    run[-1][1] = b
                else:
                    run.append([a, b])
        out.append(" ".join(text[words[a][0] : words[b - 1][1]] for a, b in run))
    return "\n".join(out)


def mix_documents(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The documents (same columns, ``n_chars`` renewed) with the words that the mix takes, repeats on new lines.

    Documents of which nothing is taken go. Rows are told apart by all their columns, and equal rows are numbered, so
    each row takes the blocks of its own place.
    """
    columns = docs.columns
    mark = "_"
    while any(c.lower().startswith(mark) for c in columns):  # no name of ours is one of theirs
        mark += "_"
    key, size, nth, held = f"{mark}row", f"{mark}size", f"{mark}nth", f"{mark}spans"
    sized = docs.withColumn(key, F.xxhash64(*columns)).withColumn(size, word_count(F.col("text")))
    mix = plan(sized.select("doc_id", "source", F.col(size).alias("size"), F.col(key).alias("row")), block=block)
    names = mix.sources.select(F.col("source").alias("s"), "rank")
    placed = mix.docs.filter(F.col("size") > 0).join(names, F.col("source").eqNullSafe(F.col("s")))
    spread = placed.select("row", "size", "rank", "start").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    times = mix.slots.groupBy("rank", "block").agg(F.count("*").cast("int").alias("times"))
    low = F.greatest("start", F.col("block") * block) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")
    span = F.struct(low.cast("int").alias("a"), high.cast("int").alias("b"), F.coalesce("times", F.lit(0)).alias("t"))
    spans = spread.join(times.hint("merge"), ["rank", "block"], "left").groupBy("row", "size", "rank", "start").agg(
        F.sort_array(F.collect_list(span)).alias("spans")
    )
    # A place in a source is one row's; equal rows share a list of their places and take them by number.
    lists = spans.groupBy(F.col("row").alias(key), F.col("size").alias(size)).agg(
        F.sort_array(F.collect_list(F.struct("rank", "start", "spans"))).alias(held)
    )
    number = F.row_number().over(Window.partitionBy(key, size).orderBy(key))
    joined = sized.filter(F.col(size) > 0).withColumn(nth, number).join(lists, [key, size])
    joined = joined.withColumn(held, F.element_at(held, F.col(nth))["spans"]).filter(F.exists(held, lambda s: s["t"] > 0))
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            both = zip(b.column("text").to_pylist(), b.column(held).to_pylist(), strict=True)
            text = [_parts_of(t, [(s["a"], s["b"], s["t"]) for s in spans]) for t, spans in both]
            kept = [b.column(k) for k in range(len(columns))]
            kept[at] = pa.array(text, b.schema.field(at).type)
            yield pa.record_batch(kept, names=columns)

    out = joined.select(*columns, held).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out
