"""Token-id output with shuffled planes.

Documents are encoded, an end id is put after each, and their ids are written in ascending document order as
chunks. A chunk holds whole documents and their ids in blocks of ``BLOCK``; each block is transposed into byte or
bit planes (planes of zeros alone are left out), and each plane is compressed with zstandard. The chunk row is
its own index: the shard and place of the chunk, its documents with their offsets, and the planes' offsets.
Chunks are written as Parquet by Spark's committer into the shared folder, so a lost executor's task is simply
run again and any store that Spark can write works. A shard is one range of document ids; only the number of ids
of each shard is summed on the driver, to give each document its global start.

Defined results: null and empty texts have the end id alone; null document ids come first; rows with one id are
ordered by text; an empty table gives an empty dataset; extra columns are ignored; very long texts make a longer
chunk.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import struct
import threading
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage_path
from .batches import parts, table_of

BLOCK = 1 << 15
CHUNK_IDS = 1 << 20
END_ID = 2
CHUNK = (
    "shard int, chunk int, first long, n_ids long, doc_ids array<long>, doc_offsets array<long>, "
    "plane_offsets array<int>, planes binary"
)


def pack_block(ids: np.ndarray, unit: str = "byte") -> bytes:
    """One block as planes: count, unit, then for each plane its number, length and zstandard frame."""
    level = zstandard.ZstdCompressor(level=3)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        planes = [(k, raw[:, k]) for k in range(4)]
    else:
        bits = [np.unpackbits(raw[:, k], bitorder="little").reshape(-1, 8) for k in range(4) if raw[:, k].any()]
        planes = [(8 * k + j, np.packbits(b[:, j], bitorder="little")) for k, b in enumerate(bits) for j in range(8)]
        if any(not raw[:, k].any() and raw[:, k + 1 :].any() for k in range(3)):
            planes = [
                (8 * k + j, np.packbits(raw[:, k] >> j & 1, bitorder="little")) for k in range(4) for j in range(8)
            ]
    out = [struct.pack("<IB", len(ids), unit == "bit")]
    for k, plane in planes:
        if plane.any():
            frame = level.compress(plane.tobytes())
            out.append(struct.pack("<BI", k, len(frame)) + frame)
    return b"".join(out)


def unpack_block(data: bytes) -> np.ndarray:
    """The inverse of ``pack_block``."""
    n, bit = struct.unpack_from("<IB", data)
    raw, at, reader = np.zeros((n, 4), np.uint8), 5, zstandard.ZstdDecompressor()
    while at < len(data):
        k, size = struct.unpack_from("<BI", data, at)
        plane = np.frombuffer(reader.decompress(data[at + 5 : at + 5 + size]), np.uint8)
        if bit:
            raw[:, k // 8] |= np.unpackbits(plane, count=n, bitorder="little") << (k % 8)
        else:
            raw[:, k] = plane
        at += 5 + size
    return raw.reshape(-1).view("<u4")


#: Letters (which stay single letters when normalised) with signs behind them, where the tokenizer cuts.
_PARTED = r"^(?P<core>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)(?P<tail>[#$%&*!.,;:?|]*)$"
#: Python's and Arrow's white space that the tokenizer takes for signs.
_SEPARATORS = "[\x1c-\x1f]"
#: Seconds without a call after which a process lets its encoders go.
IDLE_S = 15
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file; its words outlive a task, but not a longer pause."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
        if len(_ENCODERS) == 1:
            threading.Thread(target=_let_go, daemon=True).start()
    return _ENCODERS[path]


def _let_go() -> None:
    """Wait until no encoder was called for some time, then free them: a worker's memory is the next tasks' as well."""
    while time.monotonic() - max(x.called for x in _ENCODERS.values()) < IDLE_S:
        time.sleep(IDLE_S / 3)
    _ENCODERS.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such call, the memory is kept for reuse
        ctypes.CDLL(None).malloc_trim(0)


def _by_words(path: str) -> bool:
    """Whether a vocabulary file makes tokens of lower-cased runs of letters, digits and runs of signs, one by one.

    Then no token spans white space, and letters and the signs behind them may be encoded apart.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rules = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if rules != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"]:
        return False
    pattern = cuts[0].get("pattern", {}).get("Regex", "")
    white = spec["normalizer"]["normalizers"][1]
    runs = [x for x in pattern.split("|") if not x.startswith("'")]
    return (
        (white.get("pattern"), white.get("content")) == ({"Regex": r"\s+"}, " ")
        and runs == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
        and (cuts[0].get("behavior"), cuts[0].get("invert")) == ("Removed", True)
        and not cuts[1].get("add_prefix_space")
        and not cuts[1].get("use_regex")
        and spec["model"].get("type") == "BPE"
        and bool(spec["model"].get("end_of_word_suffix"))
        and all("<" in x["content"] for x in spec.get("added_tokens", []))
    )


class WordEncoder:
    """A tokenizer with a store of its words, for files whose tokens never span white space; else it encodes whole texts.

    The store has two generations of at most ``most`` words each: words not met again are forgotten.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.by_words, self.called = _by_words(path), time.monotonic()
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.by_words:
            with open(path, encoding="utf-8") as f:
                suffix = json.load(f)["model"]["end_of_word_suffix"]
            self.ends[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True

    def _encode(self, words: list[str], plain: bool) -> list[bytes]:
        """The ids of each word: many words as one text. Plain ones are letters and have one end token each."""
        out = []
        for k in range(0, len(words), 5000):
            some = words[k : k + 5000]
            if plain:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(some):
                    return out + self._encode(words[k:], False)
                cuts = [0, *(4 * stops).tolist()]
            else:  # tokens are dealt back by their offsets
                starts = np.cumsum([0, *(len(w) + 1 for w in some)])
                e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
                ids = np.array(e.ids, "<u4")
                cuts = (4 * np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), starts)).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _ids(self, words: list[str], plain: bool) -> list[bytes]:
        """The ids of distinct words, from the store where it has them."""
        young = self.young
        found = [young.get(w) for w in words]
        missed = [k for k, x in enumerate(found) if x is None]
        new = []
        for k in missed:
            found[k] = x = self.old.get(words[k])
            if x is None:
                new.append(k)
        for k, x in zip(new, self._encode([words[k] for k in new], plain), strict=True):
            found[k] = x
        young.update([(words[k], found[k]) for k in missed])
        return found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (without null), and the n + 1 offsets of the texts in them."""
        self.called = time.monotonic()
        apart = bool(len(texts)) and pc.any(pc.match_substring_regex(texts, _SEPARATORS)).as_py()
        if not self.by_words or apart:
            made = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4") for x in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *made]), np.cumsum([0, *map(len, made)])
        words = pc.utf8_split_whitespace(texts)
        places = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        # A distinct word is letters and a tail where the tokenizer must cut there, else one piece.
        parted = pc.extract_regex(coded.dictionary, _PARTED)
        plain = parted.is_valid()
        cores = pc.utf8_lower(pc.struct_field(parted.filter(plain), "core")).dictionary_encode()
        others = pa.concat_arrays([
            coded.dictionary.filter(pc.invert(plain)), pc.struct_field(parted.filter(plain), "tail")
        ]).dictionary_encode()
        made = self._ids(cores.dictionary.to_pylist(), True) + self._ids(others.dictionary.to_pylist(), False) + [b""]
        plain, other = plain.to_numpy(zero_copy_only=False), others.indices.to_numpy() + len(cores.dictionary)
        pieces = np.full((len(plain), 2), len(made) - 1)
        pieces[plain, 0] = cores.indices.to_numpy()
        pieces[plain, 1] = other[len(plain) - plain.sum() :]
        pieces[~plain, 0] = other[: len(plain) - plain.sum()]
        store, sizes = np.frombuffer(b"".join(made), "<u4"), np.array([len(x) for x in made], np.int64) // 4
        ids, sizes = _gather(store, sizes, pieces.reshape(-1))
        ids, sizes = _gather(ids, sizes.reshape(-1, 2).sum(1), codes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        if len(self.young) > self.most:
            self.old, self.young = self.young, {"": b""}
        return ids, upto[places - places[0]]


def _gather(store: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items that lie end to end in ``store``, in the order ``which``, and the size of each."""
    starts, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
    stops = np.cumsum(n)
    total = int(stops[-1]) if len(n) else 0
    return store[np.repeat(starts - stops + n, n) + np.arange(total)], n


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    *,
    end_id: int = END_ID,
    unit: str = "byte",
    block: int = BLOCK,
    chunk_ids: int = CHUNK_IDS,
    shards: int | None = None,
) -> str:
    """Encode ``docs`` (doc_id, text) and write their ids; returns the dataset's path."""
    spark = docs.sparkSession
    path = path or stage_path(spark, "tokens")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode, first, chunk = TaskContext.get().partitionId(), encoder(tokenizer_path), 0, 0
        names, offsets, held, n = [], [], [], 0
        end = np.array([end_id], "<u4")

        def close() -> pa.RecordBatch:
            nonlocal names, offsets, held, n, first, chunk
            flat = np.concatenate(held)
            blocks = [pack_block(flat[k : k + block], unit) for k in range(0, len(flat), block)]
            stops = np.cumsum([0, *map(len, blocks)])
            row = ([shard], [chunk], [first], [len(flat)], [names], [offsets], [stops], [b"".join(blocks)])
            first, chunk, names, offsets, held, n = first + len(flat), chunk + 1, [], [], [], 0
            return table_of(CHUNK, row)

        for b in parts(batches, 1 << 22, 1 << 14):
            ids, upto = encode(b.column("text"))
            for name, x, y in zip(b.column("doc_id").to_pylist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                names.append(name)
                offsets.append(n)
                held += (ids[x:y], end)
                n += y - x + 1
                if n >= chunk_ids:
                    yield close()
            held = [x.copy() if len(x) > 1 else x for x in held]  # the batch's ids may go
        if names:
            yield close()

    ranged.mapInArrow(run, CHUNK).write.parquet(path)
    return path


def read_chunk(plane_offsets: np.ndarray, planes: bytes) -> np.ndarray:
    """All ids of one chunk."""
    return np.concatenate(
        [unpack_block(planes[a:b]) for a, b in zip(plane_offsets[:-1], plane_offsets[1:], strict=True)]
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read a dataset back: doc_id, start (global), n_tokens, ids."""
    return _read(spark, path, "ids array<int>", lambda x: x.view(np.int32))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Read a dataset back: doc_id, start (global), n_tokens, ids_crc32."""
    return _read(spark, path, "ids_crc32 long", lambda x: zlib.crc32(x))


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    chunks = spark.read.schema(CHUNK).parquet(path)
    # One row for each shard: the ids before it. The number of shards is that of the partitions written.
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                first, before, names, offsets, stops, planes = (x[0] for x in b.slice(k, 1).to_pydict().values())
                ids = read_chunk(stops, planes)
                at = np.array([*offsets, len(ids)], np.int64)
                values = [value(ids[x:y]) for x, y in zip(offsets, at[1:].tolist(), strict=True)]
                yield table_of(f"doc_id long, start long, n_tokens long, {column}", (names, at[:-1] + (first + before), np.diff(at), values))

    joined = chunks.join(F.broadcast(before), "shard")
    rows = joined.select("first", "before", "doc_ids", "doc_offsets", "plane_offsets", "planes")
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
