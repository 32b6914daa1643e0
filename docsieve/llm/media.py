"""Media columns of lossless WebP images: write payloads as samples, decode images to pixel arrays.

``decode_images`` turns a binary column into width, height and ARGB pixels. ``store_payloads`` writes each text's
UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as image samples.

Defined results: a null text counts as empty (64 zero bytes); a null or broken image gives null width, height and
pixels and an error text; repeated rows give repeated results; extra columns are kept apart by name; texts of any
length are stored whole, as several images where one cannot hold them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from . import webp
from .batches import parts, table_of

#: Stored bytes that are read together, single rows aside.
READ_BYTES = 1 << 21

DECODED = "width int, height int, pixels array<long>, error string"
STORED = "doc_id long, n_bytes long, media binary"
DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the bytes that are the text's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0), len(raw)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and the part of each sixteenth of their range."""
    counts = np.bincount(samples, minlength=256)
    part = counts / len(samples)
    mean = float(part @ np.arange(256))
    spread = float(np.sqrt(max(0.0, part @ (np.arange(256) - mean) ** 2)))
    some = part[part > 0]
    bins = counts.reshape(16, 16).sum(1) * 1000 // len(samples)
    return f"{mean:.4f};{spread:.4f};{float(-(some * np.log2(some)).sum()):.4f};" + ",".join(map(str, bins))


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes (unpadded), media (the stored images)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            made = [payload_of(x) for x in b.column("text").to_pylist()]
            yield table_of(STORED, (b.column("doc_id"), [n for _, n in made], webp.encode_many([p for p, _ in made])))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STORED)


def read_payloads(stored: DataFrame) -> DataFrame:
    """Read stored payloads back: digests of payload and stored form, and features of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, READ_BYTES, text="media"):
            rows = []
            doc_ids, sizes, stored = (b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
            for doc_id, n, media, samples in zip(doc_ids, sizes, stored, webp.decode_many(stored), strict=True):
                data = samples.tobytes()
                rows.append(
                    (doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media),
                     hashlib.sha256(media).hexdigest(), feature(samples))
                )
            yield table_of(DIGESTS, zip(*rows, strict=True))

    return stored.mapInArrow(run, DIGESTS)


def decode_images(images: DataFrame, media_col: str = "media") -> DataFrame:
    """Decode the first image of each row: the other columns, then width, height, pixels (ARGB) and error."""
    keep = [c for c in images.columns if c not in (media_col, "width", "height", "pixels", "error")]
    schema = StructType(list(images.select(*keep, media_col).schema.fields))
    for name, kind in (("width", IntegerType()), ("height", IntegerType()), ("pixels", ArrayType(LongType())), ("error", StringType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for x in b.column(media_col).to_pylist():
                try:
                    px, _ = webp.decode(bytes(x))
                    made.append((px.shape[1], px.shape[0], px.reshape(-1).astype(np.int64), None))
                except (ValueError, TypeError, IndexError) as why:
                    made.append((None, None, None, str(why)[:200]))
            more = table_of(DECODED, zip(*made, strict=True) if made else [[]] * 4)
            yield pa.record_batch([*b.columns, *more.columns], names=[*b.schema.names, *more.schema.names])

    return images.select(*keep, media_col).mapInArrow(run, schema)
