"""Arrow batches for the training-data operators: texts in bounded parts, ids as they are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PART_BYTES, PART_ROWS = 1 << 20, 1 << 12


_SIMPLE = {
    "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
    "boolean": pa.bool_(),
}


def table_of(ddl: str, columns: Iterable) -> pa.RecordBatch:
    """A batch of plain columns (lists or arrays) after a DDL of simple types and arrays of them."""
    names, kinds = zip(*(x.split(" ") for x in ddl.split(", ")), strict=True)
    kinds = [pa.list_(_SIMPLE[k[6:-1]]) if k.startswith("array<") else _SIMPLE[k] for k in kinds]
    made = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.record_batch(made, names=list(names))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers as rows."""
    return column.flatten().to_numpy().reshape(-1, width)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, null as empty, and the n + 1 offsets of its rows in them."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, ends, data = column.buffers()
    if not n or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches: Iterable[pa.RecordBatch], most: int = PART_BYTES, rows: int = PART_ROWS, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows whose texts have, single rows aside, at most ``most`` bytes."""
    for b in batches:
        ends = utf8(b.column(text))[1]
        at, n = 0, b.num_rows
        while at < n:
            to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
            to = min(max(to, at + 1), at + rows, n)
            yield b.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers outlive their tasks
