"""Read huge JSON artefacts, one object with a last array ``pages`` of pages with blocks, by many tasks.

A file has no line ends to split at, so its structure is found in two passes over byte chunks. A chunk cannot know if
it begins inside a string, but its quotes can be counted and its brackets summed for both cases; from these sums, a few
numbers for each chunk, every chunk's true state follows, and the chunks then give the offsets at which the pages of
the root's array begin. Pages are read by the chunk that they begin in: a task holds one chunk and one page.

An artefact is ``{..., "page_count": n, "pages": [{"page": {...}, "blocks": [...]}, ...]}`` in UTF-8. Whatever is not so
fails with a code: the reader never returns some pages of a broken file as if they were all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 8 << 20
ROWS = "path string, page_order long, page_number int, page string, block_order int, block string"
_STEPS = np.zeros(256, np.int8)
_STEPS[[ord("{"), ord("[")]], _STEPS[[ord("}"), ord("]")]] = 1, -1
_KEY = re.compile(rb'"pages"\s*:\s*\Z')


class ArtifactError(ValueError):
    """An artefact that may not be read, with a short code."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code}: {path}")
        self.code = code


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bytes(path: str, start: int, stop: int) -> bytes:
    where, name = _file(path)
    with where.open_input_file(name) as f:
        f.seek(start)
        return f.read(stop - start)


def _edge(path: str, at: int, size: int) -> int:
    """``at``, or the first place after it that no backslash stands before; so no chunk begins with an escaped sign."""
    while 0 < at < size:
        some = _bytes(path, at - 1, min(size, at + (1 << 10)))
        for k, b in enumerate(some):
            if b != 0x5C:
                return at + k
        at += len(some)
    return min(at, size)


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the quotes that open or close strings, and of all brackets."""
    quotes, slashes = np.flatnonzero(data == 0x22), np.flatnonzero(data == 0x5C)
    if len(quotes) and len(slashes):  # a quote after an odd run of backslashes is a sign of its string
        gap = np.diff(slashes) > 1
        first, last = slashes[np.append(True, gap)], slashes[np.append(gap, True)]
        odd = last[(last - first) % 2 == 0]
        at = np.minimum(np.searchsorted(odd, quotes - 1), max(len(odd) - 1, 0))
        if len(odd):
            quotes = quotes[odd[at] != quotes - 1]
    return quotes, np.flatnonzero(_STEPS[data])


def _levels(data: np.ndarray, inside: bool, marks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the brackets outside strings, and +1 or -1 for each."""
    quotes, brackets = marks or _marks(data)
    outside = (np.searchsorted(quotes, brackets) + inside) % 2 == 0
    brackets = brackets[outside]
    return brackets, _STEPS[data[brackets]].astype(np.int64)


def chunk_sums(path: str, start: int, stop: int, size: int) -> tuple[int, int, int]:
    """Of a chunk: quotes modulo 2, and the sum of its brackets if it begins outside and if it begins inside a string."""
    start, stop = _edge(path, start, size), _edge(path, stop, size)
    data = np.frombuffer(_bytes(path, start, stop), np.uint8)
    marks = _marks(data)
    return len(marks[0]) % 2, *(int(_levels(data, inside, marks)[1].sum()) for inside in (False, True))


def chunk_places(path: str, start: int, stop: int, size: int, inside: bool, depth: int) -> dict:
    """Of a chunk in a known state: where the array ``pages`` opens, where arrays of the root close, where pages begin."""
    start, stop = _edge(path, start, size), _edge(path, stop, size)
    raw = _bytes(path, start, stop)
    data = np.frombuffer(raw, np.uint8)
    at, step = _levels(data, inside)
    level = depth + np.cumsum(step)
    if len(level) and level.min() < 0:
        raise ArtifactError("ARTIFACT_INVALID", path)
    opens = [int(p) + start for p in at[(level == 2) & (step > 0) & (data[at] == ord("["))]]
    opens = [p for p in opens if _KEY.search(_bytes(path, max(0, p - 64), p))]
    closes = at[(level == 1) & (step < 0) & (data[at] == ord("]"))] + start
    pages = at[(level == 3) & (step > 0) & (data[at] == ord("{"))] + start
    return {"opens": opens, "closes": closes.tolist(), "pages": pages.tolist()}


def _chunks(path: str) -> tuple[int, list[tuple[int, int]]]:
    where, name = _file(path)
    info = where.get_file_info(name)
    if info.type != fs.FileType.File:
        raise ArtifactError("ARTIFACT_MISSING", path)
    size = info.size
    return size, [(k, min(k + CHUNK, size)) for k in range(0, size, CHUNK)]


def _map(spark: SparkSession, rows: list[tuple], ddl: str, run, out: str) -> DataFrame:
    """``run`` over rows of a small table, each in a task of its own."""
    table = spark.createDataFrame(rows, ddl)
    return table.repartitionByRange(max(1, len(rows)), "path", "start").mapInArrow(run, out)


def page_ranges(spark: SparkSession, path: str) -> tuple[dict, list[tuple[str, int, int, int]]]:
    """The header, and for each chunk in which pages begin (path, first page, its start, the end of the last)."""
    size, chunks = _chunks(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["start"], *chunk_sums(r["path"], r["start"], r["stop"], size)) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("start", "odd", "plain", "quoted"), r, strict=True)) for r in rows], schema=_schema("start odd plain quoted"))

    found = _map(spark, [(path, a, b) for a, b in chunks], "path string, start long, stop long", sums, "start long, odd long, plain long, quoted long").collect() if chunks else []
    state, inside, depth = [], False, 0
    for r, (a, b) in zip(sorted(found), chunks, strict=True):
        state.append((path, a, b, inside, depth))
        depth += r["quoted"] if inside else r["plain"]
        inside ^= bool(r["odd"])
    if inside or depth:
        raise ArtifactError("ARTIFACT_TRUNCATED", path)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = chunk_places(r["path"], r["start"], r["stop"], size, r["inside"], r["depth"])
                opens, closes, pages = x["opens"], x["closes"], x["pages"]
                # Pages count from the array's begin on; a chunk gives its first, its number, and the array's ends.
                yield pa.RecordBatch.from_pylist(
                    [{"start": r["start"], "opens": opens, "closes": closes[-1:], "first": next((p for p in pages if not opens or p > opens[-1]), None),
                      "pages": sum(not opens or p > opens[-1] for p in pages)}], schema=_PLACES,
                )

    ddl = "start long, opens array<long>, closes array<long>, first long, pages long"
    rows = sorted(_map(spark, state, "path string, start long, stop long, inside boolean, depth int", places, ddl).collect()) if state else []
    opens = [p for r in rows for p in r["opens"]]
    closes = [p for r in rows for p in r["closes"]]
    if len(opens) != 1 or not closes:
        raise ArtifactError("ARTIFACT_INVALID", path)
    begin, end = opens[0], max(closes)
    try:
        head = _bytes(path, 0, begin).decode()
        header = json.loads(re.sub(r',?\s*"pages"\s*:\s*\Z', "", head) + "}")
        tail = _bytes(path, end + 1, size).decode()
    except ValueError:
        raise ArtifactError("ARTIFACT_INVALID", path) from None
    count = header.get("page_count")
    if tail.strip(" \t\r\n") != "}" or not isinstance(count, int) or isinstance(count, bool) or count < 0:
        raise ArtifactError("ARTIFACT_INVALID", path)
    held = [(r["first"], r["pages"]) for r in rows if r["first"] is not None and r["first"] > begin and r["pages"]]
    if sum(n for _, n in held) != count:
        raise ArtifactError("ARTIFACT_PAGE_COUNT", path)
    if not held and _bytes(path, begin + 1, end).strip(b" \t\r\n"):
        raise ArtifactError("ARTIFACT_INVALID", path)
    if held and _bytes(path, begin + 1, held[0][0]).strip(b" \t\r\n"):
        raise ArtifactError("ARTIFACT_INVALID", path)
    ranges, page = [], 0
    for k, (first, n) in enumerate(held):
        ranges.append((path, page, first, held[k + 1][0] if k + 1 < len(held) else end))
        page += n
    return header, ranges


def _schema(names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names.split()])


_PLACES = pa.schema([("start", pa.int64()), ("opens", pa.list_(pa.int64())), ("closes", pa.list_(pa.int64())), ("first", pa.int64()), ("pages", pa.int64())])
_ROWS = pa.schema([("path", pa.string()), ("page_order", pa.int64()), ("page_number", pa.int32()), ("page", pa.string()), ("block_order", pa.int32()), ("block", pa.string())])


def _pages(path: str, start: int, stop: int, last: bool) -> Iterator[bytes]:
    """The pages of [start, stop), a chunk of bytes at a time; a comma stands between two, and after all but the last."""
    held, at, inside, depth = b"", start, False, 0
    begin, first = 0, True  # where the page in hand begins

    def between(gap: bytes, wanted: bytes) -> None:
        if gap.strip(b" \t\r\n") != wanted:
            raise ArtifactError("ARTIFACT_INVALID", path)

    while at < stop:
        edge = min(_edge(path, min(at + CHUNK, stop), stop), stop)
        data = np.frombuffer(more := _bytes(path, at, edge), np.uint8)
        marks = _marks(data)
        places, step = _levels(data, inside, marks)
        level = depth + np.cumsum(step)
        offset, done = len(held), 0
        held += more
        for k in np.flatnonzero(((step > 0) & (level == 1)) | ((step < 0) & (level == 0))).tolist():
            p = offset + int(places[k])
            if step[k] > 0:
                between(held[done:p], b"" if first else b",")
                begin, first = p, False
            else:
                yield held[begin : p + 1]
                done = p + 1
        inside ^= bool(len(marks[0]) % 2)
        depth = int(level[-1]) if len(level) else depth
        held, begin, at = held[done:], begin - done, edge
    between(held, b"" if last else b",")


def _page_rows(path: str, order: int, raw: bytes) -> list[dict]:
    try:
        value = json.loads(raw)
        page, blocks = value["page"], value["blocks"]
        number = page["page_number"]
    except (ValueError, KeyError, TypeError):
        raise ArtifactError("ARTIFACT_INVALID", path) from None
    if list(value) != ["page", "blocks"] or not isinstance(blocks, list) or not isinstance(number, int) or any(not isinstance(b, dict) for b in blocks):
        raise ArtifactError("ARTIFACT_INVALID", path)
    if any(b.get("block", b).get("page_number", number) != number for b in blocks):
        raise ArtifactError("BLOCK_PAGE_MISMATCH", path)
    said = json.dumps(page, ensure_ascii=False, separators=(",", ":"))
    row = {"path": path, "page_order": order, "page_number": number, "page": said}
    return [row | {"block_order": k, "block": json.dumps(b, ensure_ascii=False, separators=(",", ":"))} for k, b in enumerate(blocks)] or [
        row | {"block_order": None, "block": None}
    ]


def read_artifact(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header, and a row for each block: path, page_order, page_number, page, block_order, block (JSON texts).

    A page without blocks has one row without a block. ``path`` is a local path or a URI that Arrow's file systems open.
    """
    header, ranges = page_ranges(spark, path)
    end = max((r[3] for r in ranges), default=0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for k, raw in enumerate(_pages(r["path"], r["start"], r["stop"], r["stop"] == end)):
                    rows = _page_rows(r["path"], r["page"] + k, raw)
                    for at in range(0, len(rows), 1 << 12):
                        yield pa.RecordBatch.from_pylist(rows[at : at + (1 << 12)], schema=_ROWS)

    if not ranges:
        return header, spark.createDataFrame([], ROWS)
    return header, _map(spark, ranges, "path string, page long, start long, stop long", read, ROWS)


def write_artifact(pages: DataFrame, path: str, header: dict) -> None:
    """Write rows (page_order, page, blocks: JSON texts) as the one file of a new folder, page after page."""
    r = pages.agg(F.count("*").alias("n"), F.min("page_order").alias("first")).first()
    head = json.dumps(header | {"page_count": r["n"]}, ensure_ascii=False)[:-1] + ', "pages": ['
    comma = F.when(F.col("page_order") > F.lit(r["first"]), ",").otherwise("")
    body = F.concat(comma, F.lit('{"page":'), "page", F.lit(',"blocks":['), F.array_join("blocks", ","), F.lit("]}"))
    rows = pages.select(F.col("page_order").cast("long").alias("at"), body.alias("value"))
    ends = pages.sparkSession.createDataFrame([(-1, head), (1 << 62, "]}")], "at long, value string")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
