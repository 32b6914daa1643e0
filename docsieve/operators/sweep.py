"""Interval overlap by a sweep over sorted edges: what covers each piece of a page.

Pages are dealt by their hash and cut by array operations over Arrow batches of whole pages. Pages of more than
``LONG`` spans are cut into cells before: every ``CELL_EDGES``-th edge by its hash is a border, so a border is a cut that
the page has anyway; a span that reaches over borders is carried into each cell that it crosses, where a piece that it
covers begins, so carried rows are no more than the output. Work is linear in edges and output, sorting aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.text import escape_html
from ..session import stage

#: Names in a batch of pieces, single pieces aside.
PIECE_NAMES = 1 << 17
#: Buckets of pages that are counted; spans of a bucket whose pages may be long; edges of a cell; cells of a page.
BUCKETS, LONG, CELL_EDGES, MOST_CELLS = 1 << 16, 1 << 18, 1 << 14, 1 << 10


def _changes(column: pa.Array) -> np.ndarray:
    """Of each row but the first whether it differs from the one before; null equals null."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values, values[1:], strict=False)], bool)
    return np.diff(column.dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0


def _whole_pages(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole pages, and where each page begins, of rows in the order of the page (``width`` columns)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ahead = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b]) if held else b
        new = np.flatnonzero(np.logical_or.reduce([_changes(c) for c in ahead.columns[:width]])) + (0 if held else 1)
        if not len(new):
            held.append(b)
            continue
        last = int(new[-1])  # the page of this row may go on
        if held or last:
            done = pa.concat_batches([*held, b.slice(0, last)])
            before = done.num_rows - last
            yield done, np.concatenate([[0], before + new[:-1]]).astype(np.int64)
        held = [b.slice(last)]
    if held:
        yield pa.concat_batches(held), np.zeros(1, np.int64)


def _swept(width: int, schema: pa.Schema):
    """Pieces of rows (page..., start, end, name) in the order of the page; the first columns of the page are given."""
    shown = len(schema) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole_pages(batches, width):
            n = rows.num_rows
            start, end = (rows.column(width + k).to_numpy() for k in (0, 1))
            names = rows.column(width + 2).dictionary_encode()
            order = pc.array_sort_indices(names.dictionary)
            known, rank = names.dictionary.take(order), np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            rank = rank[names.indices.to_numpy()]
            page = np.repeat(np.arange(len(begins)), np.diff(begins, append=n))
            # Places are the distinct edges of each page; a piece goes from its place to the next.
            at, of = np.concatenate([start, end]), np.concatenate([page, page])
            order = np.lexsort((at, of))
            at, of = at[order], of[order]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
            place = np.empty(2 * n, np.int64)
            place[order] = np.cumsum(new) - 1
            at, of, first, last = at[new], of[new], place[:n], place[n:]
            depth = np.cumsum(np.bincount(first, minlength=len(at)) - np.bincount(last, minlength=len(at)))
            total = np.cumsum(depth)
            low = 0
            while low < len(at):
                high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PIECE_NAMES, "right")))
                some = np.flatnonzero((first < high) & (last > low))
                a, sizes = np.maximum(first[some], low), np.minimum(last[some], high) - np.maximum(first[some], low)
                covered = np.repeat(a - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                keys = np.sort((covered - low) * len(known) + np.repeat(rank[some], sizes))
                keys = keys[np.diff(keys, prepend=-1) != 0]  # spans of one name count as one
                piece, who = np.divmod(keys, len(known))
                starts = np.flatnonzero(np.diff(piece, prepend=-1) != 0)
                piece = piece[starts] + low
                low = high
                if len(piece):
                    given = pa.array(begins[of[piece]])
                    cover = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), known.take(pa.array(who)), type=schema.field(shown + 2).type)
                    shows = [rows.column(k).take(given) for k in range(shown)]
                    yield pa.record_batch([*shows, pa.array(at[piece]), pa.array(at[piece + 1]), cover], schema=schema)

    return run


def _celled(spans: DataFrame, page: list[str], name: str) -> DataFrame:
    """Spans of long pages cut at the borders of cells: the columns of ``spans``, and ``_cell``."""
    spans = stage(spans.distinct(), "long")
    edges = spans.select("*", F.explode(F.array("start", "end")).alias("_at")).withColumn("_hash", F.xxhash64(*page, "start", "end", name, "_at"))
    edges = edges.filter(F.pmod("_hash", F.lit(CELL_EDGES)) == 0)
    nth = F.array_sort(F.collect_list(F.struct("_hash", "_at")))
    cuts = F.array_sort(F.array_distinct(F.slice(nth, 1, MOST_CELLS - 1)["_at"]))
    borders = edges.groupBy(*(F.col(c).alias(f"_{c}") for c in page)).agg(cuts.alias("_cuts"))
    same = F.lit(True)
    for c in page:
        same = same & spans[c].eqNullSafe(borders[f"_{c}"])
    cuts = F.coalesce("_cuts", F.array().cast("array<bigint>"))
    out = spans.join(F.broadcast(borders), same, "left").select(*spans.columns, cuts.alias("_cuts"))
    cells = F.sequence(F.size(F.filter("_cuts", lambda x: x <= F.col("start"))), F.size(F.filter("_cuts", lambda x: x < F.col("end"))))
    out = out.select("*", F.explode(cells).alias("_cell"))
    start, end = F.greatest("start", F.get("_cuts", F.col("_cell") - 1)), F.least("end", F.get("_cuts", F.col("_cell")))
    return out.select(*page, "_cell", start.alias("start"), end.alias("end"), name)


def segments(spans: DataFrame, page: list[str], name: str = "finding_id") -> DataFrame:
    """Cut each page at all edges of its spans (start, end); pieces (from, to) with the sorted names of what covers them.

    Spans that are empty, or whose start, end or name is null, cover nothing; spans of one name count as one; pieces
    that nothing covers are left out. Pages are told apart by the columns ``page``, which may be null.
    """
    whole = spans.filter(F.col("end") > F.col("start")).filter(F.col(name).isNotNull())
    whole = whole.select(*page, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), name)
    # A long page lies in a full bucket; these are few numbers, and other pages in them are cut rightly as well.
    bucket = F.pmod(F.xxhash64(*page), F.lit(BUCKETS))
    full = [r[0] for r in whole.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > LONG).collect()]
    rows, key = whole, list(page)
    if full:
        key.append("_cell")
        short = whole.filter(~bucket.isin(full)).select(*page, F.lit(0).alias("_cell"), "start", "end", name)
        rows = short.unionByName(_celled(whole.filter(bucket.isin(full)), page, name))
    fields = {f.name: f for f in whole.schema.fields}
    schema = StructType(
        [*(fields[c] for c in page), StructField("from", LongType()), StructField("to", LongType()), StructField("names", ArrayType(fields[name].dataType, False))]
    )
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_swept(len(key), to_arrow_schema(schema)), schema)


def marked_text(nodes: DataFrame, spans: DataFrame, node: list[str]) -> DataFrame:
    """``nodes`` (node columns, text) with ``html``: escaped text, each covered piece in a mark that names its findings.

    ``spans`` has the node columns, finding_id, category, start and end in characters of the text; spans that reach
    over the text's end mark nothing. A mark's classes are the sorted categories of its findings; line ends are breaks.
    """
    fits = spans.join(nodes.select(*node, F.length("text").alias("_size")), node).filter(F.col("end") <= F.col("_size")).drop("_size")
    kinds = fits.groupBy(*node).agg(F.map_from_entries(F.collect_set(F.struct("finding_id", "category"))).alias("kinds"))
    cut = segments(fits, node).groupBy(*node).agg(F.array_sort(F.collect_list(F.struct("from", "to", "names"))).alias("cuts"))
    joined = nodes.join(cut.join(kinds, node), node, "left")
    body = lambda a, n: F.replace(escape_html(F.substring("text", a + 1, n)), F.lit("\n"), F.lit("<br>"))

    def piece(c, i):
        after = F.when(i > 0, F.col("cuts")[i - 1]["to"]).otherwise(F.lit(0))
        classes = F.array_sort(F.array_distinct(F.transform(c["names"], lambda x: F.element_at("kinds", x))))
        opened = F.concat(
            F.lit('<mark class="'), F.array_join(F.concat(F.array(F.lit("bl-hit")), classes), " "), F.lit('" data-finding-id="'),
            escape_html(F.array_join(c["names"], " ")), F.lit('" tabindex="-1">'),
        )
        return F.concat(body(after, c["from"] - after), opened, body(c["from"], c["to"] - c["from"]), F.lit("</mark>"))

    marked = F.concat(F.array_join(F.transform("cuts", piece), ""), body(F.element_at("cuts", -1)["to"], F.length("text")))
    plain = F.replace(escape_html(F.col("text")), F.lit("\n"), F.lit("<br>"))
    return joined.withColumn("html", F.when(F.size("cuts") > 0, marked).otherwise(plain)).drop("cuts", "kinds")
