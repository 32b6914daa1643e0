"""Registered queries of page assembly: elements from OCR blocks, table grids, HTML that reads back, marked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, sweep
from ..session import read_table, stage
from ..sources import ocr, reviewed_html
from .queries import query

#: Lines of a page; a line's place in its page's figures, tables and so on follows from its number.
PAGE_LINES = 12


def _block(kind: str, name: Column, page: Column, text: Column | None = None, children: list[Column] | None = None, box: Column | None = None, cell=(None, None)) -> Column:
    """One block of an OCR response."""
    null = F.lit(None)
    related = F.array(F.struct(F.lit("CHILD").alias("Type"), F.array(*children).alias("Ids"))) if children else null
    geometry = F.struct(F.struct(null, box, F.lit(1.0), F.lit(0.1))) if box is not None else null
    row, column = (F.lit(x) for x in cell)
    return F.struct(
        name, F.lit(kind), page, text if text is not None else null, row, column, F.lit(1), F.lit(1), null, null, F.lit(99.0), geometry, related
    ).cast(ocr.BLOCK)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as an OCR response has them, made of the lines of every document.

    By its number a line is a title, a layout with one line, a list of a layout of a line, a line alone, a table of two
    cells in a table layout, or a figure with a line. Lines of the same page lie the higher the later they come.
    """
    docs = read_table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("k", "t"))
    k, text = F.col("k"), F.col("t")
    page = (F.floor(k / PAGE_LINES) + 1).cast("int")
    name = lambda x: F.concat(F.lit(f"{x}-"), k.cast("string"))
    box = (1 - (k % PAGE_LINES) / F.lit(100.0)).cast("double")
    words = [F.split_part(text, F.lit(" "), F.lit(1)), F.ltrim(F.regexp_replace(text, r"^[^ ]*", ""))]
    both = [_block("WORD", name(f"w{i}"), page, w) for i, w in enumerate(words)]
    line = _block("LINE", name("l"), page, text, [name("w0"), name("w1")], box)
    made = {
        0: [_block("LAYOUT_TITLE", name("t"), page, None, [name("l")], box), line, *both],
        1: [_block("LAYOUT_TEXT", name("t"), page, None, [name("l")]), line, *both],
        2: [_block("LAYOUT_LIST", name("t"), page, None, [name("u")]), _block("LAYOUT_TEXT", name("u"), page, None, [name("l")]), line, *both],
        3: [line, *both],
        4: [_block("LAYOUT_TABLE", name("t"), page, None, [name("x")]), _block("TABLE", name("x"), page, None, [name("c0"), name("c1")]),
            *(_block("CELL", name(f"c{i}"), page, None, [name(f"w{i}")], None, (1, i + 1)) for i in (0, 1)), line, *both],
        5: [_block("LAYOUT_FIGURE", name("t"), page, None, [name("l")]), line, *both],
    }
    some = F.array(*made[5])
    for kind in range(5):
        some = F.when(k % 6 == kind, F.array(*made[kind])).otherwise(some)
    rows = lines.select("doc_id", "k", F.posexplode(some).alias("n", "b")).select("doc_id", (F.col("k") * 10 + F.col("n")).cast("int").alias("position"), "b.*")
    return stage(rows, "blocks")  # read by several joins


_LINES = """lines AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, k - 1 AS k, parts[k] AS t FROM (
  SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL)
), e AS (SELECT doc_id, CAST(k // 12 + 1 AS INTEGER) AS page_number, k, t, CASE k % 6 WHEN 0 THEN 'title' WHEN 4 THEN 'table' ELSE 'text' END AS kind,
    CASE k % 6 WHEN 3 THEN 'l-' WHEN 5 THEN 'l-' WHEN 4 THEN 'x-' ELSE 't-' END || k AS block_id, CASE WHEN k % 6 IN (3, 5) THEN 1 ELSE 0 END AS phase
  FROM lines WHERE t <> '' OR k % 6 = 4
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY phase, CASE phase WHEN 1 THEN -k ELSE k END) - 1 AS INTEGER) AS element_order FROM e)"""


@query(f"""WITH {_LINES}
SELECT doc_id, page_number, element_order, kind, block_id, CASE WHEN kind <> 'table' THEN sha256(t) END AS text_sha256 FROM o""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's elements in reading order, from layout blocks, tables and free lines."""
    found = assembly.elements(line_blocks(spark, sf_dir))
    return found.select("doc_id", "page_number", "element_order", "kind", "block_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {_LINES}, c AS (
  SELECT doc_id, page_number, element_order, CASE kind WHEN 'table' THEN i ELSE -1 END AS cell, CASE kind WHEN 'table' THEN 'TABLE_CELL' ELSE kind END AS kind,
    CASE kind WHEN 'table' THEN 'c' || i || '-' || k ELSE block_id END AS block_id,
    CASE WHEN kind <> 'table' THEN t WHEN i = 0 THEN string_split(t, ' ')[1] ELSE ltrim(regexp_replace(t, '^[^ ]*', ''), ' ') END AS t
  FROM o, (VALUES (0), (1)) v(i) WHERE i = 0 OR kind = 'table')
SELECT doc_id, page_number, count(*) AS nodes, sha256(string_agg(kind || ' ' || block_id || ' ' || t, chr(10) ORDER BY element_order, cell)) AS nodes_sha256 FROM c GROUP BY ALL""")
def ocr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR blocks to nodes to whole reviewed HTML documents, read back as blocks: a digest for each page."""
    found = assembly.nodes(line_blocks(spark, sf_dir))
    facts = found.select("doc_id").distinct().select("doc_id", F.lit("r1").alias("revision_id"), F.lit(1).alias("generation"), F.lit("SUCCEEDED").alias("status"))
    files = assembly.document_html(assembly.page_html(found), facts)
    back = reviewed_html.read_blocks(files.select("doc_id", F.encode("html", "UTF-8").alias("content")))
    said = F.concat_ws(" ", "kind", F.element_at("ocr", 1)["block_id"], "text")
    rows = F.array_sort(F.collect_list(F.struct("block_order", said.alias("said"))))
    return back.groupBy("doc_id", "page_number").agg(
        F.count("node_id").alias("nodes"), F.sha2(F.array_join(F.transform(rows, lambda r: r["said"]), "\n"), 256).alias("nodes_sha256")
    )


@query("""WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS cell, row_number() OVER () AS u, CAST(l_linenumber % 3 + 1 AS INTEGER) AS r, CAST(floor(l_quantity) AS INTEGER) % 4 + 1 AS c,
  CAST(l_partkey % 3 + 1 AS INTEGER) AS h, CAST(l_suppkey % 3 + 1 AS INTEGER) AS w FROM lineitem
), d AS (SELECT table_id, cell, min((r, c, h, w)) AS x FROM c GROUP BY ALL
), k AS (SELECT table_id, cell, x[1] AS r, x[2] AS c, x[3] AS h, x[4] AS w FROM d
), s AS (SELECT table_id, cell, r, c, h, w, i, j, row_number() OVER (PARTITION BY table_id, r + i, c + j ORDER BY r, c, cell) > 1 AS lost
  FROM (SELECT *, unnest(range(0, w)) AS j FROM (SELECT *, unnest(range(0, h)) AS i FROM k))
), a AS (SELECT table_id, cell, r, c, h, w, coalesce(min(j) FILTER (lost AND i = 0), any_value(w)) AS w2, bool_or(lost) AS clipped FROM s GROUP BY ALL
), b AS (SELECT table_id, cell, a.r, a.c, a.w2, a.clipped, coalesce(min(s.i) FILTER (s.lost AND s.j < a.w2), any_value(a.h)) AS h2 FROM a JOIN s USING (table_id, cell) GROUP BY ALL
), p AS (SELECT table_id, cell, r AS row, c AS column, CAST(CASE w2 WHEN 0 THEN 0 ELSE h2 END AS INTEGER) AS row_span, CAST(w2 AS INTEGER) AS column_span,
  CASE WHEN w2 = 0 THEN 'hidden' WHEN clipped THEN 'clipped' ELSE 'placed' END AS state FROM b
), n AS (SELECT table_id, max(row + row_span - 1) * max("column" + column_span - 1) - sum(row_span * column_span) AS gaps FROM p WHERE state <> 'hidden' GROUP BY table_id)
SELECT p.*, CAST(gaps AS BIGINT) AS gaps FROM p JOIN n USING (table_id)""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, a spanning cell for each of its lines: what is placed, clipped, hidden, and left open."""
    t = read_table(spark, sf_dir, "lineitem")
    cell = F.struct(
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("row"), (F.floor("l_quantity") % 4 + 1).cast("int").alias("column"),
        (F.col("l_partkey") % 3 + 1).cast("int").alias("row_span"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("column_span"),
    )
    cells = t.groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("cell")).agg(F.min(cell).alias("c")).select("table_id", "cell", "c.*")
    placed = assembly.placed_cells(cells, ["table_id"], "cell")
    gaps = assembly.grid_gaps(placed, ["table_id"]).groupBy("table_id").agg(F.count("*").alias("gaps"))
    out = placed.join(gaps, "table_id", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))
    return out.select("table_id", "cell", "row", "column", "row_span", "column_span", "state", "gaps")


_SAFE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), s AS (SELECT doc_id, n, unnest([{{'id': 'b', 'cat': 'equipment', 's': 0, 'e': n // 2}}, {{'id': 'a', 'cat': 'materials', 's': n // 4, 'e': n // 2 + n // 4}},
  {{'id': 'c', 'cat': 'equipment', 's': n // 4, 'e': n // 4 + 5}}, {{'id': 'd', 'cat': 'units', 's': n - 3, 'e': n + 1}}], recursive := true) FROM d
), f AS (SELECT * FROM s WHERE e > s AND e <= n AND s >= 0
), p AS (SELECT DISTINCT doc_id, unnest([s, e, 0, n]) AS p FROM f UNION SELECT doc_id, unnest([0, n]) FROM d
), c AS (SELECT doc_id, p AS a, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM p
), m AS (SELECT c.doc_id, a, b, string_agg(DISTINCT f.id, ' ' ORDER BY f.id) AS ids, string_agg(DISTINCT f.cat, ' ' ORDER BY f.cat) AS cats
  FROM c LEFT JOIN f ON f.doc_id = c.doc_id AND f.s <= a AND f.e >= b WHERE b IS NOT NULL GROUP BY ALL
), h AS (SELECT m.doc_id, a, replace({_SAFE.format("substr(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))")}, chr(10), '<br>') AS x, ids, cats FROM m JOIN d USING (doc_id))
SELECT d.doc_id, sha256(coalesce(string_agg(CASE WHEN ids IS NULL THEN x ELSE '<mark class="bl-hit ' || cats || '" data-finding-id="' || ids || '" tabindex="-1">' || x || '</mark>' END, '' ORDER BY a), '')) AS html_sha256
FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with marks around what four overlapping findings cover."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    part = lambda k: F.floor(n / k)
    span = lambda i, c, a, b: F.struct(F.lit(i).alias("finding_id"), F.lit(c).alias("category"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    some = F.array(
        span("b", "equipment", F.lit(0), part(2)), span("a", "materials", part(4), part(2) + part(4)), span("c", "equipment", part(4), part(4) + 5),
        span("d", "units", n - 3, n + 1),
    )
    spans = docs.select("doc_id", F.explode(some).alias("s")).select("doc_id", "s.*")
    out = sweep.marked_text(docs, stage(spans.filter("start >= 0"), "spans"), ["doc_id"])
    return out.select("doc_id", F.sha2("html", 256).alias("html_sha256"))
