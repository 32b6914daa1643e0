"""Pages from OCR blocks: elements in reading order, tables on their grids, nodes, and reviewed HTML.

Layout blocks and their lines are a forest; one pass down gives each its order path, one pass up its text. Elements are
the top layout blocks in reading order (a table layout stands for its tables, a figure for nothing but a warning), then
tables of no layout and lines that neither a layout nor a table represents, both from top to bottom and left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..session import stage
from ..sources import ocr
from ..sources.reviewed_html import ROOT
from .findings import active_highlights
from .sweep import marked_text
from .trees import fold_up, with_paths

PAGE = ["doc_id", "Page"]
# What layout blocks are called, and the place of blocks without a box.
KINDS = {
    "LAYOUT_TITLE": "title", "LAYOUT_SECTION_HEADER": "section_heading", "LAYOUT_HEADER": "header", "LAYOUT_FOOTER": "footer",
    "LAYOUT_PAGE_NUMBER": "page_number",
}
NO_BOX = 2.0


def layout_forest(table: DataFrame) -> DataFrame:
    """Layout blocks and lines with depth and path: doc_id, Page, id, BlockType, parent, place, path, pieces.

    A block of several layouts belongs to the first. A root's place is its position in the response, so the first entry
    of a path tells the root. ``pieces`` are the ids of the blocks whose texts, in this order, make a block's text; the
    texts themselves stay where they are.
    """
    own = table.filter(F.col("BlockType").startswith("LAYOUT") | (F.col("BlockType") == "LINE"))
    said = F.when(F.col("Text") != "", F.array("Id")).when(F.col("Text") == "", F.array().cast("array<string>"))
    own = own.select(*PAGE, F.col("Id").alias("id"), "BlockType", "position", said.alias("said"))
    of = ocr.edges(table.filter(F.col("BlockType").startswith("LAYOUT")), "position").groupBy("doc_id", F.col("child").alias("id")).agg(
        F.min(F.struct(F.col("position").alias("at"), "order", "parent")).alias("first")
    )
    nodes = own.join(of, ["doc_id", "id"], "left").select(
        *PAGE, "id", "BlockType", "said", F.col("first.parent").alias("parent"), F.coalesce("first.order", "position").cast("int").alias("place")
    )
    paths = with_paths(stage(nodes, "layout"), ["doc_id"])
    return fold_up(paths, ["doc_id"], F.coalesce("said", F.flatten("children")), "pieces", "array<string>").drop("said")


def _box(table: DataFrame) -> DataFrame:
    """doc_id, Id, top, left, position."""
    box = F.col("Geometry.BoundingBox")
    place = lambda c: F.coalesce(box[c], F.lit(NO_BOX))
    return table.select("doc_id", F.col("Id").alias("id"), place("Top").alias("top"), place("Left").alias("left"), "position")


def free_lines(table: DataFrame, represented: DataFrame) -> DataFrame:
    """Lines (doc_id, id) that are not ``represented`` and have a word that is in no table's cell."""
    of = ocr.edges(table)
    cells = ocr.edges(table.filter("BlockType = 'TABLE'")).select("doc_id", F.col("child").alias("parent"))
    in_cells = of.join(cells.distinct(), ["doc_id", "parent"], "left_semi").select("doc_id", "child").distinct()
    words = ocr.edges(table.filter("BlockType = 'LINE'")).join(in_cells, ["doc_id", "child"], "left_anti")
    return words.select("doc_id", F.col("parent").alias("id")).distinct().join(represented, ["doc_id", "id"], "left_anti")


def _placed_elements(table: DataFrame) -> DataFrame:
    """The elements of ``elements`` with ``pieces``, as ``layout_forest`` has them, instead of texts; tables have none."""
    forest = stage(layout_forest(table), "forest")
    roots = forest.filter((F.col("depth") == 0) & (F.col("BlockType") != "LINE"))
    roots = roots.select(*PAGE, "id", "BlockType", F.col("place").alias("position"), "pieces")
    tables = table.filter("BlockType = 'TABLE'").select(*PAGE, F.col("Id").alias("id"))
    held = ocr.edges(table.filter("BlockType = 'LAYOUT_TABLE'")).select("doc_id", F.col("parent").alias("layout"), F.col("child").alias("id"), "order").join(tables, ["doc_id", "id"])
    held = held.join(roots.filter("BlockType = 'LAYOUT_TABLE'").select("doc_id", F.col("id").alias("layout"), "position"), ["doc_id", "layout"])
    first = Window.partitionBy("doc_id", "id").orderBy("position", "order")
    placed = held.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    with_table = held.select("doc_id", F.col("layout").alias("id")).distinct().withColumn("has_table", F.lit(True))
    roots = roots.join(with_table, ["doc_id", "id"], "left").withColumn("has_table", F.coalesce("has_table", F.lit(False)))
    speaks = (F.col("BlockType") != "LAYOUT_FIGURE") & ~F.col("has_table")
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("BlockType")], F.lit("text"))
    kind = F.when(F.col("BlockType") == "LAYOUT_TABLE", "table_region").otherwise(kind)
    zero, none = F.lit(0.0), F.lit(None).cast("array<string>")

    def part(df: DataFrame, phase: int, a: Column, b: Column, c: Column, kind: Column, pieces: Column) -> DataFrame:
        key = F.struct(F.lit(phase).alias("phase"), a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("long").alias("c"))
        return df.select(*PAGE, key.alias("key"), kind.alias("kind"), F.col("id").alias("block_id"), pieces.alias("pieces"))

    position, pieces = F.col("position"), F.col("pieces")
    said = part(roots.filter(speaks & (F.size("pieces") > 0)), 0, position, zero, position, kind, pieces)
    laid = part(placed, 0, position, zero, F.col("order"), F.lit("table"), none)
    box = _box(table)
    loose = tables.join(placed.select("doc_id", "id"), ["doc_id", "id"], "left_anti").join(box, ["doc_id", "id"])
    loose = part(loose, 1, F.col("top"), F.col("left"), position, F.lit("table"), none)
    speaking = roots.filter(speaks).select("doc_id", F.col("position").alias("root"))
    represented = forest.filter("BlockType = 'LINE'").withColumn("root", F.element_at("path", 1)).join(speaking, ["doc_id", "root"], "left_semi")
    lines = free_lines(table, represented.select("doc_id", "id")).join(forest.filter("BlockType = 'LINE' AND size(pieces) > 0"), ["doc_id", "id"])
    lines = lines.select(*PAGE, "id", "pieces").join(_box(table.filter("BlockType = 'LINE'")), ["doc_id", "id"])
    lines = part(lines, 2, F.col("top"), F.col("left"), position, F.lit("text"), pieces)
    every = said.unionByName(laid).unionByName(loose).unionByName(lines)
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("key", "block_id")) - 1
    return every.select("doc_id", F.col("Page").alias("page_number"), nth.alias("element_order"), "kind", "block_id", "pieces")


def _with_texts(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, id and more) with ``t``, the own text or mark of block ``id``, null where it has none.

    Texts move once, to the rows of their document; what comes after groups by doc_id and more where they are.
    """
    own = F.coalesce("Text", ocr.mark(F.col("BlockType"), F.col("SelectionStatus")))
    said = table.select("doc_id", F.col("Id").alias("id"), own.alias("t")).filter("t is not null")
    rest = [c for c in wanted.columns if c not in ("doc_id", "id")]
    rows = wanted.select("doc_id", "id", F.struct(*rest).alias("to")).unionByName(said, allowMissingColumns=True).repartition("doc_id")
    met = rows.withColumn("t", F.max("t").over(Window.partitionBy("doc_id", "id"))).filter("to is not null")
    return met.select("doc_id", "id", "to.*", "t")


def _joined(*order: str) -> Column:
    """The texts of a group, in the order of these columns, with spaces between."""
    return F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[order[-1]]), lambda t: t.isNotNull()), " ")


def _piece_rows(found: DataFrame) -> DataFrame:
    """A row for each piece: doc_id, id, n, and the columns of its element; an element without pieces has one without id."""
    return found.select("*", F.posexplode_outer("pieces").alias("n", "id")).drop("pieces")


def elements(table: DataFrame) -> DataFrame:
    """doc_id, page_number, element_order (from 0), kind, block_id, text of each page's elements in reading order.

    ``table`` is as ``ocr.blocks`` gives it, best from a written table, as several joins read it. Elements without text
    are left out, tables have none of their own.
    """
    found = stage(_placed_elements(table), "placed")
    speakers = table.filter(F.col("BlockType").startswith("LAYOUT") | (F.col("BlockType") == "LINE"))
    rows = _with_texts(_piece_rows(found), speakers).groupBy("doc_id", "page_number", "element_order", "kind", "block_id").agg(_joined("n", "t").alias("text"))
    return rows.withColumn("text", F.when(F.col("kind") != "table", F.col("text")))


def warnings(table: DataFrame) -> DataFrame:
    """doc_id, code, block_id: figures, which have no representation."""
    return table.filter("BlockType = 'LAYOUT_FIGURE'").select("doc_id", F.lit("UNINTERPRETED_LAYOUT_FIGURE").alias("code"), F.col("Id").alias("block_id"))


def placed_cells(cells: DataFrame, table: list[str], cell: str = "merge_id") -> DataFrame:
    """Cells on their table's grid: row_span and column_span as they fit, and state.

    Squares are taken in the order of the cells' anchors (row, column, then name). A cell whose anchor is taken is
    ``hidden``; one that meets taken squares is ``clipped``: its width at the first taken square of its first row, its
    height at the first row with one under that width; others are ``placed``. Each square is one row for a while, so
    the work is the tables' area.
    """
    key = [*table, cell]
    square = F.explode(F.sequence(F.lit(0), F.col("row_span") - 1))
    squares = cells.select(*key, "row", "column", "row_span", "column_span").withColumn("r", square).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.col("column_span") - 1))
    )
    at = [*table, F.col("row") + F.col("r"), F.col("column") + F.col("c")]
    claim = F.row_number().over(Window.partitionBy(*at).orderBy("row", "column", cell))
    squares = squares.withColumn("lost", claim > 1)
    width = squares.groupBy(*key).agg(
        F.min(F.when(F.col("lost") & (F.col("r") == 0), F.col("c"))).alias("cut"), F.max("lost").alias("any_lost"),
        F.collect_set(F.when(F.col("lost"), F.struct("r", "c"))).alias("lost"),
    )
    out = cells.join(width, key)
    wide = F.coalesce("cut", "column_span")
    high = F.coalesce(F.array_min(F.transform(F.filter("lost", lambda x: x["c"] < wide), lambda x: x["r"])), F.col("row_span"))
    state = F.when(F.col("cut") == 0, "hidden").when(F.col("any_lost"), "clipped").otherwise("placed")
    hidden = F.col("cut") == 0
    out = out.withColumn("_high", F.when(hidden, 0).otherwise(high)).withColumn("_wide", F.when(hidden, 0).otherwise(wide)).withColumn("state", state)
    return out.withColumn("row_span", F.col("_high")).withColumn("column_span", F.col("_wide")).drop("cut", "lost", "any_lost", "_high", "_wide")


def grid_gaps(placed: DataFrame, table: list[str]) -> DataFrame:
    """Squares (row, column) of each table's grid that no placed cell covers, one row for each."""
    shown = placed.filter("state <> 'hidden'")
    bounds = shown.groupBy(*table).agg(F.max(F.col("row") + F.col("row_span") - 1).alias("rows"), F.max(F.col("column") + F.col("column_span") - 1).alias("columns"))
    steps = lambda a, b: F.explode(F.sequence(a, b))
    every = bounds.withColumn("row", steps(F.lit(1), F.col("rows"))).withColumn("column", steps(F.lit(1), F.col("columns"))).select(*table, "row", "column")
    taken = shown.withColumn("r", steps(F.col("row"), F.col("row") + F.col("row_span") - 1))
    taken = taken.withColumn("c", steps(F.col("column"), F.col("column") + F.col("column_span") - 1))
    return every.join(taken.select(*table, F.col("r").alias("row"), F.col("c").alias("column")).distinct(), [*table, "row", "column"], "left_anti")


def nodes(table: DataFrame, version: str = "1") -> DataFrame:
    """The readable nodes of all pages: a node for each element with text, one for each cell that its table shows.

    doc_id, page_number, element_order, cell_order (null for elements), kind, element_id, node_id, block_id, text, row,
    column, row_span, column_span.
    """
    found = stage(_placed_elements(table), "placed")
    place = ["row", "column", "row_span", "column_span"]
    nothing = F.lit(None).cast("int")
    node = ["doc_id", "page_number", "element_order", "cell_order", "kind", "block_id", *place]
    plain = _piece_rows(found.filter("kind <> 'table'")).select(
        *(nothing.alias(c) if c in ("cell_order", *place) else c for c in node), nothing.alias("r"), nothing.alias("c"), F.lit(None).cast("string").alias("cell"), "n", "id"
    )
    grid = stage(ocr.cell_grid(table), "grid")
    shown = placed_cells(ocr.merged_cells(grid), ["doc_id", "Page", "table_id"]).filter("state <> 'hidden'").drop("Page", "state")
    cells = found.filter("kind = 'table'").select("doc_id", "page_number", "element_order", F.col("block_id").alias("table_id")).join(shown, ["doc_id", "table_id"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_number", "element_order").orderBy("row", "column", "merge_id")) - 1
    parts = grid.select("doc_id", "table_id", "merge_id", F.col("RowIndex").alias("r"), F.col("ColumnIndex").alias("c"), F.col("Id").alias("cell"), "own")
    cells = cells.withColumn("cell_order", nth).join(parts, ["doc_id", "table_id", "merge_id"])
    words = ocr.edges(table.filter("BlockType = 'CELL' AND Text IS NULL")).select("doc_id", F.col("parent").alias("cell"), F.col("order").alias("n"), "child")
    cells = cells.join(words, ["doc_id", "cell"], "left")
    cells = cells.withColumn("id", F.when(F.col("own"), F.col("cell")).otherwise(F.col("child"))).withColumn("kind", F.lit("CELL"))
    cells = cells.withColumn("block_id", F.col("merge_id")).select(*node, "r", "c", "cell", "n", "id")
    rows = _with_texts(plain.unionByName(cells), table).groupBy(*node, "r", "c", "cell").agg(_joined("n", "t").alias("t"))
    said = F.when(F.col("t") != "", F.col("t"))
    rows = rows.withColumn("t", said).groupBy(*node).agg(_joined("r", "c", "t").alias("text"))
    out = ocr.node_ids(rows.withColumn("path", F.format_string("pages[%d].elements[%d]", "page_number", "element_order")), version)
    in_table = F.when(F.col("cell_order").isNotNull(), F.concat("path", F.format_string(".cells[%d]", "cell_order"))).otherwise(F.col("path"))
    out = ocr.node_ids(out.withColumnRenamed("node_id", "element_id").withColumn("path", in_table), version)
    return out.select(*node[:4], "kind", "element_id", "node_id", "block_id", "text", *place)


def _attr(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), escape_html(value.cast("string")), F.lit('"'))


def page_html(found: DataFrame, html: str | None = None) -> DataFrame:
    """doc_id, page_number and the page's section from its nodes; ``html`` names a column of ready inner markup."""
    inner = F.col(html) if html else F.replace(escape_html(F.col("text")), F.lit("\n"), F.lit("<br>"))
    named = F.concat(_attr("data-node-id", F.col("node_id")), _attr("data-source-id", F.col("block_id")))
    tag = F.when(F.col("kind") == "title", "h2").when(F.col("kind") == "section_heading", "h3").otherwise("p")
    plain = F.concat(F.lit("<"), tag, named, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))
    spans = F.concat(*(_attr(a, F.col(c)) for a, c in (("rowspan", "row_span"), ("colspan", "column_span"), ("data-row", "row"), ("data-column", "column"))))
    cell = F.concat(F.lit("<td"), spans, named, F.lit(">"), inner, F.lit("</td>"))
    joined = lambda c, *keys: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, c))), lambda x: x[c]), "")
    page = ["doc_id", "page_number"]
    # All groupings below, and the documents made of pages, are of rows that this one exchange has brought together.
    found = found.repartition("doc_id").withColumn("piece", F.when(F.col("cell_order").isNull(), plain).otherwise(cell))
    rows = found.groupBy(*page, "element_order", "element_id", "row").agg(joined("piece", "cell_order").alias("piece"), F.first("kind").alias("kind"))
    rows = rows.withColumn("piece", F.when(F.col("row").isNotNull(), F.concat(F.lit("<tr>"), "piece", F.lit("</tr>"))).otherwise(F.col("piece")))
    whole = rows.groupBy(*page, "element_order", "element_id").agg(joined("piece", "row").alias("piece"), F.first("kind").alias("kind"), F.max("row").alias("row"))
    body = F.when(
        F.col("row").isNotNull(), F.concat(F.lit("<table"), _attr("data-table-id", F.col("element_id")), F.lit("><tbody>"), "piece", F.lit("</tbody></table>"))
    ).otherwise(F.col("piece"))
    kind = F.when(F.col("row").isNotNull(), "table").otherwise(F.col("kind"))
    article = F.concat(F.lit('<article class="element"'), _attr("data-kind", kind), _attr("data-element-id", F.col("element_id")), F.lit(">"), body, F.lit("</article>"))
    pages = whole.withColumn("article", article).groupBy(*page).agg(joined("article", "element_order").alias("html"))
    head = F.format_string('<section class="page" id="source-page-%d" data-page="%d">', "page_number", "page_number")
    return pages.select(*page, F.concat(head, "html", F.lit("</section>")).alias("html"))


def marked_pages(found: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, page_number and html of pages whose nodes show their findings.

    ``findings`` has doc_id, node_id, finding_id, component, start, end, removed and evidence, as ``findings.project``
    gives them; what is removed, or has no evidence in a node, shows nothing. A page without findings is as it was.
    """
    node = ["doc_id", "page_number", "node_id"]
    shown = active_highlights(findings).select("doc_id", "node_id", "finding_id", "category", "start", "end")
    spans = shown.join(found.select(*node), ["doc_id", "node_id"])
    html = marked_text(found.select(*node, "text"), spans, node).select(*node, F.col("html").alias("inner"))
    return page_html(found.join(html, node), "inner")


def document_html(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id and html of whole reviewed documents; ``facts`` has doc_id, revision_id, generation and status."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "html"))), lambda x: x["html"]), "\n")
    whole = pages.groupBy("doc_id").agg(joined.alias("html")).join(facts, "doc_id")
    return whole.select("doc_id", F.concat(*document_head(), F.lit("\n<body><main>"), "html", F.lit("</main></body>\n</html>\n")).alias("html"))


def document_head() -> list[Column]:
    """The opening of a reviewed document from doc_id, revision_id, generation and status."""
    values = [F.lit("1"), *map(F.col, ("doc_id", "revision_id", "generation", "status"))]
    return [F.lit("<!doctype html>\n<html"), *(_attr(n, v) for n, v in zip(ROOT, values, strict=True)), F.lit(">")]
