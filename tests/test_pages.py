"""Sweeps, trees, grids and page assembly against brute force."""

import html as H
import random

import pytest
from pyspark.sql import functions as F

from docsieve.operators import assembly, sweep, trees
from docsieve.sources import ocr, reviewed_html


def covered(spans):
    """All pieces by trying every pair of edges and span."""
    out = {}
    for page in {s[0] for s in spans}:
        own = [s for s in spans if s[0] == page and None not in s[1:] and s[3] > s[2]]
        edges = sorted({x for s in own for x in s[2:]})
        for a, b in zip(edges, edges[1:], strict=False):
            ids = sorted({s[1] for s in own if s[2] <= a and s[3] >= b})
            if ids:
                out[page, a, b] = ids
    return out


def test_segments(spark):
    rng = random.Random(4)
    spans = [(rng.choice(["p", "q", None]), f"f{rng.randint(0, 30)}", a := rng.randint(0, 90), a + rng.randint(-1, 40)) for _ in range(150)]
    spans += [("long", f"g{k}", k, k + rng.choice([1, 3, 1500])) for k in range(1200)] + [("p", None, 1, 2), ("p", "x", None, 2), ("r", "one", 5, 9), spans[0]]
    table = spark.createDataFrame(spans, "page string, finding_id string, start int, end int").repartition(6)
    want = covered(spans)
    for parts in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sweep.segments(table, ["page"]).collect()
        assert {(r.page, r["from"], r.to): r.names for r in got} == want and len(got) == len(want)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sweep.segments(table.filter("false"), ["page"]).count() == 0


def test_long_page(spark):
    n = 200_000
    spans = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("finding_id"), F.col("id").alias("start"), (F.col("id") + 3).alias("end"))
    r = sweep.segments(spans, ["page"]).agg(F.count("*").alias("n"), F.sum(F.size("names")).alias("covers"), F.max(F.size("names")).alias("most")).first()
    assert (r.n, r.covers, r.most) == (n + 2, 3 * n, 3)


def test_marked_text(spark):
    rng = random.Random(9)
    texts = {f"n{k}": "".join(rng.choice("ab<&\n\"' é") for _ in range(rng.randint(0, 30))) for k in range(40)} | {"plain": "x < y\nz", "none": ""}
    spans = []
    for n, t in texts.items():
        for k in range(rng.randint(0, 5) if n.startswith("n") else 0):
            a = rng.randint(0, 30)
            spans.append((n, f"f{k}", rng.choice(["m", "u", "e"]), a, a + rng.randint(0, 12)))
    found = sweep.marked_text(
        spark.createDataFrame(list(texts.items()), "node_id string, text string"),
        spark.createDataFrame(spans, "node_id string, finding_id string, category string, start int, end int"), ["node_id"],
    )
    safe = lambda t: "".join("<br>" if c == "\n" else H.escape(c) for c in t)
    for r in found.collect():
        own = [s for s in spans if s[0] == r.node_id and s[4] > s[3] and s[4] <= len(r.text)]
        cuts = sorted({0, len(r.text), *(x for s in own for x in s[3:])})
        want = ""
        for a, b in zip(cuts, cuts[1:], strict=False):
            over = [s for s in own if s[3] <= a and s[4] >= b]
            body = safe(r.text[a:b])
            if over:
                kinds = " ".join(["bl-hit", *sorted({s[2] for s in over})])
                body = f'<mark class="{kinds}" data-finding-id="{" ".join(sorted({s[1] for s in over}))}" tabindex="-1">{body}</mark>'
            want += body
        assert r.html == want


def test_tree_paths_and_folds(spark):
    rng = random.Random(3)
    nodes = [("t", 0, None, 0)] + [("t", k, rng.randrange(max(0, k - 9), k), rng.randint(0, 3)) for k in range(1, 120)] + [("u", 5, 99, 2), ("u", 6, 5, 1)]
    table = spark.createDataFrame(nodes, "tree string, id int, parent int, place int")
    found = trees.fold_up(trees.with_paths(table, ["tree"]), ["tree"], F.concat(F.lit("("), F.col("id").cast("string"), F.array_join("children", ""), F.lit(")")), "said")
    by = {(t, i): (p, o) for t, i, p, o in nodes}

    def path(t, i):
        p, o = by[t, i]
        return [*(path(t, p) if (t, p) in by else []), o]

    def said(t, i):
        below = sorted((o, j) for (s, j), (p, o) in by.items() if s == t and p == i)
        return f"({i}{''.join(said(t, j) for _, j in below)})"

    got = {(r.tree, r.id): (r.depth, r.path, r.said) for r in found.collect()}
    assert got == {k: (len(path(*k)) - 1, path(*k), said(*k)) for k in by}
    with pytest.raises(ValueError, match="RELATIONSHIP_GRAPH"):
        trees.with_paths(spark.createDataFrame([("t", 1, 2, 0), ("t", 2, 1, 0)], table.schema), ["tree"])
    assert trees.with_paths(table.filter("false"), ["tree"]).count() == 0


def test_cells_on_a_grid(spark):
    rng = random.Random(6)
    rows = [(t, f"c{k}", rng.randint(1, 4), rng.randint(1, 4), rng.randint(1, 3), rng.randint(1, 3)) for t in range(30) for k in range(6)]
    table = spark.createDataFrame([(*r, "clash", True) for r in rows], "table_id int, cell string, row int, column int, row_span int, column_span int, lost string, r boolean").drop("lost", "r")
    placed = assembly.placed_cells(table, ["table_id"], "cell")
    got = {(r.table_id, r.cell): (r.row_span, r.column_span, r.state) for r in placed.collect()}
    gaps = {(r.table_id, r.row, r.column) for r in assembly.grid_gaps(placed, ["table_id"]).collect()}
    want, holes = {}, set()
    for t in range(30):
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[3], r[1]))
        taken = {}
        for r in own:
            for i in range(r[4]):
                for j in range(r[5]):
                    taken.setdefault((r[2] + i, r[3] + j), r[1])
        squares = set()
        for r in own:
            lost = {(i, j) for i in range(r[4]) for j in range(r[5]) if taken[r[2] + i, r[3] + j] != r[1]}
            wide = min([j for i, j in lost if i == 0], default=r[5])
            high = min([i for i, j in lost if j < wide], default=r[4])
            want[t, r[1]] = (0, 0, "hidden") if not wide else (high, wide, "clipped" if lost else "placed")
            squares |= {(r[2] + i, r[3] + j) for i in range(high if wide else 0) for j in range(wide)}
        holes |= {(t, i, j) for i in range(1, max(a for a, _ in squares) + 1) for j in range(1, max(b for _, b in squares) + 1)} - {(t, *s) for s in squares}
    assert got == want and gaps == holes


def block(doc, k, id, kind, page=1, text=None, children=(), row=None, column=None, top=None, left=None, merged=()):
    box = None if top is None else ((left or 0.0, top, 0.1, 0.1),)
    related = [("CHILD", list(children))] if children else []
    return (doc, k, id, kind, page, text, row, column, 1, 1, None, None, 99.0, box, related or None)


BLOCKS = "doc_id string, position int, " + ", ".join(x.replace(":", " ", 1) for x in [
    "Id:string", "BlockType:string", "Page:int", "Text:string", "RowIndex:int", "ColumnIndex:int", "RowSpan:int", "ColumnSpan:int", "SelectionStatus:string",
    "EntityTypes:array<string>", "Confidence:double", f"Geometry:struct<BoundingBox:{ocr.BOX}>", "Relationships:array<struct<Type:string,Ids:array<string>>>",
])


@pytest.fixture(scope="module")
def response(spark):
    rows = [
        block("d", 0, "p1", "PAGE", children=["h", "f"]),
        block("d", 1, "h", "LAYOUT_TITLE", children=["l1", "l2"]), block("d", 2, "l2", "LINE", text="Title <b>"), block("d", 3, "l1", "LINE", text="A"),
        block("d", 4, "lt", "LAYOUT_TABLE", children=["t2", "t1"]), block("d", 5, "lu", "LAYOUT_TABLE", children=["t1"]),
        block("d", 6, "t1", "TABLE", children=["c1", "c2", "c3"]), block("d", 7, "t2", "TABLE", children=["c4"]),
        block("d", 8, "c1", "CELL", row=1, column=1, children=["w1"]), block("d", 9, "c2", "CELL", row=1, column=2, children=["w2"]),
        block("d", 10, "c3", "CELL", row=2, column=1, children=["w3"]), block("d", 11, "c4", "CELL", row=1, column=1),
        *(block("d", 11 + k, f"w{k}", "WORD", text=f"word{k}") for k in range(1, 6)),
        block("d", 20, "m", "MERGED_CELL", children=["c1", "c3"]),
        block("d", 21, "in", "LINE", text="word1 word2", children=["w1", "w2"], top=0.1), block("d", 22, "part", "LINE", text="word2 word4", children=["w2", "w4"], top=0.9),
        block("d", 23, "up", "LINE", text="upper", children=["w5"], top=0.2), block("d", 24, "wordless", "LINE", text="no words", top=0.0),
        block("d", 25, "f", "LAYOUT_FIGURE", children=["fl"]), block("d", 26, "fl", "LINE", text="in a figure", children=["w4"]),
        block("d", 27, "lo", "LAYOUT_TABLE", children=["l3"]), block("d", 28, "l3", "LINE", text="as text", children=["w5"]),
        block("d", 29, "free", "TABLE", children=["c5"], top=0.5), block("d", 30, "free2", "TABLE", top=0.4), block("d", 31, "c5", "CELL", row=1, column=1),
        block("d", 32, "e", "LAYOUT_TEXT"), block("d", 33, "list", "LAYOUT_LIST", page=2, children=["x2", "x1"]),
        block("d", 34, "x1", "LAYOUT_TEXT", page=2, children=["l5"]), block("d", 35, "x2", "LAYOUT_TEXT", page=2, children=["l6", "l7"]),
        *(block("d", 36 + k, f"l{5 + k}", "LINE", page=2, text=f"item {5 + k}", children=["w4"]) for k in range(3)),
    ]
    return spark.createDataFrame(rows, BLOCKS)


def test_elements_in_reading_order(spark, response):
    got = [(r.page_number, r.element_order, r.kind, r.block_id, r.text) for r in assembly.elements(response).orderBy("page_number", "element_order").collect()]
    assert got == [
        (1, 0, "title", "h", "A Title <b>"), (1, 1, "table", "t2", None), (1, 2, "table", "t1", None), (1, 3, "table_region", "lo", "as text"),
        (1, 4, "table", "free2", None), (1, 5, "table", "free", None), (1, 6, "text", "up", "upper"), (1, 7, "text", "part", "word2 word4"),
        (1, 8, "text", "fl", "in a figure"), (2, 0, "text", "list", "item 6 item 7 item 5"),
    ]
    assert [tuple(r) for r in assembly.warnings(response).collect()] == [("d", "UNINTERPRETED_LAYOUT_FIGURE", "f")]
    assert assembly.elements(response.filter("false")).count() == 0


def test_nodes_read_back(spark, response):
    found = assembly.nodes(response)
    facts = spark.createDataFrame([("d", "r1", 1, "SUCCEEDED")], "doc_id string, revision_id string, generation int, status string")
    files = assembly.document_html(assembly.page_html(found), facts)
    back = reviewed_html.read_blocks(files.select("doc_id", F.encode("html", "UTF-8").alias("content"))).orderBy("page_order", "block_order").collect()
    assert {r.error_code for r in back} == {None} and {r.job_id for r in back} == {"d"}
    want = found.orderBy("page_number", "element_order", "cell_order").collect()
    cell = lambda r: None if r.row is None else (r.row, r.column, r.row_span, r.column_span)
    assert [(r.page_number, r.node_id, r.text, r.element_id, tuple(r.cell) if r.cell else None, r.ocr[0].block_id) for r in back] == [
        (r.page_number, r.node_id, r.text, r.element_id, cell(r), r.block_id) for r in want
    ]
    cells = {r.block_id: (r.row, r.column, r.row_span, r.column_span, r.text) for r in want if r.row}
    assert cells["m"] == (1, 1, 2, 1, "word1 word3") and cells["c2"] == (1, 2, 1, 1, "word2")
    assert len({r.node_id for r in want}) == len(want)


def test_layout_moves_ids_not_texts(response):
    forest = assembly.layout_forest(response)
    assert "text" not in forest.columns and "said" not in forest.columns
    got = {r.id: r.pieces for r in forest.collect()}
    assert (got["h"], got["list"], got["e"], got["l5"]) == (["l1", "l2"], ["l6", "l7", "l5"], [], ["l5"])


def test_cells_with_own_texts_and_marks(spark):
    rows = [
        block("d", 0, "t", "TABLE", children=["c1", "c2", "c3"], top=0.1), block("d", 1, "c1", "CELL", text="own", row=1, column=1, children=["w1", "w2"]),
        block("d", 2, "c2", "CELL", row=1, column=2, children=["w2", "s"]), block("d", 3, "c3", "CELL", row=2, column=1),
        block("d", 4, "w1", "WORD", text="a"), block("d", 5, "w2", "WORD", text="b"), block("d", 6, "s", "SELECTION_ELEMENT"),
    ]
    got = {r.block_id: r.text for r in assembly.nodes(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == {"c1": "own", "c2": "b ☐", "c3": ""}
