"""OCR responses to documents, with broken ones apart; cycles; findings of warnings."""

import json

from pyspark.sql import functions as F

from docsieve.operators import conversion, trees
from docsieve.sources import ocr, reviewed_html


def block(i, kind, text=None, children=(), page=1, **more):
    out = {"Id": i, "BlockType": kind, "Page": page} | more
    if text is not None:
        out["Text"] = text
    return out | ({"Relationships": [{"Type": "CHILD", "Ids": list(children)}]} if children else {})


def response(blocks, status="SUCCEEDED", pages=1, warnings=()):
    return {"JobStatus": status, "DocumentMetadata": {"Pages": pages}, "Warnings": list(warnings), "Blocks": blocks}


def test_convert(spark, tmp_path):
    title = [block("t", "LAYOUT_TITLE", children=["l"]), block("l", "LINE", "A & B")]
    table = [block("lt", "LAYOUT_TABLE", children=["l2"]), block("l2", "LINE", "Toler. +5 %", page=1)]
    files = {
        "good": response([*title, *table, block("T", "TABLE", children=["c"]), block("c", "CELL", children=["w"], RowIndex=1, ColumnIndex=1), block("w", "WORD", "cell"), block("f", "LAYOUT_FIGURE")]),
        "partial": response([*title, block("p2", "LAYOUT_TEXT", children=["l3"], page=2), block("l3", "LINE", "two", page=2)], "PARTIAL_SUCCESS", 2, [{"ErrorCode": "PAGE", "Pages": [2]}]),
        "circle": response([*title, block("a", "LAYOUT_LIST", children=["b"]), block("b", "LAYOUT_TEXT", children=["a"])]),
        "failed": response(title, "FAILED"), "empty": response([]), "twice": response([*title, title[0]]),
    }
    for name, r in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(r))
    responses = ocr.read_responses(spark, str(tmp_path)).withColumn("doc_id", F.regexp_extract("doc_id", r"(\w+)\.json$", 1))
    made = conversion.convert(responses)
    assert {r.doc_id: r.violation for r in made.problems.collect()} == {"circle": "CYCLIC_RELATIONSHIP", "failed": "INVALID_STATUS", "empty": "NO_BLOCKS", "twice": "DUPLICATE_BLOCK"}
    assert [(r.doc_id, r.page_number, r.kind, r.text) for r in made.nodes.orderBy("doc_id", "page_number", "element_order").collect()] == [
        ("good", 1, "title", "A & B"), ("good", 1, "table_region", "Toler. +5 %"), ("good", 1, "CELL", "cell"), ("partial", 1, "title", "A & B"), ("partial", 2, "text", "two"),
    ]
    back = reviewed_html.read_blocks(made.documents.select("doc_id", F.encode("html", "UTF-8").alias("content"))).collect()
    assert sorted((r.doc_id, r.page_number, r.text, r.status) for r in back) == [
        ("good", 1, "A & B", "SUCCEEDED"), ("good", 1, "Toler. +5 %", "SUCCEEDED"), ("good", 1, "cell", "SUCCEEDED"), ("partial", 1, "A & B", "PARTIAL_SUCCESS"), ("partial", 2, "two", "PARTIAL_SUCCESS"),
    ]
    assert [(r.doc_id, r.code, r.block_ids, r.pages) for r in made.warnings.orderBy("doc_id", "position").collect()] == [
        ("good", "UNINTERPRETED_LAYOUT_FIGURE", ["f"], []), ("good", conversion.TOLERANCE, ["lt"], [1]), ("partial", "AWS_PAGE", [], [2]), ("partial", "PARTIAL_ANALYSIS", [], []),
    ]
    assert {tuple(r) for r in made.counts.collect()} == {("good", 1, 1, 1), ("partial", 2, 0, 0)}
    found = conversion.review_findings(made.warnings, made.nodes, responses.select("doc_id", F.explode("Blocks").alias("b")).select("doc_id", "b.Id", "b.Page"))
    assert [(r.code, r.pages, r.suggested_text) for r in found.filter("doc_id = 'good'").orderBy("position").collect()] == [
        ("UNINTERPRETED_LAYOUT_FIGURE", [1], None), (conversion.TOLERANCE, [1], "Tolerance ±5 %"),
    ]


def test_cyclic_trees(spark):
    rows = [("line", f"n{k}", f"n{k + 1}") for k in range(5)] + [("circle", "a", "b"), ("circle", "b", "c"), ("circle", "c", "b"), ("self", "x", "x"), ("dag", "a", "b"), ("dag", "a", "c"), ("dag", "b", "c")]
    edges = spark.createDataFrame(rows, "tree string, parent string, id string")
    assert {r.tree for r in trees.cyclic_trees(edges, ["tree"]).collect()} == {"circle", "self"}
    assert {r.tree for r in trees.cyclic_trees(edges, ["tree"], 3).collect()} == {"circle", "self", "line"}
    assert trees.cyclic_trees(edges.filter("false"), ["tree"]).count() == 0
