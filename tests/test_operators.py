import json

import pytest
from pyspark.sql import functions as F

from docsieve.operators import classification, graph, paging, review
from docsieve.plans import runner
from docsieve.session import stage_path
from docsieve.sources import catalogue, ocr, reviewed_html
from docsieve.sources.schemas import CATALOGUE
from docsieve.streaming import jobs


def test_html_errors():
    good = reviewed_html.render({"job_id": "j", "revision_id": "r", "generation": 0, "status": "SUCCEEDED"}, [(1, [{"node_id": "a", "element_id": "a", "kind": "text", "text": "x & y\nz"}])])
    rows = reviewed_html.block_rows("d", good.encode())
    assert [(r["page_number"], r["text"], r["error_code"]) for r in rows] == [(1, "x & y\nz", None)]
    code = lambda t: reviewed_html.block_rows("d", t.encode())[0]["error_code"]
    assert code(good.replace("</html>", "")) == "TRUNCATED_HTML"
    assert code(good.replace('version="1"', 'version="2"')) == "UNSUPPORTED_HTML_VERSION"
    assert code(good.replace('generation="0"', 'generation="-1"')) == "INVALID_HTML_METADATA"
    assert code(good.replace("source-page-1", "page-1")) == "INVALID_PAGE_STRUCTURE"
    assert code(good.replace("</p>", "</b>")) == "MALFORMED_HTML"
    assert code(good.replace(">x", "><b>x</b>")) == "UNSUPPORTED_SOURCE_ELEMENT"
    assert code("") == "MISSING_HTML_METADATA"
    assert reviewed_html.block_rows("d", b"\xff")[0]["error_code"] == "INVALID_ENCODING"


def test_catalogue_csv_sqlite_snapshot(spark, tmp_path):
    import sqlite3

    cols = CATALOGUE["materials_fda_ema"]
    file = tmp_path / "m.csv"
    rows = [{"row_id": "1", "material_name": 'a "b", c', "alias_name": "NA"}, {}, {"row_id": "2", "SMS_ID": "000123", "material_name": "x\ny"}]
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    file.write_text("﻿" + "\n".join([",".join(cols), *(",".join(quote(r.get(c, "")) for c in cols) for r in rows)]) + "\n", encoding="utf-8")
    table = catalogue.read_csv(spark, str(file), cols)
    clean = catalogue.clean_rows(table)
    assert sorted((r.row_id, r.material_name, r.SMS_ID, r.UNII) for r in clean.collect()) == [("1", 'a "b", c', "", ""), ("2", "x\ny", "000123", "")]
    path = stage_path(spark, "snapshot")
    made = catalogue.build_snapshot({"materials_fda_ema": table}, path)
    assert made["snapshot_id"].startswith("flat-v1-") and catalogue.open_snapshot(spark, path)["materials_fda_ema"].count() == 2
    twice = table.unionByName(table)
    with pytest.raises(catalogue.CatalogueError, match="DUPLICATE_ROW_ID"):
        catalogue.build_snapshot({"materials_fda_ema": twice}, stage_path(spark, "snapshot"))
    db = tmp_path / "c.sqlite"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE materials_fda_ema (" + ", ".join(f'"{x}" TEXT NOT NULL' for x in cols) + ")")
        c.executemany(f"INSERT INTO materials_fda_ema VALUES ({','.join('?' * len(cols))})", [tuple(f"{x}{k}" for x in cols) for k in range(25)])
    spark.dataSource.register(catalogue.FlatSqlite)
    got = spark.read.format("flat_sqlite").option("table", "materials_fda_ema").option("partitions", 4).option("path", str(db)).load()
    assert got.count() == 25 and got.rdd.getNumPartitions() > 1 and got.select(F.max("scan_cursor")).first()[0] == 25


def test_classification(spark):
    def page(n, *calls):
        return [("d", n, k + 1, a, s, ls) for k, (a, s, ls) in enumerate(calls)]

    ok = lambda *x: ("valid", "ok", list(x))
    empty, asks = ("valid", "empty", []), ("valid", "needs_review", [])
    rows = [
        *page(1, ok("COVER_PAGE"), ok("COVER_PAGE"), ok()), *page(2, ok("COVER_PAGE"), ok("MATERIALS"), ok()), *page(3, empty, empty, empty),
        *page(4, empty, ok("X"), ok()), *page(5, ok(), ok(), ok()), *page(6, asks, ok("X"), ok()), *page(7, ("failed", None, []), ok("X"), ok()),
        *page(8, ok("COVER_PAGE"), ok(), ok()),
    ]
    calls = spark.createDataFrame(rows, "doc_id string, page_number int, call_id int, availability string, status string, labels array<string>")
    bad = spark.createDataFrame([("d", 8)], "doc_id string, page_number int")
    got = {r.page_number: (r.kind, r.eligible, r.requires_review) for r in classification.eligibility(classification.merge_pages(calls, bad)).collect()}
    assert got == {1: ("completed", False, False), 2: ("completed", True, False), 3: ("empty", True, False), 4: ("needs_review", True, True),
                   5: ("needs_review", True, True), 6: ("needs_review", True, True), 7: ("incomplete", True, False), 8: ("needs_review", True, True)}
    evidence = spark.createDataFrame([("d", 1, "A &amp; B", None), ("d", 1, " ", None), ("d", 1, "C", None), ("d", 1, "A", "e"), ("d", 1, "B", "e"), ("d", 1, "B", "z")],
                                     "doc_id string, page_number int, quote string, element_id string")
    pages = spark.createDataFrame([("d", 1, "x A  &amp;\nB")], "doc_id string, page_number int, readable_text string")
    elements = spark.createDataFrame([("d", 1, "e", "A only", False)], "doc_id string, page_number int, element_id string, text string, ambiguous boolean")
    checked = classification.check_quotes(evidence, pages, elements).collect()
    assert {(r.quote, r.element_id): r.verification for r in checked} == {("A &amp; B", None): "verified", (" ", None): "unverified", ("C", None): "unverified",
                                                                           ("A", "e"): "verified", ("B", "e"): "unverified", ("B", "z"): "unverified"}


def test_edit_fold(spark):
    findings = spark.createDataFrame([("r", 0, "a", "materials", "x", 1, "document_evidence", False, "lexical"), ("s", 0, "a", "materials", "x", 1, "document_evidence", True, "lexical")],
                                     f"review_id string, position int, {review.FINDING}")
    schema = "review_id string, seq int, op string, finding_id string, component string, display_text string, page int, evidence string"
    edits = spark.createDataFrame([("r", 1, "patch", "a", None, "y", None, None), ("r", 2, "add", "b", "units", "kg", None, "user_claim"), ("r", 3, "remove", "a", None, None, None, None),
                                   ("s", 1, "patch", "a", None, "y", None, None)], schema)
    got = sorted((r.review_id, r.position, r.finding_id, r.display_text, r.removed, r.origin, r.outcome) for r in review.fold_edits(findings, edits).collect())
    assert got == [("r", 0, "a", "y", True, "lexical", "changed"), ("r", 1, "b", "kg", False, "user", "changed"), ("s", 0, "a", "x", True, "lexical", "FINDING_REMOVED")]


def test_jobs_fold_equals_stream(spark, tmp_path):
    events = [("j", 0, 0, "busy", None), ("j", 10, 1, "started", None), ("j", 20, 2, "done", None), ("j", 30, 3, "retryable", "E"), ("j", 40, 4, "retryable", "E"), ("j", 60, 5, "done", None),
              ("j", 61, 6, "done", None), ("j", 62, 7, "done", None), ("j", 63, 8, "done", None), ("j", 64, 9, "fatal", None), ("k", 0, 0, "started", None), ("k", 9999, 1, "fatal", "X"), ("k", 10000, 2, "retry", None)]
    schema = "job_id string, at long, seq int, event string, error string"
    table = spark.createDataFrame(events, schema)
    got = sorted(map(tuple, jobs.fold(table).collect()), key=str)
    assert [r[4] for r in got if r[0] == "j"][-1] == "SUCCEEDED" and ("k", 10000, "retry", "FAILED", "QUEUED", 10000, 0, None, 3) in got
    assert ("j", 40, "retryable", "SUBMITTING", "SUBMITTING", 60, 2, "E", 4) in got
    table.coalesce(1).write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    q = jobs.stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("moves").collect()), key=str) == got
    assert [r.job_id for r in jobs.wake_ups(jobs.fold(table), 20000).collect()] == ["k"]


def test_ocr_cells(spark, tmp_path):
    blocks = [
        {"Id": "t", "BlockType": "TABLE", "Page": 1, "Relationships": [{"Type": "CHILD", "Ids": ["c1", "c2", "c3"]}]},
        {"Id": "c1", "BlockType": "CELL", "Page": 1, "RowIndex": 1, "ColumnIndex": 1, "RowSpan": 1, "ColumnSpan": 1, "Relationships": [{"Type": "CHILD", "Ids": ["w1", "w2"]}]},
        {"Id": "c2", "BlockType": "CELL", "Page": 1, "RowIndex": 1, "ColumnIndex": 2, "RowSpan": 1, "ColumnSpan": 1, "Relationships": [{"Type": "CHILD", "Ids": ["s"]}]},
        {"Id": "c3", "BlockType": "CELL", "Page": 1, "RowIndex": 2, "ColumnIndex": 1, "RowSpan": 1, "ColumnSpan": 1},
        {"Id": "m", "BlockType": "MERGED_CELL", "Page": 1, "Relationships": [{"Type": "CHILD", "Ids": ["c1", "c2"]}]},
        {"Id": "w1", "BlockType": "WORD", "Page": 1, "Text": "one"}, {"Id": "w2", "BlockType": "WORD", "Page": 1, "Text": "two"},
        {"Id": "s", "BlockType": "SELECTION_ELEMENT", "Page": 1, "SelectionStatus": "NOT_SELECTED"},
        {"Id": "l", "BlockType": "LINE", "Page": 1, "Text": "free"},
    ]
    (tmp_path / "r.json").write_text(json.dumps({"JobStatus": "SUCCEEDED", "DocumentMetadata": {"Pages": 1}, "Blocks": blocks}))
    responses = ocr.read_responses(spark, str(tmp_path / "r.json"))
    assert ocr.violations(responses).isEmpty()
    table = ocr.blocks(responses)
    assert sorted((r.row, r.column, r.row_span, r.column_span, r.text) for r in ocr.cells(table).collect()) == [(1, 1, 1, 2, "one two ☐"), (2, 1, 1, 1, "")]
    assert [r.Text for r in ocr.uncovered_lines(table).collect()] == ["free"]


def test_graph_cycle(spark):
    assert {(r.node, r.depth) for r in graph.depths(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "parent string, child string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError, match="cycle"):
        graph.depths(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "parent string, child string"))


def test_descendants_below_64_edges(spark):
    rows = [(f"n{k}", f"n{k + 1}") for k in range(70)] + [("x", "y"), ("y", "x"), ("y", "n68"), (None, "n0")]
    edges = spark.createDataFrame(rows, "parent string, child string")
    roots = spark.createDataFrame([("n0",), ("x",), ("n70",), ("n0",)], "node string")
    got = sorted((r.root, r.node) for r in graph.descendants(edges, roots).collect())
    assert got == sorted([("n0", f"n{k}") for k in range(1, 71)] + [("x", n) for n in ("x", "y", "n68", "n69", "n70")])


def test_run_isolates_failures(spark):
    blocks = spark.createDataFrame([("d", "n1", 1, 0, "charge 2.5 kg of Water"), ("d", "n2", 2, 0, "sieving done")], "doc_id string, node_id string, page_number int, block_order int, text string")
    cols = {n: ", ".join(f"`{c}` string" for c in CATALOGUE[n]) for n in CATALOGUE}
    row = lambda n, **v: [tuple(v.get(c.replace(" ", "_"), "") for c in CATALOGUE[n])]
    tables = {
        "materials_fda_ema": spark.createDataFrame(row("materials_fda_ema", row_id="1", material_name="Water"), cols["materials_fda_ema"]),
        "unit_operations": spark.createDataFrame([tuple({"row_id": "2", "Search term (EN)": "sieving", "Index this row": "TRUE", "Match policy": "odd"}.get(c, "") for c in CATALOGUE["unit_operations"])], cols["unit_operations"]),
    }
    path = stage_path(spark, "run")
    made = runner.run(tables, blocks, runner.Request(presets=["materials_with_quantities", "unit_operations"]), path, "r1")
    outcomes = {c["component"]: c["outcome"] for c in made["components"]}
    assert outcomes == {"unit_operations": "failed", "materials": "completed", "quantity_expressions": "completed", "units": "completed"} and made["outcome"] == "partial"
    manifest, parts = runner.open_run(spark, path, "r1")
    assert manifest == made and parts["materials"].first().matched_text == "Water" and parts["quantity_expressions"].first().raw == "2.5 kg"
    with pytest.raises(ValueError, match="INVALID_SELECTION"):
        runner.Request(presets=["nothing"]).resolved()


def test_paging(spark):
    table = spark.createDataFrame([(k, k % 3) for k in range(10)], "k int, g int")
    assert [r.k for r in paging.keyset_page(table, "k", 6, 2).collect()] == [7, 8]
    assert [(r.k, r.total) for r in paging.offset_page(table, ["k"], 8, 5).collect()] == [(8, 10), (9, 10)]
    assert paging.newest(table, 1, [F.desc("k")], ["g"]).count() == 3
    assert paging.disagreement(table, table).isEmpty()
    segments = review.highlight_segments(spark.createDataFrame([("p", 0, 5, "a"), ("p", 3, 8, "b"), ("p", 10, 12, "c")], "page string, start int, end int, finding_id string"), ["page"])
    assert sorted((r["from"], r["to"], r.finding_ids) for r in segments.collect()) == [(0, 3, ["a"]), (3, 5, ["a", "b"]), (5, 8, ["b"]), (10, 12, ["c"])]


def test_projection_and_first(spark):
    from docsieve.functions import text

    df = spark.createDataFrame([("Straße  x",)], "t string").withColumn("s", text.surface("t", F.lit(True)))
    r = df.select("s.cmp", text.project(F.col("s"), F.lit(0), F.lit(7)).alias("whole"), text.project(F.col("s"), F.lit(0), F.lit(5)).alias("cut")).first()
    assert r.cmp == "strasse x" and tuple(r.whole) == (0, 6) and r.cut is None
    two = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "finding_id string, o int")
    assert sorted(map(tuple, review.first_by_id(two, ["o"]).collect())) == [("a", 1), ("b", 3)]
