"""Requests and their fingerprints, values with the streams beside them, pages with marks, counts of a run."""

import pytest
from pyspark.sql import functions as F

from docsieve.operators import assembly
from docsieve.plans import runner
from docsieve.session import stage_path
from docsieve.sources.schemas import CATALOGUE

BLOCK = "doc_id string, node_id string, page_number int, block_order int, text string"


def equipment(spark, *rows):
    cols = CATALOGUE["equipment"]
    return spark.createDataFrame([tuple(r.get(c, "") for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))


def test_requests():
    r = runner.load_request('{"presets": ["materials"], "fuzzy": true}')
    assert r.resolved() == ["materials"] and r.fuzzy and r.fingerprint() == runner.load_request('{"fuzzy": true, "components": ["materials"]}').fingerprint()
    assert len({r.fingerprint(), runner.Request(["materials"]).fingerprint(), runner.Request(["full"]).fingerprint(), runner.Request(["materials"], pages=object()).fingerprint()}) == 4
    for bad in ("", "[]", '{"presets": ["materials"], "presets": []}', '{"preset": []}', '{"fuzzy": 1}', '{"presets": "full"}', '{"components": [1]}'):
        with pytest.raises(ValueError, match="INVALID_CONFIGURATION"):
            runner.load_request(bad)
    with pytest.raises(ValueError, match="INVALID_SELECTION"):
        runner.load_request('{"presets": ["none"]}')


def test_values_with_their_streams(spark):
    tables = {"equipment": equipment(spark, {"row_id": "E1", "Equipment type (EN)": "Mixer", "Operating parameter (EN)": "Mixing speed", "Unit": "rpm"})}
    rows = [("d", "a", 1, 0, "Mixing  Speed of 20 rpm, then 5 kg"), ("d", "b", 1, 1, "no numbers"), ("e", "a", 1, 0, "set 3.5 g; mixing speed: 7 rpm"), ("e", "b", 1, 1, None)]
    found = runner.parameter_unit_values(tables, spark.createDataFrame(rows, BLOCK)).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.raw, r.unit_name, r.parameter_name) for r in found] == [
        ("d", "20 rpm", "rpm", "Mixing speed"), ("d", "5 kg", "kg", "Mixing speed"), ("e", "3.5 g", "g", None), ("e", "7 rpm", "rpm", "Mixing speed"),
    ]
    assert {r.parameter_name for r in runner.parameter_unit_values({}, spark.createDataFrame(rows, BLOCK)).collect()} == {None}


def test_counts_ride_the_write(spark):
    tables = {"equipment": equipment(spark, {"row_id": "E1", "Equipment type (EN)": "Mixer", "Operating parameter (EN)": "Speed", "Unit": "rpm"}, {"row_id": "E2", "Equipment type (EN)": "Mixer"})}
    blocks = spark.createDataFrame([("d", "a", 1, 0, "Mixer"), ("d", "b", 2, 1, "the mixer"), ("d", "c", 3, 2, "speed")], BLOCK)
    path = stage_path(spark, "run")
    made = runner.run(tables, blocks, runner.Request(components=["equipment", "parameter_names"]), path, "r1")
    by = {c["component"]: c for c in made["components"]}
    assert by["equipment"]["occurrences"] == 2 and by["equipment"]["counts"] == {"exact": 1, "normalized_exact": 1, "fuzzy": 0, "unresolved": 2}
    assert by["parameter_names"]["occurrences"] == 1 and made["configuration_sha256"] == runner.Request(components=["equipment", "parameter_names"]).fingerprint()
    _, parts = runner.open_run(spark, path, "r1")
    assert parts["equipment"].count() == 2


def test_marked_pages(spark):
    nodes = spark.createDataFrame(
        [("d", 1, 0, None, "text", "e1", "n1", "b1", "a <b> c", None, None, None, None), ("d", 1, 1, 0, "CELL", "e2", "n2", "b2", "cell", 1, 1, 1, 1), ("d", 2, 0, None, "title", "e3", "n3", "b3", "none", None, None, None, None)],
        "doc_id string, page_number int, element_order int, cell_order int, kind string, element_id string, node_id string, block_id string, text string, row int, column int, row_span int, column_span int",
    )
    rows = [("d", "n1", "f1", "materials", 2, 5, False, "document_evidence"), ("d", "n1", "f2", "units", 3, 7, False, "document_evidence"), ("d", "n1", "f3", "units", 0, 1, True, "document_evidence"),
            ("d", "n3", "f4", "units", 0, 4, False, "no_evidence"), ("d", None, "f5", "units", 0, 4, False, "document_evidence"), ("d", "n2", "f6", "units", 0, 99, False, "document_evidence")]
    found = spark.createDataFrame(rows, "doc_id string, node_id string, finding_id string, component string, start int, end int, removed boolean, evidence string")
    pages = {r.page_number: r.html for r in assembly.marked_pages(nodes, found).collect()}
    plain = {r.page_number: r.html for r in assembly.page_html(nodes).collect()}
    assert pages[2] == plain[2] and "<mark" not in pages[2]
    inner = (
        'a <mark class="bl-hit materials" data-finding-id="f1" tabindex="-1">&lt;</mark><mark class="bl-hit materials units" data-finding-id="f1 f2" tabindex="-1">b&gt;</mark>'
        '<mark class="bl-hit units" data-finding-id="f2" tabindex="-1"> c</mark>'
    )
    assert pages[1] == plain[1].replace("a &lt;b&gt; c", inner) and F.col("x") is not None
