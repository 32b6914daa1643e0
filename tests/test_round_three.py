"""Small tests for the findings of round three."""

import hashlib
import inspect
import os

import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

import __spark_entry__ as entry
from docsieve.functions import text as T
from docsieve.functions import values
from docsieve.operators import conversion, matching, merging, sweep
from docsieve.operators.scanning import FILTER_BITS
from docsieve.plans import queries as plans
from docsieve.sources import history, reviewed_html


def test_capitals_keep_length(spark):
    words = ["straße", "ΐx", "ᾀb", "ŉ", "éà", ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.simple_upper(F.col("w"))).collect()]
    assert got == ["STRAẞE", "ΐX", "ᾈB", "ŉ", "ÉÀ", ""]


def test_claims_are_pairs_of_names(spark, tmp_path):
    spark.createDataFrame([("green bar",), ("green car",), ("red bars",), ("a",)], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in entry.queries()["wrong_distances"](spark, str(tmp_path)).collect()}
    own = {(x, x, False) for x in ("green bar", "green car", "red bars", "a")}
    assert got == own | {(x, y, True) for x, y in (("green bar", "red bars"), ("red bars", "green bar"), ("green car", "red bars"), ("red bars", "green car"))}


def test_many_histories_make_few_files(spark, tmp_path):
    kinds = "revision_id string, parent_revision_id string, generation long"
    rows = [(f"j{k}", f"r{g}", f"r{g - 1}" if g > 1 else None, g) for k in range(300) for g in (1, 2)]
    history.write_histories(spark.createDataFrame(rows, f"job_id string, {kinds}"), str(tmp_path / "h"))
    assert sum(f.startswith("part-") for _, _, files in os.walk(tmp_path) for f in files) < 100
    state, body = history.read_histories(spark, str(tmp_path / "h"), kinds)
    assert state.filter("error_code is null").count() == 300 and sorted(map(tuple, body.collect()), key=str) == sorted(rows, key=str)
    (tmp_path / "h" / "job_id=j7").mkdir()
    (tmp_path / "h" / "job_id=j7" / "part.txt").write_bytes(b"{}\n")
    state, _ = history.read_histories(spark, str(tmp_path / "h"), kinds)
    assert [r.job_id for r in state.filter("error_code is not null").collect()] == ["j7"]


def test_a_large_catalogue_reaches_the_driver_as_bitmaps(spark, sf_dir, monkeypatch):
    keys = matching.keyed_terms(plans.lot_terms(spark, sf_dir)).select("collapse", "key")
    made = matching._filters(keys.mapInArrow(matching._numbered, "collapse boolean, length long, head long, whole long"))
    assert all(b.nbytes == 1 << FILTER_BITS - 3 for f in made.values() for b in f.bits.values())
    notes = plans.order_notes(spark, sf_dir)
    some = lambda n: sorted(tuple(r) for r in matching.exact_hits(plans.lot_terms(spark, sf_dir), notes, n).select("doc_id", "literal", "start", "method").collect())
    few = some(10)
    monkeypatch.setattr(matching, "_dictionaries", None)  # no dictionary is made of many keys
    assert few == some(100) and few
    monkeypatch.undo()
    assert few == some(10**6)


def test_values_of_equal_texts(spark):
    texts = ["add 5 g", None, "", "hold at 20–25 °C"]
    plain, made = values.read_values, values.value_expressions(F.col("t"))
    rows = spark.range(4000).coalesce(1).select(F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("t")).withColumn("v", made)
    got = {(r.t, tuple((v.form, v.raw) for v in r.v)) for r in rows.collect()}
    assert got == {(t, tuple((v["form"], v["raw"]) for v in plain(t, values.Units()))) for t in texts}


def test_streams_merge_without_python(spark):
    b = spark.createDataFrame([("d", 1, None, "a"), ("d", 2, None, None)], "doc_id string, block_order int, node_id string, text string")
    s = b.withColumn("spans", F.lit(None).cast(f"array<{merging.SPAN}>"))
    assert "mapInArrow" not in inspect.getsource(merging)
    rows = merging.merge_streams(b, s, s).collect()
    assert len(rows) == 2 and all(r.error_code is None and r.units == [] == r.parameters for r in rows)
    assert [r.error_code for r in merging.merge_streams(b, s, s.withColumn("node_id", F.lit("n"))).collect()] == [merging.MISMATCH]


def test_texts_are_scanned_in_slices():
    text = pa.array(["ab", None, "c" * 50, "", "é"])
    assert [s.to_pylist() for s in matching._slices(text, 10)] == [["ab", None], ["c" * 50], ["", "é"]]
    assert [s.to_pylist() for s in matching._slices(text.slice(3), 10)] == [["", "é"]] and list(matching._slices(text.slice(0, 0), 10)) == []


def test_unit_blocks_need_no_identity(spark):
    terms = plans._unit_terms(spark)
    blocks = spark.createDataFrame([("a", "1", "5 g and 6 g of 7 ml"), ("a", "1", "5 g"), ("b", "2", "none")], "doc_id string, node_id string, text string")
    assert {tuple(r) for r in matching.unit_blocks(terms, blocks).collect()} == {("g", 2), ("mL", 1), ("ml", 1)}


def test_html_leaves_in_small_frames(spark, monkeypatch):
    sizes = []

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            sizes.extend(len(x) for x in run(iter([pd.DataFrame({"doc_id": ["d"] * 50, "content": [b"x" * 9] * 50})])))

    monkeypatch.setattr(reviewed_html, "FRAME_ROWS", 10)
    reviewed_html._rows(Files(), lambda d, c: [{"doc_id": d}] * 3, "doc_id string, text string")
    assert sum(sizes) == 150 and max(sizes) <= 12


def test_long_pages_are_cut_into_cells(spark, monkeypatch):
    rows = [(p, f"f{k % 90}", (k * 37) % 400, (k * 37) % 400 + 1 + (k * k) % 50) for k in range(900) for p in ("a", None)] + [("b", "x", 3, 9)] * 3
    table = spark.createDataFrame(rows, "page string, finding_id string, start int, end int")
    made = lambda: sorted(((r.page, r["from"], r.to, r.names) for r in sweep.segments(table, ["page"]).collect()), key=str)
    whole = made()
    for long, edges, names in ((10, 16, 1 << 17), (10, 64, 100), (1 << 18, 64, 7)):
        monkeypatch.setattr(sweep, "LONG", long)
        monkeypatch.setattr(sweep, "CELL_EDGES", edges)
        monkeypatch.setattr(sweep, "PIECE_NAMES", names)
        assert made() == whole
    cells = sweep._celled(table.select("page", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "finding_id"), ["page"], "finding_id")
    most = {r.page: (r.cells, r.most) for r in cells.groupBy("page", "_cell").count().groupBy("page").agg(F.count("*").alias("cells"), F.max("count").alias("most")).collect()}
    assert most["a"][0] > 5 and most[None][0] > 5 and max(m for _, m in most.values()) < 900


def test_short_pages_are_swept_without_a_stage(spark, monkeypatch):
    monkeypatch.setattr(sweep, "stage", None)  # edges of short pages are neither written nor dealt again
    spans = spark.range(3000).selectExpr("id % 700 as page", "cast(id as string) as finding_id", "id % 13 as start", "id % 13 + id % 5 as end")
    want: dict = {}
    for k in range(3000):
        for x in range(k % 13, k % 13 + k % 5):
            want.setdefault((k % 700, x), set()).add(str(k))
    got = {(r.page, x): set(r.names) for r in sweep.segments(spans, ["page"]).collect() for x in range(r["from"], r.to)}
    assert got == want


def test_findings_of_both_reviews_are_made_once(spark, sf_dir, monkeypatch):
    staged, plain = [], conversion.stage
    monkeypatch.setattr(conversion, "stage", lambda df, tag: staged.append(tag) or plain(df, tag))
    rows = entry.queries()["review_findings"](spark, sf_dir)
    assert staged == ["warnings"]  # named once, for the earlier and the present review
    assert rows.filter("decision = 'DISMISSED'").count() > rows.filter("resolved").count() > 0


def test_findings_meet_nodes_and_blocks_in_one_join(spark):
    t = conversion.TOLERANCE
    warnings = [("d", 1, t, ["b", "a"], [2, 1]), ("d", 2, t, ["a", "b"], [1, 2]), ("d", 3, t, ["c"], []), ("d", 4, t, ["e", "e"], []), ("d", 5, "X", ["c"], None), ("d", 6, t, ["none"], [9]), ("d", 7, t, [], []), ("f", 1, t, ["g"], [])]
    nodes = [("d", "n1", "a", "plain"), ("d", "n2", "b", "Toler. +5"), ("d", "n3", "c", "Toler. +5 ±"), ("d", "n4", "e", "+1"), ("d", "n5", "e", "1+"), ("d", "n6", "a", None), ("f", "n7", "g", "Toler. +7 ++"), ("d", "n8", "c", "x")]
    blocks = [("d", "a", 3), ("d", "a", 3), ("d", "b", 1), ("d", "c", None), ("d", "only", 4), ("f", "g", 5)]
    warnings = spark.createDataFrame(warnings, "doc_id string, position int, code string, block_ids array<string>, pages array<int>")
    nodes = spark.createDataFrame(nodes, "doc_id string, node_id string, block_id string, text string")
    blocks = spark.createDataFrame(blocks, "doc_id string, Id string, Page int")
    found = conversion.review_findings(warnings, nodes, blocks)
    rows = {(r.doc_id, r.position): r for r in found.collect()}
    assert {k: (r.node_ids, r.pages, r.suggested_node, r.suggested_text) for k, r in rows.items()} == {
        ("d", 1): (["n1", "n2", "n6"], [1, 2, 3], "n2", "Tolerance ±5"), ("d", 2): (["n1", "n2", "n6"], [1, 2, 3], "n2", "Tolerance ±5"),
        ("d", 3): (["n3", "n8"], [], None, None), ("d", 4): (["n4", "n5"], [], None, None), ("d", 5): (["n3", "n8"], None, None, None),
        ("d", 6): ([], [9], None, None), ("d", 7): ([], [], None, None), ("f", 1): (["n7"], [5], None, None),
    }
    assert len({r.finding_id for r in rows.values()}) == 8  # equal warnings differ by their order
    assert rows["d", 1].region_hash == hashlib.sha256("n1:5:plain,n2:9:Toler. +5,n6:0:|a,b|1,2,3".encode()).hexdigest()
    plan = conversion.current_findings(conversion.named_findings(warnings), nodes, blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Aggregate ") == 1
    before = found.filter("doc_id = 'd' and position < 3").select("doc_id", "finding_id", F.expr("if(position = 1, region_hash, 'old') as region_hash"), F.lit("KEPT").alias("decision"))
    again = {(r.doc_id, r.position): (r.decision, r.resolved) for r in conversion.review_findings(warnings, nodes, blocks, before).collect()}
    assert again == {k: ("KEPT", k[1] == 1) if k in (("d", 1), ("d", 2)) else (None, False) for k in rows}
