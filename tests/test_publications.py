"""Merged streams, projected findings, approvals, multiset digests and snapshot reuse on small tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsieve.operators import digests, findings, merging
from docsieve.session import stage_path
from docsieve.sources import catalogue

BLOCK = "doc_id string, block_order int, node_id string, text string"
STREAM = f"{BLOCK}, spans array<{merging.SPAN}>"


def streams(spark, blocks, drop=(), change=None):
    rng = random.Random(2)
    span = lambda t: [(0, len(t), t, f"name of {t}")] if t and rng.random() < 0.7 else []
    both = []
    for k in (1, 2):
        rows = [(*b, span(b[3])) for b in blocks if (k, b[0], b[1]) not in drop]
        rows = [(*r[:2], *change[k, r[0], r[1]], r[4]) if change and (k, r[0], r[1]) in change else r for r in rows]
        rng.shuffle(rows)
        both.append(rows)
    return [spark.createDataFrame(blocks, BLOCK).repartition(4), *(spark.createDataFrame(r, STREAM).repartition(3) for r in both)], both


def test_merge(spark):
    blocks = [(d, k, f"{d}{k}", f"text {k}" if k % 4 else None) for d in ("a", "b", "c") for k in range(70)]
    (b, p, u), (want_p, want_u) = streams(spark, blocks)
    got = {(r.doc_id, r.block_order): r for r in merging.merge_streams(b, p, u).collect()}
    assert len(got) == 210 and all(r.error_code is None for r in got.values())
    for rows, name in ((want_p, "parameters"), (want_u, "units")):
        assert all([tuple(s) for s in got[r[0], r[1]][name]] == r[4] for r in rows)
    assert all(got[x[0], x[1]].text == x[3] and got[x[0], x[1]].node_id == x[2] for x in blocks)
    only = {(r.doc_id, r.block_order): r for r in merging.merge_streams(b, None, u).collect()}
    assert all([tuple(s) for s in only[r[0], r[1]].units] == r[4] and not only[r[0], r[1]].parameters for r in want_u)
    assert merging.merge_streams(b, None, None).count() == 210 and merging.merge_streams(b.filter("false"), p.filter("false"), u.filter("false")).count() == 0


@pytest.mark.parametrize("fault", ["missing", "node", "text", "extra", "repeated"])
def test_merge_refuses_other_streams(spark, fault):
    blocks = [(d, k, f"{d}{k}", f"text {k}") for d in ("a", "b") for k in range(20)]
    change = {"node": {(2, "b", 7): ("other", "text 7")}, "text": {(1, "b", 7): ("b7", "other")}}.get(fault)
    (b, p, u), _ = streams(spark, blocks, drop={(1, "b", 7)} if fault == "missing" else (), change=change)
    if fault in ("extra", "repeated"):
        u = u.unionByName(spark.createDataFrame([("b", 7, "b7", "text 7", [])] if fault == "repeated" else [("b", 90, "b90", "x", [])], STREAM))
    rows = merging.merge_streams(b, p, u).collect()
    assert Counter(r.doc_id for r in rows) == {"a": 20, "b": 1}
    assert [(r.block_order, r.error_code) for r in rows if r.doc_id == "b"] == [(90 if fault == "extra" else 7, "BLOCK_IDENTITY_MISMATCH")]


def test_findings(spark):
    schema = "job int, component string, occurrence_id string, page_number int, block_order int, node_id string, start int, end int, matched_text string, position string"
    rows = [(1, "units", "u1", 2, 0, "n", 3, 5, "kg", "x"), (1, "materials", "m1", 1, 5, "n", 0, 5, "water", "x"), (1, "materials", "m1", 1, 5, "n", 0, 5, "water", "y"),
            (1, "units", "u0", 1, 5, "n", 0, 5, "water", "x"), (2, "units", "u", 1, 1, "n", 0, 1, "a", "x"), (2, "units", "u", 1, 1, "n", 0, 1, "b", "x"),
            *((3, "materials", f"m{k}", 1, k, "n", 0, 1, "a", "x") for k in range(6)), (4, "units", None, 1, None, None, None, None, None, None)]
    got = findings.project(spark.createDataFrame(rows, schema), ["job"], most=5).collect()
    by = {j: [(r.position, r.occurrence_id, r.occurrence_kind, r.error_code) for r in sorted(got, key=lambda r: (r.job, r.position or 0)) if r.job == j] for j in (1, 2, 3, 4)}
    assert by[1] == [(1, "m1", "dictionary", None), (2, "u0", "unit", None), (3, "u1", "unit", None)]
    assert by[2] == [(None, None, None, "ARTIFACT_REJECTED")] and by[3] == [(None, None, None, "PROJECTION_LIMIT")] and by[4] == [(1, None, "unit", None)]
    shown = findings.active_highlights(findings.project(spark.createDataFrame(rows, schema), ["job"]).filter("error_code is null"))
    assert {r.job for r in shown.collect()} == {1, 3} and "category" in shown.columns


def test_approvals(spark):
    reviews = spark.createDataFrame([("a", "r1", None), ("b", "r2", "r2"), ("c", "r3", "r2")], "review_id string, revision_id string, approved_revision_id string")
    commands = [("a", 1, "r0", "r0"), ("a", 2, "r1", "r0"), ("a", 3, "r1", "r1"), ("a", 4, "r1", "r1"), ("b", 1, "r2", "r2"), ("c", 1, "r3", "r3"), ("c", 2, None, "r3")]
    out = findings.approve(reviews, spark.createDataFrame(commands, "review_id string, seq int, expected_revision_id string, target_revision_id string"))
    assert [tuple(r)[:2] + tuple(r)[4:] for r in out.orderBy("review_id", "seq").collect()] == [
        ("a", 1, "CONFLICT", None), ("a", 2, "VALIDATION_ERROR", None), ("a", 3, "CHANGED", "r1"), ("a", 4, "UNCHANGED", "r1"), ("b", 1, "UNCHANGED", "r2"),
        ("c", 1, "CHANGED", "r3"), ("c", 2, "CONFLICT", "r3"),
    ]


def test_digests(spark):
    rows = [(k, f"t{k % 7}", None if k % 5 else "") for k in range(200)]
    of = lambda rs, n=3: digests.lanes(spark.createDataFrame(rs, "k int, t string, u string").repartition(n)).select(digests.digest().alias("d")).first().d
    base = of(rows)
    assert base == of(rows[::-1], 7)
    swapped = [list(r) for r in rows]
    swapped[3][1], swapped[4][1] = rows[4][1], rows[3][1]
    changed = [swapped, rows[:-1], [*rows, rows[0]], [(0, "t0", None), *rows[1:]], [(0, "t", "0"), *rows[1:]]]
    assert len({base, *(of(list(map(tuple, c))) for c in changed)}) == 6
    table = spark.createDataFrame(rows, "k int, t string, u string")
    parts = digests.lanes(table, ["t"])
    assert digests.merged(parts).select(digests.digest().alias("d")).first().d == base
    assert digests.lanes(table.select("u", "k", "t")).select(digests.digest().alias("d")).first().d == base
    empty = digests.lanes(table.filter("false"))
    assert empty.first()["rows"] == 0 and digests.merged(empty.unionByName(digests.lanes(table))).select(digests.digest().alias("d")).first().d == base


def test_snapshot_reuse(spark):
    table = spark.createDataFrame([(f"r{k}", f"name {k}", "") for k in range(50)], "row_id string, name string, note string")
    tables = {"one": table, "two": table.limit(3)}
    path = stage_path(spark, "snapshot")
    manifest, where = catalogue.prepare_snapshot(tables, path, [path + "-none"])
    assert where == path and catalogue.snapshot_problems(spark, path) == []
    again, where = catalogue.prepare_snapshot({"two": table.limit(3), "one": table.repartition(4)}, path + "-new", [path + "-none", path])
    assert (again, where) == (manifest, path)
    swap = table.withColumn("name", F.when(F.col("row_id") == "r1", "name 2").when(F.col("row_id") == "r2", "name 1").otherwise(F.col("name")))
    for other in ({"one": swap, "two": table.limit(3)}, {"one": table}, {"one": table.select("row_id", "note", "name"), "two": table.limit(3)}, {"one": table.limit(49), "two": table.limit(3)}):
        assert catalogue.reusable_snapshot(other, path) is None
    swap.write.mode("overwrite").parquet(f"{path}/one")
    table.limit(2).write.mode("overwrite").parquet(f"{path}/two")
    assert catalogue.snapshot_problems(spark, path) == [("one", "CONTENT_MISMATCH"), ("two", "ROW_COUNT_MISMATCH")]
    assert catalogue.snapshot_problems(spark, path, {"one": table.columns, "gone": []}) == [("two", "TABLE_UNKNOWN"), ("gone", "TABLE_MISSING"), ("one", "CONTENT_MISMATCH")]
    assert catalogue.snapshot_problems(spark, path + "-none") == [("", "MANIFEST_INVALID")]
    with pytest.raises(catalogue.CatalogueError, match="CONTENT_MISMATCH"):
        catalogue.open_snapshot(spark, path)
