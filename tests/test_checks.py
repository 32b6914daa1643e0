"""Publication checks, history files, leases and classification outcomes on small tables."""

import hashlib

import json

import pytest
from pyspark.sql import functions as F

from docsieve.operators import classification, publication
from docsieve.sources import history
from docsieve.streaming import leases

RECORD = "revision_id string, parent_revision_id string, generation long, note string"


def test_artifacts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.json", b"one"), ("sub/b.json", b"two"), ("c.json", b"three")):
        (tmp_path / name).write_bytes(data)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = [("a", "a.json", 3, sha(b"one")), ("b", "sub/b.json", 3, sha(b"other")), ("c", "c.json", 4, sha(b"three")), ("d", "d.json", 1, sha(b""))]
    table = spark.createDataFrame(listed, "component string, relative_path string, byte_size long, sha256 string")
    got = {r.component: r.code for r in publication.broken_artifacts(spark, table, str(tmp_path)).collect()}
    assert got == {"b": "ARTIFACT_HASH_MISMATCH", "c": "ARTIFACT_SIZE_MISMATCH", "d": "ARTIFACT_MISSING"}
    outcomes = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("e", "completed")], "component string, outcome string")
    codes = {(r.component, r.code) for r in publication.disagreeing_artifacts(outcomes, table.filter("component in ('a', 'b')")).collect()}
    assert codes == {("e", "ARTIFACT_MISSING"), ("b", "ARTIFACT_UNEXPECTED")}


def test_spans_and_evidence(spark):
    blocks = spark.createDataFrame([("d", 1, "n", "a pump")], "doc_id string, page_number int, node_id string, text string")
    hits = spark.createDataFrame([("d", 1, "n", 2, 6)], "doc_id string, page_number int, node_id string, start int, end int")
    wanted = hits.unionByName(hits.withColumn("end", F.lit(5))).unionByName(hits)
    assert [r.text for r in publication.locate_hit(blocks, hits, wanted).collect()] == ["a pump"]
    row = spark.range(1).select(publication.evidence(F.lit("fuzzy"), F.lit("pump"), F.lit(1)).alias("f"), publication.evidence(F.lit("exact"), F.lit("pump"), F.lit(1)).alias("e")).first()
    assert tuple(row.f) == ("fuzzy", "pump", 1) and tuple(row.e) == ("exact", "pump", None)
    runs = spark.createDataFrame([(1, "published", "x"), (2, "published", None), (3, "failed", "x")], "run int, publication string, manifest_sha256 string")
    assert [r.run for r in publication.reviewable_runs(runs).collect()] == [1]


def test_histories(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = [("a", "r2", "r1", 2, None), ("a", "r1", None, 1, "a\nb"), ("007", "x", None, 1, "é"), ("b/c d+%", "y", None, 1, "z")]
    records = spark.createDataFrame(rows, f"job_id string, {RECORD}")
    history.write_histories(records, path)
    state, body = history.read_histories(spark, path, RECORD)
    assert sorted(map(tuple, body.collect()), key=str) == sorted(rows, key=str)
    heads = spark.createDataFrame([("a", "r2", 2), ("007", "x", 2), ("gone", "x", 1)], "job_id string, revision_id string, generation long")
    assert {r.job_id: r.state for r in history.history_states(state, heads).collect()} == {"a": "CURRENT", "007": "STALE", "gone": "INVALID_OR_MISSING"}
    with pytest.raises(ValueError, match="HISTORY_JSONL_MISSING"):
        history.read_histories(spark, path + "-none", RECORD)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        history.write_histories(records, path)


def test_damaged_histories(spark, tmp_path):
    head = lambda n, last, **more: json.dumps({"kind": "HISTORY_COVERAGE", "head_revision_id": last, "head_generation": n, "complete_through_revision_id": last,
                                               "complete_through_generation": n, "projected_revision_count": n} | more)
    record = lambda g, i, p: json.dumps({"revision_id": i, "parent_revision_id": p, "generation": g})
    one, two = record(1, "r1", None), record(2, "r2", "r1")
    whole = [head(2, "r2"), one, two]
    files = {
        "good": whole, "no_records": [head(2, "r2")], "last_alone": [head(2, "r2"), two], "disordered": [head(2, "r1"), two, one], "repeated": [head(3, "r2"), one, two, two],
        "renumbered": [head(2, "r2"), one, record(3, "r2", "r1")], "parentless": [head(2, "r2"), one, record(2, "r2", None)], "parented": [head(1, "r1"), record(1, "r1", "r0")],
        "miscounted": [head(2, "r2", projected_revision_count=3), one, two], "other_head": [head(2, "r9"), one, two], "header_last": [one, head(1, "r1")],
        "blank": [head(2, "r2"), one, "", two], "list": ["[]"], "text": [head(2, "r2"), one, "no json"], "same_id": [head(2, "r1"), one, record(2, "r1", "r1")],
        "string_generation": [head(1, "r1"), one.replace("1", '"one"', 1)],
    }
    raw = {k: ("\n".join(v) + "\n").encode() for k, v in files.items()}
    raw |= {"endless": raw["good"][:-1], "empty": b"", "newline": b"\n", "bytes": raw["good"].replace(b"r1", b"r\xff")}
    for k, v in raw.items():
        (tmp_path / f"job_id={k}").mkdir()
        (tmp_path / f"job_id={k}" / "part.txt").write_bytes(v)
    (tmp_path / "job_id=twice").mkdir()
    for n in "ab":
        (tmp_path / "job_id=twice" / f"{n}.txt").write_bytes(raw["good"])
    state, body = history.read_histories(spark, str(tmp_path), RECORD)
    assert {r.job_id: r.error_code for r in state.collect()} == {k: None if k == "good" else "HISTORY_JSONL_INVALID" for k in [*raw, "twice"] if k != "empty"}  # of a file without bytes there is no row
    assert [(r.job_id, r.revision_id) for r in body.orderBy("generation").collect()] == [("good", "r1"), ("good", "r2")]


def test_decisions_and_grants(spark):
    rows = spark.createDataFrame([("r1", "r1"), ("r1", "r0")], "revision_id string, decided_in string")
    assert history.decisions_made_here(rows).count() == 1 == history.page_grants(rows.withColumnRenamed("decided_in", "granted_in")).count()


def test_leases(spark):
    slots = spark.createDataFrame([(0, 1, "g"), (1, 2, "h")], "slot int, job_id long, generation string")
    asks = slots.filter("job_id = 2").select(F.lit(9).cast("long").alias("job_id"), F.lit("x").alias("generation"), F.lit(1).alias("asked"))
    assert leases.acquire_slots(slots, asks, 2).count() == 0
    assert [tuple(r) for r in leases.acquire_slots(slots, asks, 3).collect()] == [(2, 9, "x")]
    stale = spark.createDataFrame([(0, 1, "old"), (1, 2, "h")], "slot int, job_id long, generation string")
    assert [r.slot for r in leases.release_slots(slots, stale).collect()] == [0]
    held = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "job_id long, lease string, until long")
    assert [r.job_id for r in leases.release_leases(held, held.filter("job_id = 1").withColumn("lease", F.lit("z")).unionByName(held.filter("job_id = 2"))).collect()] == [1]
    cases = [("SUBMITTING", None, False, False, False, True), ("SUBMITTING", None, False, True, False, False), ("SUBMITTING", None, False, True, True, True),
             ("OCR", None, False, False, True, False), ("SUBMITTING", "h", False, False, True, False), ("OCR", None, True, True, False, True)]
    t = spark.createDataFrame(cases, "phase string, handle string, prior_uncertain boolean, known_error boolean, retryable boolean, want boolean")
    assert t.filter(leases.uncertain_submission() != F.col("want")).count() == 0
    jobs = spark.createDataFrame([(1, "o"), (2, "p")], "id int, owner string")
    assert [r.id for r in leases.owned(jobs, F.lit("p")).collect()] == [2]


def test_failed_calls(spark):
    calls = spark.createDataFrame([("d", 1, k) for k in (1, 2)], "doc_id string, page_number int, call_id int")
    out = classification.failed_calls(calls, F.lit("timeout"))
    page = calls.select("doc_id", "page_number").distinct()
    found = classification.with_missing_calls(page, out).orderBy("call_id").collect()
    assert [(r.availability, r.failure_reason) for r in found] == [("failed", "timeout")] * 2 + [("missing", classification.NOT_SUPPLIED)]
    assert classification.classify(page, out).first().kind == "incomplete"
