"""The splittable reader against json.loads, with chunks of a few bytes and broken files."""

import json
import random

import pytest

from docsieve.sources import paged_json


def artefact(rng, pages, spaced):
    text = lambda: "".join(rng.choice('ab"\\{}[],:\n é\u2028/pages') for _ in range(rng.randint(0, 25)))
    made = [{"page": {"page_number": k + 1, "note": text(), "more": {"pages": [1, {"a": text()}]}},
             "blocks": [{"block": {"page_number": k + 1, "text": text()}, "n": [[text()]]} for _ in range(rng.randint(0, 4))]} for k in range(pages)]
    head = {"schema_version": "1", "others": [{"page": text()}, [{}]], "pages of": {"pages": [{}]}, text(): '"pages": [', "page_count": pages}
    whole = head | {"pages": made}
    return whole, json.dumps(whole, ensure_ascii=rng.random() < 0.5, **({"indent": 1} if spaced else {}))


def expected(whole):
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    out = []
    for k, p in enumerate(whole["pages"]):
        head = (k, p["page"]["page_number"], dump(p["page"]))
        out += [(*head, n, dump(b)) for n, b in enumerate(p["blocks"])] or [(*head, None, None)]
    return out


def in_process(monkeypatch, spark):
    """Chunks of a few bytes hold in this process alone, so the small tables' maps run here."""

    class Rows(list):
        def collect(self):
            return list(self)

    def run_here(_, rows, ddl, run, out):
        import pyarrow as pa
        from pyspark.sql import Row

        names = [x.split()[0] for x in ddl.split(", ")]
        batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
        return Rows(Row(**r) for b in run(iter([batch])) for r in b.to_pylist())

    monkeypatch.setattr(paged_json, "_map", run_here)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 4096])
def test_any_chunks(spark, tmp_path, monkeypatch, chunk):
    in_process(monkeypatch, spark)
    monkeypatch.setattr(paged_json, "CHUNK", chunk)
    rng = random.Random(chunk)
    for k in range(6 if chunk < 8 else 20):
        whole, text = artefact(rng, rng.randint(1, 5), k % 2)
        (tmp_path / "a.json").write_text(text + " \n" * (k % 3))
        header, rows = paged_json.read_artifact(spark, str(tmp_path / "a.json"))
        assert header == {n: v for n, v in whole.items() if n != "pages"}
        assert sorted([tuple(r)[1:] for r in rows], key=str) == sorted(expected(whole), key=str)


def test_by_tasks(spark, tmp_path):
    rng = random.Random(1)
    whole, text = artefact(rng, 40, False)
    (tmp_path / "a.json").write_text(text)
    header, rows = paged_json.read_artifact(spark, f"file://{tmp_path}/a.json")
    assert header["page_count"] == 40 and sorted([tuple(r)[1:] for r in rows.collect()], key=str) == sorted(expected(whole), key=str)
    (tmp_path / "none.json").write_text('{"page_count": 0, "pages": [ ]}')
    assert paged_json.read_artifact(spark, str(tmp_path / "none.json"))[1].count() == 0


def test_written_and_read(spark, tmp_path):
    rows = [(k, json.dumps({"page_number": k + 1}), [json.dumps({"text": "x" * k, "k": i}) for i in range(k % 3)]) for k in range(30)]
    paged_json.write_artifact(spark.createDataFrame(rows, "page_order long, page string, blocks array<string>").repartition(5), str(tmp_path / "out"), {"component": "m"})
    (made,) = (tmp_path / "out").glob("part-*")
    whole = json.loads(made.read_text())
    header, back = paged_json.read_artifact(spark, str(made))
    assert header == {"component": "m", "page_count": 30} and sorted([tuple(r)[1:] for r in back.collect()], key=str) == sorted(expected(whole), key=str)


@pytest.mark.parametrize("chunk", [5, 4096])
def test_broken_files(spark, tmp_path, monkeypatch, chunk):
    in_process(monkeypatch, spark)
    monkeypatch.setattr(paged_json, "CHUNK", chunk)
    page = lambda n, b="": '{"page":{"page_number":%d},"blocks":[%s]}' % (n, b)
    cases = {
        "truncated": ('{"page_count":1,"pages":[' + page(1), "ARTIFACT_TRUNCATED"), "in_text": ('{"page_count":1,"pages":["' + page(1), "ARTIFACT_TRUNCATED"),
        "count": ('{"page_count":2,"pages":[' + page(1) + "]}", "ARTIFACT_PAGE_COUNT"), "no_count": ('{"pages":[' + page(1) + "]}", "ARTIFACT_INVALID"),
        "trailing": ('{"page_count":1,"pages":[' + page(1) + "]} x", "ARTIFACT_INVALID"), "more_keys": ('{"page_count":1,"pages":[' + page(1) + '],"x":1}', "ARTIFACT_INVALID"),
        "last_comma": ('{"page_count":1,"pages":[' + page(1) + ",]}", "ARTIFACT_INVALID"), "first_comma": ('{"page_count":1,"pages":[,' + page(1) + "]}", "ARTIFACT_INVALID"),
        "no_comma": ('{"page_count":2,"pages":[' + page(1) + " " + page(2) + "]}", "ARTIFACT_INVALID"), "two_commas": ('{"page_count":2,"pages":[' + page(1) + ",," + page(2) + "]}", "ARTIFACT_INVALID"),
        "no_pages": ('{"page_count":0}', "ARTIFACT_INVALID"), "other_page": ('{"page_count":1,"pages":[' + page(1, '{"page_number":2}') + "]}", "BLOCK_PAGE_MISMATCH"),
        "number": ('{"page_count":1,"pages":[' + page(1, "3") + "]}", "ARTIFACT_INVALID"), "keys": ('{"page_count":1,"pages":[{"blocks":[],"page":{"page_number":1}}]}', "ARTIFACT_INVALID"),
        "value": ('{"page_count":0,"pages":[7]}', "ARTIFACT_INVALID"), "empty": ("", "ARTIFACT_INVALID"), "closed_twice": ('{"page_count":0,"pages":[]}}{', "ARTIFACT"),
    }
    for name, (text, code) in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(paged_json.ArtifactError, match=code):
            list(paged_json.read_artifact(spark, str(tmp_path / f"{name}.json"))[1] or [])
            raise AssertionError(name)
    with pytest.raises(paged_json.ArtifactError, match="ARTIFACT_MISSING"):
        paged_json.read_artifact(spark, str(tmp_path / "gone.json"))


def test_edges_read_little(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_bytes(b"x" * 5000 + b"\\" * 3000 + b"y" * 2_000_000)
    read, plain = [], paged_json._bytes
    monkeypatch.setattr(paged_json, "_bytes", lambda p, a, b: read.append(b - a) or plain(p, a, b))
    assert paged_json._edge(str(path), 1000, 2_008_000) == 1000
    assert paged_json._edge(str(path), 6000, 2_008_000) == 8001
    assert max(read) <= 1025
