"""The pipeline stage by stage: what goes, goes for its reason, and clean documents stay."""

import pandas as pd

from docsieve.session import read_table


def test_stages(spark, sf_dir):
    import corpus_pipeline as pipeline
    from docsieve.llm import decontamination, queries

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_files"]
    docs = read_table(spark, sf_dir, "documents")
    columns, frames = docs.columns, [docs.toPandas()]
    for _, step in pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        frames.append(docs.toPandas())
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    kept = frames[0].merge(labels, on="doc_id")
    kept["stays"] = kept.doc_id.isin(frames[1].doc_id)
    assert kept[kept.quality == 1].stays.mean() > 0.9 and kept[kept.quality == 0].stays.mean() < 0.3
    assert not frames[2].text.duplicated().any() and set(frames[2].doc_id) <= set(frames[1].doc_id)
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    match = decontamination.Matcher(list(zip(items.item_id, items.text)))
    assert set(frames[3].doc_id) == {d for d, t in zip(frames[2].doc_id, frames[2].text) if not match.search(t)}
    out = pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(out.doc_id) == set(frames[4].doc_id) and out.n_tokens.sum() == out.start.max() + out.loc[out.start.idxmax()].n_tokens
    assert queries.QUERIES


def test_mix_gives_each_row_its_own_words(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from docsieve.llm import mixing

    keys = [(None, "a"), (None, "b"), (7, "a"), (7, "b"), (7, None)]
    rows = [(*keys[k % 5], f"r{k}", " ".join(f"r{k}w{i}" for i in range(20)), 0) for k in range(60)]
    rows += [rows[0], rows[0], rows[1], (8, "a", "none", None, 0)]  # equal rows, and one without words
    docs = spark.createDataFrame(rows, "doc_id long, source string, name string, text string, n_chars long")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.plan(sized, block=8)
    taken = mixing.taken_words(plan)
    names = {r["rank"]: r["source"] for r in plan.sources.collect()}
    want = Counter({s: 0 for s in names.values()})
    for r in plan.slots.collect():
        size = sum(20 for x in rows if x[1] == names[r["rank"]] and x[3])
        want[names[r["rank"]]] += min(8, size - 8 * r["block"])
    out = mixing.mix_documents(docs, block=8).collect()
    got = Counter()
    for r in out:
        words = r.text.split()
        assert len(words) <= 3 * 20 and {w.split("w")[0] for w in words} == {r["name"]}
        got[r.source] += len(words)
    assert got == want
    assert sorted(len(r.text.split()) for r in out) == sorted(r.taken for r in taken.collect() if r.taken)
