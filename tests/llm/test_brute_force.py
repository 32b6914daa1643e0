"""Queries against SQL, models against plain arithmetic, and the whole pipeline against a plain chain."""

import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.llm import decontamination, jaccard, language, media, mixing, quality, queries, suffix_dedup, token_output
from docsieve.session import read_table

BIG = 2**53 + 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    cell = lambda x: None if pd.isna(x) else round(x, 9) if isinstance(x, float) else x
    plain = lambda t: sorted((tuple(map(cell, r)) for r in t[columns].itertuples(index=False, name=None)), key=str)
    assert sorted(got.columns) == columns and plain(got) == plain(want)


def test_null_ids_leave_large_ids_as_they_are(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(BIG, text, "x"), (None, text, "y"), (BIG + 1, None, "z"), (BIG, text, "x")], "doc_id long, text string, kind string")
    bench = spark.createDataFrame([(BIG + 2, text)], "item_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    model = language.learn(docs.select("text", F.lit("en").alias("lang")))
    ids = lambda t: sorted((r.doc_id for r in t.collect()), key=str)
    want = sorted([BIG, BIG, BIG + 1, None], key=str)
    assert ids(language.predict(docs, model)) == want
    assert ids(quality.train_and_score(docs, labels)) == want
    assert ids(media.read_payloads(media.store_payloads(docs))) == want
    assert ids(jaccard.jaccard_components(docs)) == want
    assert ids(suffix_dedup.remove_repeats(docs)) == want
    path = token_output.write_tokens(docs, queries.tokenizer_path())
    assert ids(token_output.read_digests(spark, path)) == want
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == {(BIG, BIG + 2), (None, BIG + 2)}
    assert ids(decontamination.drop_contaminated(docs, bench)) == [BIG + 1]
    assert language.predict(spark.createDataFrame([(1, "½ ² Ⅷ")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_quality_equals_plain_arithmetic(spark, sf_dir):
    docs, labels = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = np.array([quality.statistics(t) for t in docs.text])
    where = {d: k for k, d in enumerate(docs.doc_id)}
    train = [(where[d], y) for d, y in zip(labels.doc_id, labels.quality) if d in where and zlib.crc32(str(d).encode()) % 3 != 1]
    x, y = stats[[k for k, _ in train]], np.array([v for _, v in train], float)
    rng, d = np.random.default_rng(7), len(quality.STATISTICS)
    w, b = rng.normal(size=(d, quality.N_FEATURES)) / 4.0, rng.uniform(0, 2 * math.pi, quality.N_FEATURES)
    scale = np.sqrt(np.maximum(x.var(0), 1e-12)) + 1e-6

    def features(s):
        z = np.clip((s - x.mean(0)) / scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.cos(z @ w + b) * math.sqrt(2 / quality.N_FEATURES)])

    f = features(x)
    ridge = np.linalg.solve(f.T @ f + 1e-3 * len(y) * np.eye(f.shape[1]), f.T @ y)
    bins = np.clip(np.rint((f @ ridge + 0.5) * quality.N_BINS / 2), 0, quality.N_BINS)
    knots = np.unique(bins)
    n, m = np.array([(bins == k).sum() for k in knots], float), np.array([y[bins == k].mean() for k in knots])
    fit = [max(min((n[i : j + 1] @ m[i : j + 1]) / n[i : j + 1].sum() for j in range(k, len(m))) for i in range(k + 1)) for k in range(len(m))]
    want = np.clip(np.interp(features(stats) @ ridge, knots * 2 / quality.N_BINS - 0.5, fit), 0, 1)
    got = {r.doc_id: r.score for r in queries.op5_quality_classifier(spark, sf_dir).collect()}
    assert max(abs(got[i] - s) for i, s in zip(docs.doc_id, want)) < 1e-6


def test_language_equals_plain_expectation_maximisation(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    model = language.learn(read_table(spark, sf_dir, "documents"))
    names = sorted(docs.lang.dropna().unique())
    table = np.full((1 << language.BUCKET_BITS, len(names)), 0.5)
    for text, lang in zip(docs.text, docs.lang):
        g = language.ngrams(text)
        if lang is not None and g is not None:
            np.add.at(table[:, names.index(lang)], g, 1)
    table /= table.sum(0)
    assert names == model.names and np.allclose(table, model.table)

    def plain(grams, which, start):
        share = dict(zip(which, start))
        for _ in range(language.ROUNDS if len(which) > 1 else 0):
            sums = dict.fromkeys(which, 0.0)
            for g in grams:
                total = sum(share[k] * table[g, k] for k in which)
                for k in which:
                    sums[k] += share[k] * table[g, k] / total
            new = {k: sums[k] / len(grams) for k in which}
            done = max(abs(new[k] - share[k]) for k in which) < 1e-3
            share = new
            if done:
                break
        return share, sum(math.log(sum(share[k] * table[g, k] for k in which)) for g in grams)

    some = docs[docs.n_chars.between(100, 900)].head(6).text.tolist()
    for text in [*some, some[0] + " " + some[-1]]:
        grams = language.ngrams(text)
        if grams is None:
            continue
        every = list(range(len(names)))
        share, _ = plain(grams, every, [1 / len(names)] * len(names))
        order = sorted(every, key=lambda k: (-share[k], k))
        best, size = plain(grams, order[:1], [1.0]), 1
        for m in range(2, len(names) + 1):
            total = sum(share[k] for k in order[:m])
            more = plain(grams, order[:m], [share[k] / total for k in order[:m]])
            if more[1] - best[1] <= language.PENALTY * math.log(len(grams)):
                break
            best, size = more, m
        which, got = model.mixture(grams)
        assert len(which) == size and all(abs(best[0][k] - s) < 1e-9 for k, s in zip(which, got))


def test_trees_of_unlike_widths():
    rng, rule, rows = np.random.default_rng(5), jaccard.Rule(1, 15, 100), []
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for k in range(60):
        s = np.unique(rng.choice(pool, int(rng.integers(20, 600))))
        b = jaccard.bitmap(s)
        rows.append((k, len(s), 8 * len(b), int.from_bytes(b, "little"), k, k % 2))
    for cross in (False, True):
        assert jaccard.tree_join(rule, rows, cross) == jaccard.few_join(rule, rows, cross)


def test_whole_texts_for_other_vocabularies():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two words, İSTANBUL\tǅ é", "", "a\x1cb  c"]
    for p, by_words in ((path, False), (queries.tokenizer_path(), True)):
        encode, plain = token_output.WordEncoder(p), Tokenizer.from_file(p)
        ids, upto = encode(pa.array(texts))
        assert encode.by_words is by_words
        assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_mix_beside_columns_of_its_own_names(spark):
    rows = [(k, "a" if k % 2 else "b", " ".join(f"w{k}" for _ in range(30)), "x", "y", k) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _size string, _doc string, row int")
    out = mixing.mix_documents(docs, block=8)
    assert out.columns == docs.columns
    assert all({r._size, r._doc} == {"x", "y"} and set(r.text.split()) == {f"w{r.doc_id}"} and r.row == r.doc_id for r in out.collect())


def test_run_equals_a_plain_chain(spark, sf_dir, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    score = {r.doc_id: r.score for r in quality.train_and_score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", "quality")).collect()}
    kept = docs[[score[i] >= 0.5 for i in docs.doc_id]].sort_values("doc_id")
    sets = []
    for t in kept.text:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    kept = kept[[least[k] == k for k in range(len(sets))]]
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    match = decontamination.Matcher(list(zip(items.item_id, items.text)))
    kept = kept[[not match.search(t) for t in kept.text]]
    # The mix: slots as planned, words cut out one by one.
    table = spark.createDataFrame(kept.astype({"n_chars": "int64"}))
    sized = table.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64(*docs.columns).alias("row"))
    plan = mixing.plan(sized)
    times, place = {}, {r["source"]: r["rank"] for r in plan.sources.collect()}
    for r in plan.slots.collect():
        times[r["rank"], r["block"]] = times.get((r["rank"], r["block"]), 0) + 1
    start = {r.doc_id: (place[r.source], r.start) for r in plan.docs.collect()}
    plain, texts = Tokenizer.from_file(queries.tokenizer_path()), {}
    for i, t in zip(kept.doc_id, kept.text):
        rank, at = start[i]
        words = t.split()
        turns = [times.get((rank, (at + k) // plan.block), 0) for k in range(len(words))]
        passes = [[w for w, n in zip(words, turns) if n > turn] for turn in range(max(turns, default=0))]
        if passes:
            texts[i] = " ".join(w for some in passes for w in some)
    want, upto = [], 0
    for i in sorted(texts):
        ids = [*plain.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, upto, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        upto += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(want) > 50
    again = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert again == got


def test_run_of_empty_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        read_table(spark, sf_dir, name).filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op2_language_id", "op3_secret_scans", "op4_benchmark_decontamination", "op5_quality_classifier", "op6_media_columns", "op7_ngram_jaccard_join",
                 "op8_suffix_array_dedup", "op9_token_output", "op10_source_mixing"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_null_paths_go_through_the_ledger(spark):
    from docsieve.llm import secrets

    texts = [(None, "token: abcdefgh1"), (None, "token: abcdefgh1"), (1, "token: abcdefgh1"), (None, "password=longenough"), (None, None), (2, "plain")]
    versions = spark.createDataFrame(texts, "doc_id long, text string")
    ledger = secrets.scan_unseen(versions)
    rows = ledger.collect()
    assert len(rows) == 4 * len(secrets.RULES) == len({(r.blob_id, r.rule_version) for r in rows})  # each distinct text once
    assert secrets.scan_unseen(versions, ledger).count() == 0
    more = versions.unionByName(spark.createDataFrame([(None, "secret: another12")], versions.schema))
    assert secrets.scan_unseen(more, ledger).count() == len(secrets.RULES)
    found = secrets.findings_by_path(versions, ledger).collect()
    assert sorted(len(r.findings) for r in found) == [0, 0, 1, 1, 1, 1]
