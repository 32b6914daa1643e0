"""Odd tables for the training-data operators: long texts, ties, repeats, clashing columns, whole queries in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_components, plain_spans

from docsieve.llm import chat, decontamination, jaccard, language, quality, queries, secrets, suffix_dedup
from docsieve.session import read_table

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="module")
def long_texts():
    """Texts of over a million characters that share passages across any stripe, and a short one of each kind."""
    rng = random.Random(12)
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(150_000))
    return [base, base[:700_000] + " password=abcdefgh12 " + base[700_000:], "x" * 1_100_000, base[500_000:500_400], None, ""]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "c", 0) for k, t in enumerate(texts)], "doc_id long, text string, blob_id string, bucket int")


def test_long_texts_of_scans_and_models(spark, sf_dir, long_texts):
    docs = docs_of(spark, long_texts)
    found = secrets.findings_by_path(docs, secrets.scan_unseen(docs)).select("path", secrets.spans_text("findings", secrets.KINDS[:3]).alias("s"))
    assert {r.path: r.s for r in found.collect()} == {k: plain_spans(t or "") for k, t in enumerate(long_texts)}
    model = language.learn(read_table(spark, sf_dir, "documents"))
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert out[0].lang_pred == out[1].lang_pred != "und" and out[4].lang_pred == out[5].lang_pred == "und" and all(0 <= r.score <= 1 for r in out.values())
    scored = {r.doc_id: r for r in quality.train_and_score(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality")).collect()}
    assert len(scored) == 6 and scored[4].score == scored[5].score and all(r.predicted == (r.score >= 0.5) for r in scored.values())


def test_long_texts_of_joins(spark, long_texts):
    docs = docs_of(spark, long_texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, jaccard.Rule(4, 85, 100)).collect()}
    assert got == brute_components(long_texts, 4, 85, 100) and got[1][1] == 0
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    cut = len(long_texts[1]) - len(long_texts[0])
    assert out[0].n_removed == 0 and out[3].n_removed == 400 and out[3].n_spans == 1
    assert out[1].n_removed >= len(long_texts[0]) - 2 and out[1].n_spans == 2 and out[1].n_bytes - out[1].n_removed <= cut
    assert out[2].n_removed == 0 and out[4].n_bytes == out[5].n_bytes == 0


def test_chat_with_clashing_columns_long_texts_and_nothing(spark):
    long = "[INST] word </s> \\ " * 60_000
    rows = [(1, 0, "user", long, "a", 1), (1, 1, "assistant", long[::-1], "b", 2), (2, None, None, None, "c", 3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, rows int").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chat(turns).select("conv_id", chat.parse_chat(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    by = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in by[1].t] == [("user", long), ("assistant", long[::-1])] and by[1].loss == long[::-1]
    assert [(t.role, t.text) for t in by[2].t] == [("", "")] and chat.format_chat(turns.filter("false")).count() == 0


def test_benchmark_ties_and_repeated_items(spark):
    item = " ".join(WORDS * 5)
    items = [(1, item), (2, item), (1, item), (3, item[:-1] + "x"), (None, item), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(10, f"before {item} after"), (11, f"{item} and {item}"), (12, "clean words alone")], "doc_id long, text string")
    found = decontamination.contaminated(docs, bench).select("doc_id", "item_id").distinct().collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(d, i) for d in (10, 11) for i in (1, 2, 3)} and not any(r.doc_id == 12 or r.item_id in (4, 5) for r in found)
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()] == [12]


def test_one_id_with_two_texts(spark):
    text = " ".join(WORDS * 6)
    docs = spark.createDataFrame([(1, text), (1, "quite another text of some words"), (2, text), (3, "quite another text of some words")], "doc_id long, text string")
    got = jaccard.jaccard_components(docs, jaccard.Rule(4, 85, 100)).collect()
    assert {r.component_id for r in got if r.doc_id in (2, 3)} == {1} and {r.doc_id for r in got} == {1, 2, 3}


def test_token_query_equals_the_library(spark, sf_dir):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    got = queries.op9_token_output(spark, sf_dir).toPandas().set_index("doc_id").sort_index()
    start = 0
    for doc_id, text in pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")[["doc_id", "text"]].itertuples(index=False):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        r = got.loc[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_media_query_equals_its_payloads(spark, sf_dir):
    got = queries.op6_media_columns(spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    for doc_id, text in docs[["doc_id", "text"]].itertuples(index=False):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got.loc[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got.groupby("payload_sha256").feature.nunique().max() == 1 and got.groupby("payload_sha256").media_sha256.nunique().max() == 1


def test_mix_query_meets_its_contract(spark, sf_dir):
    got = queries.op10_source_mixing(spark, sf_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    docs["size"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text]
    sizes = docs.groupby("source")["size"].sum()
    names = sorted(sizes.index, key=lambda s: s.encode())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sizes.sum())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    for r in docs.itertuples():
        g = got.loc[r.doc_id]
        assert g["size"] == r.size and g.source_size == sizes[r.source] and abs(g.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and g.taken <= 3 * r.size
    taken = got.join(docs.set_index("doc_id").source).groupby("source").taken.sum()
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 64 for s in names)


def test_payloads_are_read_through_their_codes(monkeypatch):
    from docsieve.llm import media, webp

    seen, plain = [], webp._read_green

    def watched(b, w, n, g):
        seen.append((len(g[0].uniform), any(g[0].lengths[256:])))
        return plain(b, w, n, g)

    monkeypatch.setattr(webp, "_read_green", watched)
    rng = random.Random(6)
    for n in (1, 63, 500, 20_000):
        words = ["".join(rng.choice("etaoin shrdlu") for _ in range(9)) for _ in range(20)]
        payload = media.payload_of(" ".join(rng.choice(words) for _ in range(n)))[0]
        stored = webp.encode_samples(payload)
        assert webp.decode_samples(stored).tobytes() == payload and len(stored) < len(payload) + 64
    assert len(seen) == 4 and all(kinds > 1 for kinds, _ in seen[1:]) and all(copies for _, copies in seen)


def test_array_reader_equals_the_walk_by_symbols(monkeypatch):
    from docsieve.llm import webp

    rng = random.Random(7)
    data = bytes(rng.choice(b"abcdefghij" * 3 + bytes(range(256))) for _ in range(64 * 40)) * 3 + b"q" * 64 * 90 + b"ab" * 640
    stored = webp.encode_samples(data)
    monkeypatch.setattr(webp, "STRIDE", 97)
    quick = webp.decode(stored)[0]
    monkeypatch.setattr(webp, "_image", lambda b, w, h, top: by_symbols(b, w, h))

    def by_symbols(b, w, h):
        b.read(1), b.read(1)
        g = webp._read_group(b, (webp.GREEN_SIZE, *[webp.CHANNEL_SIZE] * 3, webp.DISTANCE_SIZE))
        out = []
        while len(out) < w * h:
            s = g[0].next(b)
            if s < 256:
                out.append(s)
                continue
            n, d = webp._extended(b, s - 256), webp._extended(b, g[4].next(b))
            if d > 120:
                d -= 120
            else:
                dx, dy = webp.NEAR[d - 1]
                d = max(1, dx + dy * w)
            for _ in range(n):
                out.append(out[-d])
        return np.array(out, np.uint32) << 8 | np.uint32(0xFF000000)

    assert (webp.decode(stored)[0] == quick).all()
    assert (quick >> 8 & 255).astype(np.uint8).tobytes() == data


def test_codes_of_images_are_read_and_written_in_one_go(monkeypatch):
    """A code's lengths and words are moved as whole numbers, not a few bits a call; single symbols share their codes."""
    import numpy as np

    from docsieve.llm import webp

    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(60)]
    payload = b" ".join(words[k] for k in rng.integers(0, 60, 900))
    payload += b"\0" * (-len(payload) % 64)
    reads, puts, read, put = [], [], webp.Bits.read, webp.Writer.put
    monkeypatch.setattr(webp.Bits, "read", lambda b, n: reads.append(n) or read(b, n))
    monkeypatch.setattr(webp.Writer, "put", lambda w, v, n: puts.append(n) or put(w, v, n))
    stored = webp.encode_samples(payload)
    assert webp.decode_samples(stored).tobytes() == payload and len(stored) < len(payload) / 2
    assert len(puts) < 40 and len(reads) < 60
    assert webp._simple(256, 0) is webp._simple(256, 0) and webp._simple(256, 255).only == 255
    for odd in (b"\0" * 64, bytes(range(256)), b"ab" * 3200, bytes(rng.integers(0, 256, 6400).astype(np.uint8)), b"\7" * 64 * 16385):
        assert webp.decode_samples(webp.encode_samples(odd)).tobytes() == odd


def test_many_images_are_written_and_read_together(monkeypatch):
    """Payloads of a batch share the array operations: the same bytes as one by one, and few symbols are read alone."""
    import numpy as np
    import pytest

    from docsieve.llm import webp

    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(80)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 80, n)) for n in rng.integers(1, 700, 150)]
    texts += [b"", b"", b"a" * 5000, bytes(range(256)) * 3, bytes(rng.integers(0, 256, 6400).astype(np.uint8)), b"ab" * 64 * 16400]
    payloads = [t + b"\0" * (64 - len(t) % 64 if len(t) % 64 or not t else 0) for t in texts]
    alone = [webp.encode_samples(p) for p in payloads]
    groups, stored, pixels, read = [], webp._stored, [], webp._read_green
    monkeypatch.setattr(webp, "_stored", lambda part, images: groups.append(len(images) - 1) or stored(part, images))
    monkeypatch.setattr(webp, "_read_green", lambda b, w, n, g, out=None, at=0: pixels.append(n - at) or read(b, w, n, g, out, at))
    made = webp.encode_many(payloads)
    assert made == alone and len(groups) < 8 and max(groups) > 60
    many = webp.decode_many(made)
    assert [x.tobytes() for x in many] == payloads
    assert len(pixels) < 60
    assert [webp.decode_samples(x).tobytes() for x in made] == payloads
    assert webp.encode_many([]) == [] == webp.decode_many([])
    # A file cut short is an error among others, too.
    cut = made[3][:-64]
    size = len(cut) - 20
    cut = cut[:4] + (12 + size).to_bytes(4, "little") + cut[8:16] + size.to_bytes(4, "little") + cut[20:]
    for files in ([cut], [*made[:100], cut, *made[100:150]]):
        with pytest.raises(ValueError):
            webp.decode_many(files)
    with pytest.raises(ValueError):
        webp.encode_many([b"a" * 64, b"a" * 63])


def test_short_codes_must_be_complete():
    import pytest

    from docsieve.llm import webp

    table, codes, mask = webp._short_code((0, 1, 2, 0, 2))
    assert mask == 3 and [x >> 4 for x in table] == [1, 2, 1, 4] and [x & 15 for x in table] == [1, 2, 1, 2]
    assert codes == [0, 0, 1, 0, 3]
    for lengths in ((1, 2), (1, 1, 1), (2, 2, 2)):
        with pytest.raises(ValueError):
            webp._short_code(lengths)
