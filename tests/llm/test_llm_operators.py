"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docsieve.llm import chat, decontamination, jaccard, language, media, mixing, quality, queries, secrets, suffix_dedup, suffixes, token_output, webp
from docsieve.session import read_table, stage_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, bin string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(k if ids is None else ids[k], t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    near = []
    for t in base[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    return base + near + base[:5] + [None, "", " \t\n", "A", "a", "One two", "one TWO", "é" * 80, "\x1f\xa0 x", passage + " end", "start " + passage, "ab" * 4000, "ab" * 4000 + "c"]


# --- 1 chat ----------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "\\", "<|turn|>x<|end|>", "<", "a<\\|b", "[/INST]<s>\\n\n", None, "<|"]
    rows = [(k // 4, k, ["user", "assistant", "system", None][k % 4], t) for k, t in enumerate(nasty)] + [(0, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text"))))
    for r in out.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect():
        want = sorted((t, a or "", x or "") for c, t, a, x in rows if c == r.conv_id)
        assert [(b.role, b.text) for b in r.back] == [(a, x) for _, a, x in want]
        assert r.loss == "".join(x for _, a, x in want if a == "assistant")
        assert r.formatted.count("<|") == 3 * len(want) and "</s>" not in r.formatted and "[INST]" not in r.formatted
    assert chat.format_chat(turns.filter("false").withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <", None, None, None, None, None), ("text", "|x|>", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None),
             ("audio", None, "a.wav", None, None, 1.02, None), ("document", None, "d.pdf", None, None, None, 2)]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(turns).first()
    assert r.formatted == "<|turn|>assistant<|text|>see <\\|x|><|image:0|><|audio:1|><|document:2|><|end|><|turn|>user<|text|><|end|>"
    assert [(a.ordinal, a.kind, a.ref, a.n_tokens) for a in r.attachments] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 26), (2, "document", "d.pdf", 512)]
    assert r.n_media_tokens == 542
    assert chat.format_chat(turns).select(chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("t")).first().t == "see <|x|>"


# --- 2 language ------------------------------------------------------------------------------------------------


def test_language_held_out_and_mixture(spark, sf_dir):
    out = queries.op2_language_id(spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    both = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and (both[both.held_out].lang == both[both.held_out].lang_pred).mean() > 0.95
    assert (both.held_out == both.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 4 == 2)).all() and both.score.between(0, 1).all()
    model = language.learn(read_table(spark, sf_dir, "documents"))
    en, fr = (docs[(docs.lang == x) & (docs.n_chars > 800)].text.iloc[0][:700] for x in ("en", "fr"))
    which, share = model.mixture(language.ngrams(en + " " + fr))
    assert {model.names[k] for k in which[:2]} == {"en", "fr"} and share[1] > 0.25
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(table(spark, [None, "", "12 34 !"]), model).collect()}
    assert odd == {k: ("und", 0.0) for k in range(3)}
    none = language.learn(table(spark, ["a"]).filter("false"))
    assert language.predict(table(spark, ["abc"]), none).first().lang_pred == "und"


def test_small_share_of_a_long_text(spark):
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(some) for _ in range(rng.randint(3, 9))) for _ in range(400)] for lang, some in (("aa", "aeiounrst"), ("bb", "бвгдежзик"), ("cc", "αβγδεζηθι"))}
    some = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = language.learn(spark.createDataFrame([(some(lang, 3000), lang) for lang in words], "text string, lang string"))
    long = some("aa", 20_000) + " " + some("bb", 300)
    rows = {r.doc_id: r for r in language.predict(table(spark, [long, some("aa", 20_000)]), model).collect()}
    assert rows[0].langs == ["aa", "bb"] and 0.97 < rows[0].score < 1 and 0 < rows[0].shares[1] < 0.02
    assert rows[1].langs == ["aa"] and rows[1].score == 1


# --- 3 secrets -------------------------------------------------------------------------------------------------


def plain_spans(t):
    """The contract's patterns as they stand."""
    kw = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    rules = [("assign", rf"""({kw})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    found = [(m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(rules) for m in re.finditer(p, t) if len(m.group(g)) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def test_secrets_equal_patterns(spark):
    texts = ["token=secret: abcdefgh1", 'API_KEY = "abcdefgh"', "Password:short token=longenough=1 é AKIA" + "A" * 12 + " AKIAB", "f" * 31 + " " + "0a" * 16 + "g", None, "",
             "apikey=AKIAABCDEFGHIJKLMN", "ſecret=abcdefgh12", "x" * 5000 + "passwd: 12345678", "token=abcdefgh"] * 2
    docs = table(spark, texts)
    found = secrets.findings_by_path(docs, secrets.scan_unseen(docs)).select("path", secrets.spans_text("findings", secrets.KINDS[:3]).alias("s"))
    assert {r.path: r.s for r in found.collect()} == {k: plain_spans(t or "") for k, t in enumerate(texts)}
    with_key = table(spark, ["-----BEGIN RSA PRIVATE KEY-----"])
    assert secrets.findings_by_path(with_key, secrets.scan_unseen(with_key)).select(secrets.spans_text("findings").alias("s")).first().s == "pem:0:31"


def test_ledger_is_incremental(spark):
    docs = table(spark, ["token=abcdefgh", "x", "token=abcdefgh"])
    ledger = secrets.scan_unseen(docs, rule_versions=["base-1"]).checkpoint()
    assert ledger.count() == 2
    more = table(spark, ["x", "passwd=abcdefgh"])
    new = secrets.scan_unseen(docs.unionByName(more.withColumn("doc_id", F.col("doc_id") + 10)), ledger, ["base-1"])
    assert new.count() == 1 and secrets.scan_unseen(docs, ledger, ["base-1"]).count() == 0
    assert secrets.scan_unseen(docs, ledger).select("rule_version").distinct().collect()[0][0] == "more-1"
    assert secrets.findings_by_path(docs.filter("false"), ledger).count() == 0


def test_versions_of_one_path(spark):
    texts = ["token=abcdefgh", "passwd: 12345678", "clean", "AKIA" + "B" * 16, None]
    docs = table(spark, texts + texts[:1], [7] * 5 + [8])
    blob = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for t in texts}
    new = secrets.scan_unseen(docs).checkpoint()
    pairs = [(r.blob_id, r.rule_version) for r in new.collect()]
    assert sorted(pairs) == sorted((b, v) for b in blob for v in secrets.RULES)
    found = secrets.findings_by_path(docs, new).select("path", "blob_id", secrets.spans_text("findings", secrets.KINDS[:3]).alias("s"))
    assert sorted((r.path, r.blob_id, r.s) for r in found.collect()) == sorted(
        [(7, b, plain_spans(t)) for b, t in blob.items()] + [(8, next(iter(blob)), plain_spans(texts[0]))]
    )
    known = [next(iter(blob)), "base-1"]
    rest = secrets.scan_unseen(docs, new.filter((F.col("blob_id") == known[0]) & (F.col("rule_version") == known[1])))
    assert sorted((r.blob_id, r.rule_version) for r in rest.collect()) == sorted(p for p in pairs if list(p) != known)


# --- 4 decontamination -----------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, odd_texts):
    rng = random.Random(2)
    items = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (3, 12, 40)] + [None, "!!"]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice("abcdef")
        return "".join(t)

    texts = odd_texts[:20] + ["see " + edited(items[2], n) + ", end" for n in range(0, 30, 3)] + [items[0].upper() + ".", None, "", "pre" + items[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def distance(a, t):
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(a, 1):
            cur = [i]
            for j, e in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != e)))
            prev = cur
        return min(prev)

    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a = decontamination.normalise(x)
            if t and a.strip() and (k := distance(a, decontamination.normalise(t))) <= decontamination.budget(len(a)):
                want[d, i] = k
    docs = table(spark, texts)
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 3
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contaminated(docs, bench.filter("false")).count() == 0


# --- 5 quality -------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    out = queries.op5_quality_classifier(spark, sf).toPandas()
    both = out.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 3 == 1)).all()
    test = both[both.held_out]
    assert (test.predicted == test.quality).mean() > 0.9 and out.score.between(0, 1).all() and len(out) == 1000


def test_quality_odd_rows(spark, odd_texts):
    docs = table(spark, odd_texts)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert {r.score for r in quality.train_and_score(docs, labels).collect()} == {1.0}
    assert {r.score for r in quality.train_and_score(docs, labels.filter("false")).collect()} == {0.5}
    assert list(quality.isotonic(np.ones(5), np.array([3, 1, 2, 5, 4.0]))) == [2, 2, 2, 4.5, 4.5]


# --- 6 media ---------------------------------------------------------------------------------------------------


def image(w, h, write):
    """A lossless image whose bits after the header ``write`` puts."""
    out = webp.Writer()
    for value, n in ((webp.SIGNATURE, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    write(out)
    data = out.done() + b"\0" * 4
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def one(out, *symbols):
    """A simple code of one or two symbols (ascending)."""
    out.put(1, 1)
    out.put(len(symbols) - 1, 1)
    out.put(1, 1)
    for s in symbols:
        out.put(s, 8)


def test_webp_features():
    def backwards(out):  # pixels a, b, then a copy of length 4 from distance 2 pixels
        out.put(0, 1); out.put(0, 1); out.put(0, 1)  # no transform, no cache, no entropy image
        # green: literals 1 and 2 and length symbol 256+3 (length 4): lengths 2, 2, 1 by a normal code
        lengths = [0] * webp.GREEN_SIZE
        lengths[1] = lengths[2] = 2
        lengths[259] = 1
        out.put(0, 1); out.put(15, 4)
        kinds = {0: 2, 1: 2, 2: 2, 18: 2}
        for k in webp.CODE_LENGTH_ORDER:
            out.put(kinds.get(k, 0), 3)
        out.put(0, 1)
        code = {0: 0b00, 1: 0b10, 2: 0b01, 18: 0b11}  # canonical 00, 01, 10, 11, bits reversed
        put = lambda s: out.put(code[s], 2)
        put(0); put(2); put(2)
        for n in (138, 118):
            put(18); out.put(n - 11, 7)
        put(1)
        put(18); out.put(20 - 11, 7)
        one(out, 7); one(out, 8); one(out, 255); one(out, 1)  # red, blue, alpha, distance symbol 1 (code 2: the pixel before)
        # canonical: 259 -> 0, 1 -> 10, 2 -> 11
        out.put(0b01, 2); out.put(0b11, 2); out.put(0, 1)

    px, _ = webp.decode(image(6, 1, backwards))
    assert px.tolist() == [[0xFF070108, 0xFF070208] + [0xFF070208] * 4]

    def palette(out):  # four pixels in one byte: two-bit indices of three colours, then subtract-green undone first
        out.put(1, 1); out.put(3, 2); out.put(2, 8)
        out.put(0, 1)  # the table's image: no cache
        one(out, 1, 2); one(out, 0); one(out, 0); one(out, 0); one(out, 0)
        out.put(0, 1); out.put(0, 1); out.put(1, 1)  # greens 1, 1, 2 as differences: 1, 2, 4
        out.put(0, 1); out.put(0, 1); out.put(0, 1)
        one(out, 0b10_01_00_10); one(out, 0); one(out, 0); one(out, 0); one(out, 0)

    px, _ = webp.decode(image(4, 1, palette))
    assert (px[0] >> 8).tolist() == [4, 1, 2, 4]

    def cached(out):  # the second pixel comes from the colour cache
        out.put(0, 1); out.put(1, 1); out.put(1, 4); out.put(0, 1)
        at = (0x1E35A7BD * 0xFF000500 & 0xFFFFFFFF) >> 31
        lengths = [0] * (webp.GREEN_SIZE + 2)
        lengths[5] = lengths[280 + at] = 1
        out.put(0, 1); out.put(15, 4)
        kinds = {1: 1, 0: 2, 18: 2}
        for k in webp.CODE_LENGTH_ORDER:
            out.put(kinds.get(k, 0), 3)
        out.put(0, 1)
        code = {1: (0, 1), 0: (1, 2), 18: (3, 2)}
        k = 0
        while k < len(lengths):
            run = 0
            while k + run < len(lengths) and not lengths[k + run]:
                run += 1
            if run >= 11:
                run = min(run, 138)
                out.put(*code[18]); out.put(run - 11, 7)
                k += run
            else:
                out.put(*code[lengths[k]])
                k += 1
        one(out, 0); one(out, 0); one(out, 255); one(out, 0)
        out.put(0, 1); out.put(1, 1)

    px, _ = webp.decode(image(2, 1, cached))
    assert px.tolist() == [[0xFF000500, 0xFF000500]]


def test_webp_transforms_invert():
    rng = np.random.default_rng(4)
    px = rng.integers(0, 2**32, 35, dtype=np.uint32)
    for mode in range(14):
        got = webp._predict(px.copy(), 7, 5, 2, np.full(4, mode << 8, np.uint32))
        assert got[0] == (px[0] & 0xFFFFFF) | ((int(px[0] >> 24) + 255) % 256) << 24 and len(got) == 35
    left = webp._predict(np.full(6, 0x01010101, np.uint32), 6, 1, 2, np.full(2, 1 << 8, np.uint32))
    assert [int(x & 255) for x in left] == [1, 2, 3, 4, 5, 6]
    same = webp._cross(px, 7, 5, 2, np.zeros(4, np.uint32))
    assert (same == px).all()
    moved = webp._cross(np.array([0xFF002000], np.uint32), 1, 1, 2, np.array([32], np.uint32))
    assert hex(moved[0]) == "0xff202000"
    assert len(webp.NEAR) == 120 == len(set(webp.NEAR))


def test_media_round_trip(spark, odd_texts):
    rows = {r.doc_id: r for r in media.read_payloads(media.store_payloads(table(spark, odd_texts))).collect()}
    for k, t in enumerate(odd_texts):
        p, n = media.payload_of(t)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(p) % 64 == 0 and p
    big = os.urandom(64 * webp.MAX_ROWS + 64)
    assert webp.decode_samples(webp.encode_samples(big)).tobytes() == big
    got = media.decode_images(spark.createDataFrame([(1, bytearray(webp.encode_samples(b"a" * 64)), "k"), (2, bytearray(b"no"), "k"), (3, None, "k")], "id int, media binary, width string"))
    assert sorted((r.id, r.width, r.height, r.error is None) for r in got.collect()) == [(1, 64, 1, True), (2, None, None, False), (3, None, None, False)]


# --- 7 n-gram Jaccard ------------------------------------------------------------------------------------------


def brute_components(texts, n, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    name = list(range(len(texts)))
    changed = True
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(name[i], name[j])
            changed |= name[i] != low or name[j] != low
            name[i] = name[j] = low
    return {k: (len(sets[k]), name[k]) for k in range(len(texts))}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_jaccard_equals_brute_force(spark, odd_texts, n, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "TREE", 6)  # so that blocks and trees take part
    rows = jaccard.jaccard_components(table(spark, odd_texts), jaccard.Rule(n, num, den)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(odd_texts, n, num, den)


def test_tree_join_equals_pairs():
    rng = np.random.default_rng(3)
    rule = jaccard.Rule(1, 70, 100)
    rows, sets = [], []
    for k in range(150):
        base = rng.integers(0, 2**63, 40 + 20 * (k % 3), dtype=np.uint64) if k % 5 == 0 or not sets else sets[-1][rng.random(len(sets[-1])) < 0.93]
        sets.append(np.unique(base))
        b = jaccard.bitmap(sets[-1])
        rows.append((k, len(sets[-1]), 8 * len(b), int.from_bytes(b, "little"), k if k % 7 else 0, k % 2))
    for cross in (False, True):
        may = jaccard.tree_join(rule, rows, cross)
        assert may == jaccard.few_join(rule, rows, cross)
        for i in range(150):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if rows[i][4] != rows[j][4] and (not cross or i % 2 != j % 2) and 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                    assert (j, i) in may


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(table(spark, ["a"]).filter("false")).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(table(spark, [None])).collect()] == [(0, 0, 0)]


# --- 8 suffixes ------------------------------------------------------------------------------------------------


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, depth = int(rng.integers(1, 70)), int(rng.integers(1, 14))
        s = rng.integers(1, 3, n)
        order = suffixes.suffix_order(s, depth)
        keys = [tuple(s[i : i + depth]) for i in order]
        assert sorted(order) == list(range(n)) and keys == sorted(keys)


def brute_removed(texts, ids):
    out, starts = {}, defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for i, b in zip(ids, data):
        for s in range(len(b) - 49):
            starts[b[s : s + 50]].append(i)
    for i, b in zip(ids, data):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if min(starts[b[s : s + 50]]) < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, odd_texts):
    rng = random.Random(9)
    ids = list(range(len(odd_texts)))
    rng.shuffle(ids)
    rows = suffix_dedup.remove_repeats(table(spark, odd_texts, ids)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == brute_removed(odd_texts, ids) and len(rows) == len(odd_texts)
    assert suffix_dedup.remove_repeats(table(spark, ["a"]).filter("false")).count() == 0
    one, two = "".join(chr(97 + k * 7 % 26) for k in range(90)), "".join(chr(65 + k * 11 % 26) + str(k) for k in range(60))
    mixed = suffix_dedup.remove_repeats(table(spark, [one, "zz" + one + "yy", two, two + "!"], [0, 1, 1, 2])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in mixed) == [
        (0, 90, 0, 0), (1, 94, 90, 1), (1, len(two), 0, 0), (2, len(two) + 1, len(two), 1)]
    again = suffix_dedup.remove_repeats(table(spark, ["x" * 60, "x" * 60, "x" * 60], [1, 1, None])).collect()
    assert [r.n_removed for r in again] == [0, 0, 0]


# --- 9 tokens --------------------------------------------------------------------------------------------------


def test_planes():
    for unit in ("byte", "bit"):
        for ids in (np.arange(70000), np.array([2]), np.array([2**32 - 1, 0, 65536]), np.zeros(5), np.array([1 << 16])):
            assert (token_output.unpack_block(token_output.pack_block(ids.astype(np.uint32), unit)) == ids).all()


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_token_files(spark, odd_texts, unit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = odd_texts + ["<|endoftext|> x<|ENDOFTEXT|>y, it's don't!!! 'S", "Straße ΣΑΣ, İstanbul Å ñ̃ ９", "a\x1cb c"]
    ids = [len(texts) - k for k in range(len(texts))]
    path = token_output.write_tokens(table(spark, texts, ids), queries.tokenizer_path(), stage_path(spark, "t"), unit=unit, block=64, chunk_ids=500)
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for i, r in zip(sorted(ids), got, strict=True):
        want = tokenizer.encode(texts[len(texts) - i] or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(want), want)
        start += len(want)
    crc = {r.doc_id: r.ids_crc32 for r in token_output.read_digests(spark, path).collect()}
    assert crc == {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    empty = token_output.write_tokens(table(spark, ["a"]).filter("false"), queries.tokenizer_path(), stage_path(spark, "t"))
    assert token_output.read_digests(spark, empty).count() == 0


# --- 10 mixing -------------------------------------------------------------------------------------------------


def test_targets_and_permutations():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 4], [5, 2]) == [0.0, 4.0]
    for n in (1, 2, 3, 17, 100):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(got.tolist()) == list(range(n))
    counts = mixing.draw([500, 300, 3], 7, 1)
    assert counts.sum(1).tolist() == [500, 300, 3] and (counts >= 0).all()


def test_mix(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, 0), (-5, None, 40), (-5, None, 40)], "doc_id long, source string, size long")).cache()
    one = mixing.taken_words(mixing.plan(docs, block=8)).toPandas()
    assert len(one) == docs.count() and (one.taken <= 3 * one["size"]).all()
    src = one.merge(docs.toPandas()[["doc_id", "source"]].drop_duplicates(), on="doc_id")
    by = src.groupby(src.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by.taken - by.target).abs() <= np.maximum(0.03 * by.target, 24)).all()
    two = mixing.taken_words(mixing.plan(docs, block=8)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert one.sort_values(key)[key].reset_index(drop=True).equals(two.sort_values(key)[key].reset_index(drop=True))
    assert mixing.taken_words(mixing.plan(docs.filter("false"))).count() == 0


def test_mixed_documents(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(k * 7 % 90)) for k in range(60)] + [None, ""]
    docs = table(spark, texts)
    out = mixing.mix_documents(docs, block=8).collect()
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixing.plan(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), block=8)).collect()}
    assert {r.doc_id: len(r.text.split()) for r in out} == {k: n for k, n in taken.items() if n}
    assert all(set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text) for r in out)


# --- queries ---------------------------------------------------------------------------------------------------


def test_chat_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op1_chat_formatting"]).fetchall())
    got = queries.op1_chat_formatting(spark, sf_dir)
    assert sorted(map(tuple, got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())) == want
