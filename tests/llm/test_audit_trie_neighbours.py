"""Source divergence, prefix trie and nearest neighbours against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.llm import divergence, neighbours, prefix_trie, queries
from docsieve.session import read_table

# --- 11 source divergence ----------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def plain_audit(rows, least_docs, ranks):
    docs = [((a or ""), (b or ""), [t.translate(LOWER) for t in TERM.findall(x or "")]) for x, a, b in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        own = [(b, ts) for a, b, ts in docs if a == lang]
        seen = Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t in seen if seen[t] >= least_docs)
        count = defaultdict(Counter)
        for b, ts in own:
            count[b].update(t for t in ts if t in set(kept))
        count = {b: count[b] for b in {b for b, _ in own}}
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {b: share(c) for b, c in count.items()}, share(every)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for b in count:
            pairs = sorted((-sum(f(p[b][t], p[o][t]) for t in kept), o.encode()) for o in count if o != b)
            terms = sorted((-f(p[b][t], q[t]), t.encode()) for t in kept if count[b][t] > 0 and p[b][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, b, part, x.decode(), -v, k + 1) for k, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 10_000])
def test_divergence(spark, block):
    rng = random.Random(5)
    words = ["alpha", "Beta", "gämma", "DELTA", "İx", "x", "日本", "naïve", "zeta", "omega"] + [f"w{chr(97 + k)}" for k in range(20)]
    seps = [" ", ", ", "\n", "-", "1", "\x00", "@", "[", "`", "{", "\x7f"]
    texts = ["".join(rng.choice(words[: 4 + k % 26]) + rng.choice(seps) for _ in range(rng.randint(0, 30))) for k in range(150)]
    rows = [(t, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S é", None, "", "s9"])) for t in texts]
    rows += [rows[0]] * 12 + [(None, "en", "null text"), ("", "xx", "a"), (None, "xx", "b"), ("one", "xx", None), ("same same", "yy", "only")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n long").repartition(5)
    got = divergence.audit(docs, least_docs=3, ranks=4, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 3, 4)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).count() == 0


def test_divergence_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 64)
    rng = random.Random(2)
    text = " ".join(rng.choice(["aa", "BB", "éé", "c" * 300]) for _ in range(400))
    batch = pa.record_batch([pa.array(["en"]), pa.array(["s"]), pa.array([text])], names=["lang", "source", "text"])
    got = divergence.count_part(batch).to_pylist()
    want = Counter(t.translate(LOWER) for t in TERM.findall(text))
    assert {(r["term"], r["n"]) for r in got} == set(want.items()) and all(r["docs"] == 1 for r in got)


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.randint(1, 9 * 10**15)
        count = rng.choice([total, rng.randint(0, total), rng.randint(0, min(total, 50))])
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


# --- 12 prefix trie ----------------------------------------------------------------------------------------------


def plain_trie(rows, rebuild=True):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(a, b) for _, _, a, b in sorted(x)] for c, x in turns.items()}
    convs = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = own.get(c - int(math.fmod(c, 20)), [])
        convs[c] = family[:h] + x[h:] if rebuild else x
    members = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [n for n in members if len(n) == len(node) + 1 and n[:-1] == node]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        leaves = sum(out[n][5] for n in below) or 1
        saved = (len(members[node]) - 1) * words + sum(out[n][6] for n in below)
        up = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), up, len(members[node]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def test_trie(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for c in [*range(90), 2**40 + 3, 2**40, -7, -20]:
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c\n d  e", "", None, "a b"])))
    rows += [(200, k, "user", f"turn {k // 3}") for k in range(70)] + [(201, k, "user", f"turn {k // 3}") for k in range(45)]
    rows += [(60, 0, "user", "a b")] * 3 + [(None, 0, "user", "a b"), (399, 0, "user", "x"), (398, 0, "user", "x")]
    table = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    placed = prefix_trie.placed_turns(table)
    c = F.col("conv_id")
    out = prefix_trie.trie(*prefix_trie.rebuilt_turns(placed, c - c % 20, (F.crc32(c.cast("string")) % 4).cast("long"), 3))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_trie(rows)
    assert any(r[1] == 0 and r[3] == len({x[0] for x in rows} - {None}) for r in plain_trie(rows))


def test_trie_of_nothing_and_of_plain_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = prefix_trie.placed_turns(spark.createDataFrame([(None, 1, "user", "x")], schema))
    none = F.lit(0).cast("long")
    assert prefix_trie.trie(*prefix_trie.rebuilt_turns(empty, F.col("conv_id"), none, 0)).count() == 0
    long = "word " * 300_000
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", long + "x"), (3, 0, "user", long + "y")]
    out = prefix_trie.trie(*prefix_trie.rebuilt_turns(prefix_trie.placed_turns(spark.createDataFrame(rows, schema)), F.col("conv_id"), none, 0))
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_trie(rows, rebuild=False)


def test_digests_of_many_ids():
    ids = list(range(-5, 3000, 7))
    rows = pa.record_batch([pa.array([4] * len(ids) + [9]), pa.array([*ids, 1])], names=["node", "conv_id"])
    halves = [rows.slice(0, 100), rows.slice(100)]
    chunks = list(prefix_trie._joined_ids(iter(halves)))
    got = {r["node"]: r["ends_sha256"] for b in prefix_trie._digested(iter(chunks)) for r in b.to_pylist()}
    assert got == {4: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 9: hashlib.sha256(b"1").hexdigest()}


# --- 13 nearest neighbours ---------------------------------------------------------------------------------------


def plain_nearest(vectors, asks, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for i, v in enumerate(ids):
        if asks(v):
            s = (x * x[i]).sum(1) / (n * n[i])
            s[i] = -np.inf
            out[int(v)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]
    return out


def found(frame):
    out = defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


@pytest.mark.parametrize("width", [1, 7, 16])
def test_nearest_with_the_full_residual_is_exact(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width))
    x[50:90] = x[50] + 1e-4 * rng.normal(size=(40, width))  # near copies: equal codes
    x[90:95], x[95] = x[3], -x[3]  # ties
    rows = [(int(i) if i != 7 else 2**53 + 1, [float(a) for a in v], "clash", True) for i, v in enumerate(x)]
    vectors = {r[0]: r[1] for r in rows}
    bad = [None, [], [0.0] * width, [None] * width, [float("nan")] * width, [float("inf")] * width, [1.0] * (width + 1)]
    rows += [(1000 + 50 * k, b, "bad", False) for k, b in enumerate(bad)] + [(None, [1.0] * width, "", True), rows[0], rows[0]]
    rows += [(350, [float(a) for a in [x[350][0] + 1.0, *x[350][1:]]], "another vector", True)]
    vectors[350] = min(vectors[350], rows[-1][1])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, is_query boolean").repartition(4)
    got = found(neighbours.nearest(table, F.col("vec_id") % 50 == 0, slack=math.sqrt(width), sample=128, block=64))
    want = plain_nearest(vectors, lambda v: v % 50 == 0, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-14)


def test_nearest_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1e300, 1e300]), (3, [1e-300, 0.0])], "vec_id long, embedding array<double>")
    got = found(neighbours.nearest(table, F.col("vec_id") % 50 == 0))
    assert [i for i, _ in got[0]] == [3, 50] and got[0][0][1] == 1.0 and [i for i, _ in got[50]] == [0, 3]
    assert neighbours.nearest(table.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(table.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = found(queries.op13_nearest_neighbours(spark, sf))
    table = read_table(spark, sf, "embeddings").toPandas()
    want = plain_nearest(dict(zip(table.vec_id, table.embedding, strict=True)), lambda v: v % 50 == 0, 5)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_codes_prefer_errors_across_the_vector():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 32))
    plain, aware = neighbours.fit(x, least_cosine=0.0), neighbours.fit(x, least_cosine=0.4)
    unit = neighbours.unit_rows(x)[2]

    def along(m):
        return np.abs((unit * (unit - m.decode(m.encode(unit)))).sum(1)).mean()

    assert aware.eta > 1 == plain.eta and along(aware) < along(plain)
    codes = aware.encode(unit)
    packed = neighbours.pack(codes)
    assert packed.shape == (2000, 8) and (packed >> 4 == codes[:, 0::2]).all() and (packed & 15 == codes[:, 1::2]).all()
    scan = sum(aware.tables(unit[:3])[j][packed[:, j]] for j in range(8))
    assert np.allclose(scan, aware.decode(codes) @ unit[:3].T, atol=1e-5)


def test_queries_hold_on_pandas(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").toPandas()
    got = queries.op12_prefix_trie(spark, sf_dir).toPandas()
    plain = [(r.conv_id, None if pd.isna(r.turn) else r.turn, r.role, r.text) for r in rows.itertuples()]
    want = plain_trie(plain)
    assert len(got) == len(want) and sorted(got.ends_sha256) == sorted(w[7] for w in want) and got.saved_tokens.sum() == sum(w[6] for w in want)
