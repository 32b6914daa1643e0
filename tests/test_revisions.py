"""Digests and replays of document trees against a plain recomputation of every generation."""

import hashlib
import random

from pyspark.sql import functions as F

from docsieve.operators import review, revisions, trees

NODE = "tree string, id string, parent string, place int, kind string, text string"


def digests(nodes):
    """Each node's digest, from scratch."""
    by = {n[1]: n for n in nodes}
    out = {}

    def digest(i):
        _, _, _, _, kind, text = by[i]
        below = [digest(n[1]) for n in sorted(nodes, key=lambda n: (n[3], n[1])) if n[2] == i]
        out[i] = hashlib.sha256(f"{kind or ''}\n{len(text or '')}:{text or ''}\n{','.join(below)}".encode()).hexdigest()
        return out[i]

    for n in nodes:
        if n[2] not in by:
            digest(n[1])
    return out


def test_replay(spark):
    rng = random.Random(7)
    nodes = []
    for tree in ("a", "b", "c"):
        nodes.append((tree, "n0", None, 0, "document", None))
        nodes += [(tree, f"n{k}", f"n{rng.randrange(max(0, k - 6), k)}", rng.randint(0, 4), rng.choice(["page", "cell", None]), rng.choice(["x", "é\n", "", None])) for k in range(1, 25)]
    edits = [(rng.choice("abb"), rng.randint(1, 6), f"n{rng.randint(0, 28)}", rng.choice(["x", "y", "", None, "é\n"])) for _ in range(60)]
    table = trees.with_paths(spark.createDataFrame(nodes, NODE), ["tree"])
    log = spark.createDataFrame(edits, "tree string, generation int, id string, text string")
    got = {}
    for r in revisions.replay(table, log, ["tree"]).collect():
        got.setdefault((r.tree, r.id), {})[r.generation] = r.digest
    for tree in ("a", "b", "c"):
        now = {n[1]: list(n) for n in nodes if n[0] == tree}
        last = {}
        for g in range(7):
            for i in {e[2] for e in edits if e[0] == tree and e[1] == g} & set(now):
                now[i][5] = max(e[3] or "" for e in edits if e[0] == tree and e[1] == g and e[2] == i)
            for i, d in digests(list(map(tuple, now.values()))).items():
                if last.get(i) != d:
                    assert got[tree, i].pop(g) == d, (tree, i, g)
                last[i] = d
    assert not any(got.values())  # no version where nothing changed
    whole = {(r.tree, r.id): r.digest for r in revisions.tree_digests(table, ["tree"]).collect()}
    assert all(whole[t, i] == d for t in ("a", "b", "c") for i, d in digests([n for n in nodes if n[0] == t]).items())
    assert revisions.replay(table.filter("false"), log, ["tree"]).count() == 0


def test_invalidated_approvals_of_absent_pages(spark):
    rows = [(1, 1, 1, True), (1, 1, 2, True), (1, 2, 2, True), (1, 3, 1, True), (1, 3, 2, True), (1, 5, 1, False), (1, 5, 2, True), (2, 1, 1, True)]
    pages = spark.createDataFrame(rows, "job_id int, generation int, page_number int, approved boolean")
    assert sorted(map(tuple, review.invalidated_approvals(pages).collect())) == [(1, 2, 1), (1, 5, 1)]


def test_broken_chains(spark):
    rows = [("ok", "a", None, 1), ("ok", "b", "a", 2), ("gap", "a", None, 1), ("gap", "b", "a", 3), ("parent", "a", None, 1), ("parent", "b", "x", 2), ("first", "a", "z", 1),
            ("twice", "a", None, 1), ("twice", "a", "a", 2), ("null", None, None, 1)]
    found = revisions.chain_error(spark.createDataFrame(rows, "job_id string, revision_id string, parent_revision_id string, generation int"))
    assert {r.job_id for r in found.filter(F.col("error_code").isNull()).collect()} == {"ok"} and found.count() == 6
