"""Small tests for the findings of round four."""

import random

import numpy as np
import pyarrow as pa

from docsieve.operators import matching, scanning
from docsieve.plans import queries as plans

from test_matching import TERM, term


def test_hits_are_never_broadcast_and_texts_scanned_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(matching, "SENT_TERMS", 10, raising=False)
    for held in (10, 10**6):
        hits = matching.exact_hits(plans.lot_terms(spark, sf_dir), plans.order_notes(spark, sf_dir), held).select("doc_id", "literal", "start", "method")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan  # Spark takes these hits for less than 10 MB at any size
        assert plan.count("ArrowEvalPython [found") == 1 == plan.count("ArrowEvalPython [comparison_key")
    few = spark.createDataFrame([term("lot 1-1", "1")], TERM)
    plan = matching.exact_hits(few, plans.order_notes(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan  # few terms go to their hits


def test_filters_keep_every_place_and_few_others(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab c.(") for _ in range(rng.randint(1, 40))).strip() or "a" for _ in range(2000)})
    texts = ["".join(rng.choice("ab c.(") for _ in range(200)) + " " + rng.choice(names) + " x" for _ in range(200)]
    t = spark.createDataFrame([term(x, str(k), ["material_name", "parameter_name"][k % 2]) for k, x in enumerate(names)], TERM)
    b = spark.createDataFrame([("d", str(k), x) for k, x in enumerate(texts)], "doc_id string, node_id string, text string")
    some = lambda n: sorted(map(tuple, matching.exact_hits(t, b, n).select("node_id", "literal", "start", "end", "method").collect()))
    assert some(0) == some(10**6) and len({len(r[1]) for r in some(0)}) > 20
    full = np.full(1 << scanning.FILTER_BITS - 3, 255, np.uint8)  # as of hundreds of millions of whole keys
    made = matching._filters(spark.createDataFrame([(True, f"({k}.4)-sample of lot") for k in range(1000)], "collapse boolean, key string"))
    made[True].bits[scanning.WHOLE] = full
    hits = matching.scan(pa.array(["(17.4)-sample of lot (17.4)-samples of lot; (a.b.c.d.e.f.g.h.i.j.k.l) ......................"]), made).to_pylist()
    assert [h["key"] for h in hits[0]] == ["(17.4)-sample of lot"]
