import random

import pyarrow as pa
from pyspark.sql import functions as F

from docsieve.functions import values
from docsieve.functions.text import build_surface
from docsieve.operators import aggregation, fuzzy, matching, scanning, terms
from docsieve.plans import runner
from docsieve.sources.schemas import CATALOGUE

TERM = "literal string, component string, term_role string, source_table string, source_field string, row_id string, lexical_term_id string, boundary_hint string, fuzzy_allowed boolean, display_name string, attributes map<string,string>"


def term(literal, row_id, role="material_name", hint="default", component="materials", fuzzy_ok=False, attributes=None):
    return (literal, component, role, "t", "f", row_id, None, hint, fuzzy_ok, literal, attributes or {})


def brute(literal, role, text):
    """All occurrences by trying every offset of the compared text."""
    import regex

    collapse = role in terms.NATURAL_ROLES
    key = build_surface(literal.strip(), collapse)[0]
    cmp, os_, oe, cs, ce = build_surface(text, collapse)
    begin, end = dict(zip(cs, os_)), dict(zip(ce, oe))
    word = lambda c: bool(c) and regex.fullmatch(r"[\p{L}\p{M}\p{Nd}\p{Pc}\-]", c)
    out = []
    for at in range(len(cmp)):
        if key and cmp.startswith(key, at) and at in begin and at + len(key) in end:
            a, b = begin[at], end[at + len(key)]
            if not (a and word(text[a - 1])) and not word(text[b : b + 1]):
                out.append((a, b, text[a:b]))
    return out


def test_exact_join_equals_brute_force(spark):
    rng = random.Random(5)
    letters = "aAbß-é1 ( ́"
    some = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    words = [w for w in {some(5) for _ in range(60)} if w.strip() and not w.startswith("́")]
    roles = {w: rng.choice(["material_name", "equipment_type"]) for w in words}
    blocks = [("d", str(k), some(40)) for k in range(80)]
    hits = matching.exact_hits(
        spark.createDataFrame([term(w, w, roles[w]) for w in words], TERM), spark.createDataFrame(blocks, "doc_id string, node_id string, text string")
    )
    got = sorted((r.node_id, r.literal, r.start, r.end, r.matched_text) for r in hits.collect())
    want = sorted((n, w, *h) for _, n, t in blocks if t.strip() for w in words for h in brute(w, roles[w], t))
    assert got == want and len(got) > 30


def test_partition_independence(spark):
    t = spark.createDataFrame([term("aqua", "1"), term("AQUA pura", "2", "equipment_type")], TERM)
    b = spark.createDataFrame([("d", "1", "Aqua  pura, aqua"), ("d", "2", None), ("d", "3", "")], "doc_id string, node_id string, text string")
    a = sorted(map(tuple, matching.exact_hits(t, b.coalesce(1)).select("literal", "start", "method").collect()))
    assert a == sorted(map(tuple, matching.exact_hits(t, b.repartition(8)).select("literal", "start", "method").collect()))
    assert a == [("AQUA pura", 0, "normalized_exact"), ("aqua", 0, "normalized_exact"), ("aqua", 12, "exact")]


def test_fuzzy(spark):
    words = spark.createDataFrame([("filterx",), ("filtr",), ("falter",), ("filtre",), ("filter",)], "word string")
    keys = spark.createDataFrame([("filter",)], "key string")
    assert {r.word for r in fuzzy.one_edit_pairs(words, keys).collect()} == {"filterx", "filtr", "falter"}
    t = matching.keyed_terms(spark.createDataFrame([term("filter", "1", "equipment_type", fuzzy_ok=True), term("filter", "2", fuzzy_ok=True)], TERM))
    assert [r.row_id for r in fuzzy.fuzzy_hits(t, words).filter("word = 'filtr'").collect()] == ["1"]


def test_fuzzy_spans_are_of_the_text(spark):
    t = spark.createDataFrame([term("filter", "1", "equipment_type", fuzzy_ok=True), term("strasse", "2", "equipment_type", fuzzy_ok=True), term("crémer", "3", "equipment_type", fuzzy_ok=True)], TERM)
    texts = ["filtr a  b \n\n filtr, Straße filtr", "cre\u0301me  Filtr cre\u0301mes x\u0302filtr filtr\u0302 filtr-", "Straßen  STRASE\tFIlTR", "ßßß falter", None, "  "]
    b = spark.createDataFrame([("d", str(k), x) for k, x in enumerate(texts)], "doc_id string, node_id string, text string")
    hits = runner.dictionary_hits(t, b, True).filter("method = 'fuzzy'").collect()
    got = sorted((int(r.node_id), r.start, r.end, r.matched_text, r.row_id) for r in hits)
    at = lambda k, word, row, after=0: (k, texts[k].index(word, after), texts[k].index(word, after) + len(word), word, row)
    assert got == sorted([
        at(0, "filtr", "1"), at(0, "filtr", "1", 5), at(0, "filtr", "1", 20), at(1, "cre\u0301me", "3"), at(1, "Filtr", "1"), at(1, "cre\u0301mes", "3"),
        at(2, "Straßen", "2"), at(2, "STRASE", "2"), at(2, "FIlTR", "1"), at(3, "falter", "1"),
    ])


def test_terms_of_catalogue(spark):
    def table(name, *rows):
        cols = CATALOGUE[name]
        return spark.createDataFrame([tuple(r.get(c, "") for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))

    tables = {
        "materials_fda_ema": table("materials_fda_ema", {"row_id": "FMR-1", "UNII": "T2G0WI9NEZ", "material_name": "Water", "alias_name": "aqua"},
                                   {"row_id": "FMR-2", "material_name": "NA", "alias_name": "None"}),
        "materials_chebi": table("materials_chebi", {"row_id": "CHR-1", "material_name": "(+)-Sparteine", "alias_name": "(+)-Sparteine", "alias_type": "hasRelatedSynonym"}),
        "equipment": table("equipment", {"row_id": "EQR-1", "Equipment type (EN)": "Container Blender", "Operating parameter (EN)": "Mixing speed", "Unit": "rpm"}),
        "unit_operations": table("unit_operations", {"row_id": "UOR-1", "Search term (EN)": "sieving", "Index this row": "TRUE", "Match policy": "direct_candidate", "Process step (EN)": "sieve it"},
                                 {"row_id": "UOR-3", "Search term (EN)": "drying", "Index this row": "FALSE", "Match policy": "step_cue_only"}),
    }
    got = {(r.row_id, r.term_role, r.literal, r.fuzzy_allowed) for r in terms.eligible_terms(tables, terms.COMPONENTS).collect()}
    assert got == {
        ("FMR-1", "material_name", "Water", False), ("FMR-1", "material_alias", "aqua", False), ("FMR-1", "unii", "T2G0WI9NEZ", False),
        ("FMR-2", "material_alias", "None", False), ("CHR-1", "material_name", "(+)-Sparteine", False), ("CHR-1", "material_alias", "(+)-Sparteine", False),
        ("EQR-1", "equipment_type", "Container Blender", False), ("EQR-1", "parameter_name", "Mixing speed", False), ("EQR-1", "unit_spelling", "rpm", False),
        ("UOR-1", "unit_operation", "sieving", True), ("UOR-1", "process_step", "sieve it", False),
    }


def test_occurrences_choose_one(spark):
    span = ["doc_id", "node_id", "start", "end", "matched_text"]
    t = spark.createDataFrame([term("water", "2", "material_alias"), term("water", "9"), term("water", "10"), term("x-y", "3", attributes={"alias_type": "hasRelatedSynonym"})], TERM)
    b = spark.createDataFrame([("d", "1", "water and Water, x-y")], "doc_id string, node_id string, text string")
    found = {(r.start, r.row_id, r.term_role, r.ambiguity, r.method) for r in aggregation.occurrences(matching.exact_hits(t, b), span).collect()}
    assert found == {(0, "10", "material_name", "unresolved", "exact"), (10, "10", "material_name", "unresolved", "normalized_exact"), (17, "3", "material_name", "context_required", "exact")}
    best = aggregation.best_per_page(aggregation.occurrences(matching.exact_hits(t, b), span), ["doc_id"])
    assert sorted(r.start for r in best.collect()) == [0, 17]


def test_units(spark):
    t = spark.createDataFrame([term("mL", "E-1", "unit_spelling", "atomic_unit", "units"), term("ml", "vocab:mL", "unit_spelling", "atomic_unit", "units")], TERM)
    b = spark.createDataFrame([("d", "1", "5 mL, 6ml, xml"), ("d", "2", None)], "doc_id string, node_id string, text string")
    got = {(r.start, r.row_id, r.method, tuple(r.supporting_row_ids)) for r in aggregation.unit_mentions(matching.unit_hits(t, b)).collect()}
    assert got == {(2, "E-1", "exact", ("vocab:mL",)), (7, "vocab:mL", "exact", ("E-1",))}
    assert F.col("x") is not None


def test_scanner_equals_brute_force():
    rng = random.Random(11)
    letters = "aAbß-é1 ( .\u0301İ\n\t₂µ"
    some = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    keys = {False: set(), True: set()}
    for collapse in keys:
        keys[collapse] = {k for _ in range(150) if (k := build_surface(some(9).strip(), collapse)[0])}
    texts = [some(60) for _ in range(150)] + ["", "a" * 40, "." * 50]
    dictionaries = {c: scanning.Dictionary(*scanning.key_numbers(k)) for c, k in keys.items()}
    for units in (False, True):
        got = matching.scan(pa.array(texts), dictionaries, units).to_pylist()
        for text, hits in zip(texts, got, strict=True):
            want = []
            for collapse, names in keys.items():
                cmp, os_, oe, cs, ce = build_surface(text, collapse)
                begin, end = dict(zip(cs, os_)), dict(zip(ce, oe))
                for a in range(len(cmp)):
                    for b in range(a + 1, len(cmp) + 1):
                        if cmp[a:b] in names and a in begin and b in end and free(text, begin[a], end[b], units):
                            want.append((collapse, begin[a], end[b], text[begin[a] : end[b]], cmp[a:b]))
            assert sorted((h["collapse"], h["start"], h["end"], h["matched_text"], h["key"]) for h in hits) == sorted(want)


def free(text, start, end, units):
    import regex

    word = r"[\p{L}\p{M}\p{Nd}\p{Pc}\-]"
    if units:
        return values.unit_boundary(text, start, end)
    return not (start and regex.fullmatch(word, text[start - 1])) and not regex.fullmatch(word, text[end : end + 1])


def test_shards_give_the_same_hits(spark):
    t = spark.createDataFrame([term(f"name {k}", str(k), ["material_name", "equipment_type"][k % 2]) for k in range(60)], TERM)
    b = spark.createDataFrame([("d", str(k), f"Name {k}, name  {k + 1} and name {k}") for k in range(60)], "doc_id string, node_id string, text string")
    some = lambda n: sorted(map(tuple, matching.exact_hits(t, b, n).select("node_id", "literal", "start", "end", "method").collect()))
    assert some(7) == some(1000) and len(some(7)) > 100


def test_lines_of_signs_leave_only_their_hits(spark):
    dots = [f"contents {'.' * 3000} page {k} end" for k in range(200)]
    names = ["(+)-Sparteine", "page 7 end", "...x", "end", ". . ."] + [f"(k{k}R)-compound x{k}" for k in range(300)]
    t = spark.createDataFrame([term(x, str(k)) for k, x in enumerate(names)], TERM)
    b = spark.createDataFrame([("d", str(k), x) for k, x in enumerate(dots)] + [("d", "x", "(+)-sparteine (k9R)-Compound x9")], "doc_id string, node_id string, text string")
    found = matching.key_hits(matching.keyed_terms(t).select("collapse", "key").distinct(), b)
    got = [(r.node_id, r.key) for r in found.select("node_id", "key").collect()]  # all that leaves the scan
    assert sorted(got) == sorted([*((str(k), "end") for k in range(200)), ("7", "page 7 end"), ("x", "(+)-sparteine"), ("x", "(k9r)-compound x9")])
