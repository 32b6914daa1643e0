from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsieve.functions import text, tolerance, units, values

U = values.Units()


def forms(t):
    return [(v["form"], v["raw"]) for v in values.read_values(t, U)]


def test_value_forms():
    got = forms("fill 3.75 g, warm to 41 — 44 °C, keep >= 7 bar or 60±4 rpm; again .5 kg")
    assert got == [("scalar", "3.75 g"), ("range", "41 — 44 °C"), ("comparison", ">= 7 bar"), ("tolerance", "60±4 rpm"), ("scalar", ".5 kg")]
    assert forms("8rpm 9 %") == [("scalar", "8rpm"), ("scalar", "9 %")]
    for none in ("kg", "17", "rpm/kg", "stage 4 kg", "p. 6 g", "LOT_77 g", "v9 g", "x7-8 g", "3 or more", "lot-5 kg", "offset", "OFFER"):
        assert forms(none) == [], none
    row = values.read_values("1,250.5 g of 12,5 g", U)[0]
    assert (row["low"], row["ambiguous"], row["unit"], row["raw"]) == ("1,250.5", True, "g", "1,250.5 g")
    assert forms("under vacuum, Speed:75, OFF") == [("category", "under vacuum"), ("cued", "Speed:75"), ("category", "OFF")]
    assert forms("6 g 6 g") == [("scalar", "6 g")] * 2
    assert values.read_values(None, U) == [] == values.read_values("", U)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["3", "1,000", ".5", "–", "-", "±", "<", ">=", " ", "g", "rpm", "%", "page", "OFF", "Speed:", "x", "_"]), max_size=9))
def test_values_are_apart_and_hold_their_text(pieces):
    t = "".join(pieces)
    found = values.read_values(t, U)
    assert all(t[v["start"] : v["end"]] == v["raw"] for v in found)
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
    for v in found:
        assert v["unit"] is None or t[v["unit_start"] : v["unit_end"]] == v["unit"] == v["raw"][-len(v["unit"]) :]


def test_unit_boundaries():
    for t, unit, ok in (("120rpm", "rpm", True), ("37°C", "°C", True), ("rpm/min", "rpm", False), ("rpms", "rpm", False), ("xrpm", "rpm", False)):
        at = t.index(unit)
        assert values.unit_boundary(t, at, at + len(unit)) is ok, t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAéÉßİǰŉ́ \t\x1c\xa0.-1Ωſ", max_size=12), st.booleans())
def test_plain_surface_is_the_general_one(t, collapse):
    plain = text.plain_surface(t, collapse)
    kept, text.plain_surface = text.plain_surface, lambda t, c: None
    try:
        cmp, os_, oe, cs, ce = text.build_surface(t, collapse)
    finally:
        text.plain_surface = kept
    at = list(range(len(t)))
    assert plain is None or (plain, at, at) == (cmp, os_, cs) and oe == ce == [k + 1 for k in at]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAß İé́ \t.-1", max_size=30), st.booleans())
def test_surface_covers_text(t, collapse):
    cmp, os_, oe, cs, ce = text.build_surface(t, collapse)
    assert os_ == [0, *oe][: len(os_)] and cs == [0, *ce][: len(cs)]
    assert (not t) == (not cmp) and (not oe or (oe[-1], ce[-1]) == (len(t), len(cmp)))
    if not collapse:
        assert len(os_) <= len(t)


def test_tolerance(spark):
    yes = ["Tolerance + 4", "toler +2.5 %", "TOLER. +  7,25", "Tolerance +12"]
    no = ["Tolerance ± 4", "Toler +/- 2.5 %", "Tolerance +4 / - 3", "Tolerant +4", "Tolerance 4", "", "+ 4"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r.t: (r.a, r.s) for r in df.select("t", tolerance.is_ambiguous_tolerance(F.col("t")).alias("a"), tolerance.suggested_text(F.col("t")).alias("s")).collect()}
    assert [got[t][0] for t in yes + no] == [True] * len(yes) + [False] * len(no)
    assert got["Tolerance + 4"][1] == "Tolerance ± 4"


def test_unit_cells_and_text_functions(spark):
    cells = {"rpm": True, "mL/min": True, "min⁻¹": True, "n/a": False, "bar or Pa": False, "2-6": False, "12": False, "": False, "x¹": False, "a;b": False, "a b": False}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r.c: r.u for r in df.select("c", units.is_unit_cell(F.col("c")).alias("u")).collect()} == cells
    row = spark.createDataFrame([(' a<b&"c" \t d ',)], "c string").select(
        text.escape_html(F.col("c")).alias("h"), text.tsv_cell(F.col("c")).alias("t"), text.evidence_text(F.col("c")).alias("e"),
        text.casefold(F.lit("Straße")).alias("f"), text.respects_boundary(F.lit("(AB)"), F.lit(1), F.lit(3), F.lit("whole_code")).alias("b"),
    ).first()
    assert row.h == " a&lt;b&amp;&quot;c&quot; \t d " and row.t == 'a<b&"c" d' and row.e == 'a<b&"c" d' and row.f == "strasse" and row.b


def test_page_words_count_within_eight_characters(spark):
    texts = ["page 5 kg", "page    5 kg", "page     5 kg", "page           5 kg", "Step 3 rpm", "stage   5 kg", "stage    5 kg", "mypage 5 kg", "p. 5 kg"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = table.select("k", F.size(values.value_expressions(F.col("t"))).alias("n")).orderBy("k").collect()
    assert [r.n for r in found] == [0, 0, 1, 1, 0, 0, 1, 1, 0]
