import random
import unicodedata
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import ground, intervals, layout, ledger, skew, units_graph
from factloom.plans import ledger_queries
from factloom.session import cut
from factloom.streaming.intervals import gaps_through_state


def test_interval_map_against_days():
    rng = random.Random(5)
    for _ in range(200):
        m, days = intervals.IntervalMap(), set()
        for _ in range(rng.randrange(12)):
            s = rng.randrange(40)
            e = s + rng.randrange(-2, 8)
            m.insert(s, e)
            days |= set(range(s, e))
        assert {d for s, e in zip(m.starts, m.ends) for d in range(s, e)} == days
        assert all(a < b for a, b in zip(m.ends, m.starts[1:])), "touching intervals are one"


def test_gaps_and_periods(spark):
    d = lambda n: date(2020, 1, 1) + timedelta(n)
    rng, rows, want = random.Random(1), [], {}
    for key in ("a", "hot", "b"):
        days = set()
        for _ in range({"hot": 60}.get(key, 6)):
            s = rng.randrange(300)
            e = s + rng.randrange(-3, 12)
            rows.append((key, d(s), d(e), "x"))
            days |= set(range(s, e))
        ds = sorted(days)
        want[key] = {(key, str(d(x + 1)), str(d(y))) for x, y in zip(ds, ds[1:]) if y > x + 1}
    rows += [("a", None, None, "x"), (None, d(1), d(2), "x"), ("open", None, d(3), "x"), ("open", d(9), None, "x"), ("open", None, d(3), "x")]
    df = spark.createDataFrame(rows, "k string, s date, e date, period_start string")
    got = {tuple(r) for r in intervals.gaps(df.repartition(3), "k", "s", "e").collect()}
    assert got == want["a"] | want["b"] | want["hot"] | {("open", str(d(3)), str(d(9)))}
    assert {tuple(r) for r in gaps_through_state(df.repartition(3), "k", "s", "e").collect()} == got
    assert gaps_through_state(df.limit(0), "k", "s", "e").count() == 0
    p = intervals.periods(df, "k", "s", "e").filter("k = 'open'").orderBy(F.asc_nulls_first("period_start")).collect()
    assert [tuple(r) for r in p] == [("open", None, d(3)), ("open", d(9), None)]
    assert intervals.gaps(df.limit(0), "k", "s", "e").count() == 0


def test_best_window_against_brute_force():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    rng = random.Random(2)
    for _ in range(150):
        q = "".join(rng.choices("abc ", k=rng.randrange(1, 9)))
        b = "".join(rng.choices("abc ", k=rng.randrange(len(q), 20)))
        m = len(q)
        best = max(200 * lcs(q, b[max(i, 0) : i + m]) / (m + len(b[max(i, 0) : i + m])) for i in range(-(m - 1), len(b)))
        score, lo, hi = ground.best_window(q, b)
        assert score == pytest.approx(best)
        if q not in b and best > 0:
            ways = [(max(i, 0), min(i + m, len(b))) for i in range(-(m - 1), len(b))]
            assert (lo, hi) == next((x, y) for x, y in ways if 200 * lcs(q, b[x:y]) / (m + y - x) == score)


def test_fold_against_string_calls():
    def brute(t):
        out, at = [], []
        for i, ch in enumerate(t):
            for x in "-" if ch in ground.DASHES else unicodedata.normalize("NFKC", ch):
                if x.isspace() and out and out[-1] == " ":
                    continue
                out.append(" " if x.isspace() else x)
                at.append(i)
        return "".join(out), at

    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0x20, 0x400), *range(0x1E00, 0x2200), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF60), 0x3000, 0x1F600, 0x1D400, 0xFDFA, 0xE0020, 0x30010, 0xAC01]] + [" ", "\t", "\n"] * 400
    texts = ["", " ", "a\u00a8 b", *("".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(800))]
    got, at = ground.fold_all(texts)
    assert [(g, list(a)) for g, a in zip(got, at)] == [brute(t) for t in texts]


def test_gate_partitions_proposals(spark):
    blocks = spark.createDataFrame([("b1", "Revenue from operations was Rs. 100 crore in FY24. More text follows here."), ("b2", ""), ("b3", None)], "block_id string, text string")
    rows = [
        ("exact", "b1", "Rs. 100 crore"), ("dash", "b1", "Revenue from operati­ons was"), ("typo", "b1", "Revenue from operatoins was Rs. 100 crore in FY24"),
        ("far", "b1", "Something else was said entirely"), ("blank", "b1", "  "), ("null", "b1", None), ("empty", "b2", "quote"), ("nullblock", "b3", "quote"), ("lost", "zz", "quote"),
    ]
    g = {r.id: r for r in ground.ground(spark.createDataFrame(rows, "id string, block_id string, quote string"), blocks, ["block_id"]).collect()}
    assert len(g) == len(rows)
    assert g["exact"].score == 100 and (g["exact"].char_start, g["exact"].char_end) == (28, 41) and g["exact"].reason is None
    assert g["typo"].reason is None and g["dash"].reason is None and g["far"].reason.startswith("partial_ratio")
    assert g["blank"].reason == g["null"].reason == "empty evidence_quote"
    assert g["empty"].reason == g["nullblock"].reason == "quote or block empty after normalization"
    assert g["lost"].reason == "no source block"


def test_batches_fold(spark):
    rows = [("d", i, c) for i, c in enumerate([4, 4, 4, 9, 1, 1, 1, 1])] + [("e", 0, 99)]
    out = layout.greedy_batches(spark.createDataFrame(rows, "doc_id string, i int, c int"), ["doc_id"], ["i"], F.col("c"), 10, 3)
    got = [r.batch_no for r in out.orderBy("doc_id", "i").collect()]
    assert got == [0, 0, 1, 2, 2, 3, 3, 3, 0]


SPANS = "doc_id string, page_no int, block_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double"


def test_table_is_rebuilt(spark):
    s = lambda n, t, x0, y0, x1: ("d", 1, 0, n, t, float(x0), float(y0), float(x1), float(y0) + 8)
    spans = spark.createDataFrame(
        [
            s(0, "Results for the year", 100, 0, 300), s(1, "(₹ in million)", 100, 32, 300), s(2, "FY24", 200, 50, 230), s(3, "FY23", 300, 50, 330),
            s(4, "Revenue", 10, 70, 80), s(5, "1,000", 200, 70.5, 230), s(6, "900", 300, 71, 330),
            s(7, "Cost", 10, 90, 80), s(8, "(50)", 200, 90, 230), s(9, "40", 300, 91.5, 330), s(10, "Notes follow.", 10, 120, 90),
        ], SPANS)
    cells = {(r.label, r.value, r.header) for r in layout.header_cells(spans).collect()}
    assert cells == {("Revenue", "1,000", "FY24"), ("Revenue", "900", "FY23"), ("Cost", "(50)", "FY24"), ("Cost", "40", "FY23")}
    caption = layout.captions(spans).first().caption
    assert "Results for the year" in caption and "(₹ in million)" in caption


def test_pages_are_classified(spark):
    spans = [("t", 1, 0, i, t, x, 10.0, x + 20, 18.0) for i, (t, x) in enumerate([("1", 0.0), ("2", 50.0), ("3", 100.0)])] + [("p", 1, 0, 0, "words", 0.0, 0.0, 9.0, 9.0), ("s", 1, 0, 0, "hi", 0.0, 0.0, 9.0, 9.0)]
    pages = spark.createDataFrame([(d, 1, 100.0, 100.0, n) for d, n in (("t", 2000), ("p", 2000), ("s", 50), ("z", 0))], "doc_id string, page_no int, width double, height double, char_count int")
    shape = "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double"
    images = spark.createDataFrame([("s", 1, -50.0, 0.0, 80.0, 80.0), ("t", 1, 0.0, 0.0, 10.0, 10.0)], shape)
    got = {r.doc_id: (r.page_type, round(r.coverage, 2)) for r in layout.classify_pages(pages, spark.createDataFrame(spans, SPANS), images, spark.createDataFrame([], shape)).collect()}
    assert got == {"t": ("table", 0.01), "p": ("prose", 0.0), "s": ("slide", 0.64), "z": ("prose", 0.0)}


def test_block_text_and_headings(spark):
    r = spark.createDataFrame([([["Rev", "enue"], ["  "], ["grew"]],)], "lines array<array<string>>").select(layout.block_text(F.col("lines")).alias("t")).first()
    assert r.t == "Revenue grew"
    rows = spark.createDataFrame([("Overview",), ("It ends.",), ("",), ("x" * 81,), (None,)], "t string").select(layout.is_heading(F.col("t")).alias("h")).collect()
    assert [x.h for x in rows] == [True, False, False, False, False]


UNITS = [("INR", "money", "INR", 1.0), ("USD", "money", "USD", 1.0), ("kg", "mass", "kg", 1.0), ("tonne", "mass", "kg", 1000.0), ("bps", "share", "bps", 1.0), ("percent", "share", "bps", 100.0),
         ("million", "scale", None, 1e6), ("crore", "scale", None, 1e7), ("lakh", "scale", None, 1e5)]


def test_units_through_the_graph(spark):
    units = spark.createDataFrame(UNITS, "unit string, dimension string, common_unit string, factor double")
    schema = "id string, block_id string, fact_type string, value_raw string, value_number double, value_unit string, value_currency string, value_scale string, quote string, char_start int, char_end int"
    row = lambda i, raw, n=None, u=None, c=None, s=None, q="", block="d:p1:b0", kind="numeric", at=(0, 0): (i, block, kind, raw, n, u, c, s, q, *at)
    text = "It was 7 [kg] at last. And more."
    rows = [
        row("a", "₹(1,013.5) cr"), row("b", "12.345%"), row("c", "3 MT"), row("d", "2.5", None, "US$ Mn"), row("e", "4", q="It came to 4 (in Rs lakh)."), row("f", "7", at=(0, 22)),
        row("g", "9"), row("h", "5 kg", kind="assertion"), row("i", None, 6.0, "kg"), row("j", "8 [2]", q="8 [2]"), row("k", "１０ Ｋg"),
        # two spellings that only the fields explain: quattels are tonnes, by three facts of which one is wrong
        row("l1", "3 quattel", 3.0, "tonne"), row("l2", "4 quattel", 4.0, "tonne"), row("l3", "4 quattel", 9.0, "kg"), row("l4", "6 quattel"),
    ]
    blocks = spark.createDataFrame([("d", 1, 0, text)], "doc_id string, page_no int, block_no int, text string")
    got = {r.id: (r.common_unit, float(r.common_value)) for r in units_graph.to_common_units(spark.createDataFrame(rows, schema), blocks, units).collect()}
    want = {
        "a": ("INR", -10135000000.0), "b": ("bps", 1234.5), "c": ("kg", 3000.0), "d": ("USD", 2500000.0), "e": ("INR", 400000.0), "f": ("kg", 7.0), "i": ("kg", 6.0), "k": ("kg", 10.0),
        "l1": ("kg", 3000.0), "l2": ("kg", 4000.0), "l3": ("kg", 4000.0), "l4": ("kg", 6000.0),
    }
    assert got == want


def test_meanings_flow_along_conversions(spark):
    """Spellings known only through a factor, through other spellings, or through another filing's claim."""
    units = spark.createDataFrame(UNITS, "unit string, dimension string, common_unit string, factor double")
    schema = "id string, doc_id string, claim_key string, block_id string, fact_type string, value_raw string, value_number double, value_unit string, value_currency string, value_scale string, quote string, char_start int, char_end int"
    rows = []

    def row(raw, n=None, u=None, c=None, s=None, doc="d", claim=None):
        rows.append((f"{len(rows):03}", doc, claim, "d:p1:b0", "numeric", raw, n, u, c, s, "", 0, 0))
        return rows[-1][0]

    want = {}
    for k in (2.0, 3.0, 5.0):
        want[row(f"{k} gorms", k * 1000, "kg")] = ("kg", k * 1000)  # gorms are tonnes, by the factor
        want[row(f"{k} gorms", k, "gorm")] = ("kg", k * 1000)  # so gorm is tonnes too
        want[row(f"{k} zill INR", k * 1e7, None, "inr")] = ("INR", k * 1e7)  # zill is crore: the fields have no scale
        want[row(f"{k} plim", k, "dollem", None)] = None  # two unknowns
        want[row(f"{k} temps", k * 1.8 + 32, "kg")] = None  # an offset is no conversion
        want[row(f"{k} blarb", k, "kg", doc="a", claim=f"c{k}")] = ("kg", k)
        want[row(f"{k} snarb", None, doc="b", claim=f"c{k}")] = ("kg", k)  # as another filing states the claim
        want[row(f"{k} gorm")] = ("kg", k * 1000)
        want[row(f"{k} mn gorm", k, "mn gorm")] = ("kg", k * 1e9)
        want[row(f"{k} mn gorm", k, "gorm", None, "million")] = ("kg", k * 1e9)
    blocks = spark.createDataFrame([], "doc_id string, page_no int, block_no int, text string")
    df = spark.createDataFrame(rows + rows[:4], schema)
    out = units_graph.to_common_units(df, blocks, units).collect()
    got = {r.id: (r.common_unit, float(r.common_value)) for r in out}
    # the facts' own fields still name kg where the text's wording is not solved
    kept = {i: w for i, w in want.items() if w} | {i: ("kg", float(r[5].split()[0])) for i, r in zip(want, rows) if "temps" in r[5]}
    assert got == kept and len(out) == len(got)
    raw = {r[0]: r[5] for r in rows}
    assert all((r.solved_by == "standard") == (" mn " in raw[r.id]) for r in out)  # no field says what mn is
    assert units_graph.to_common_units(df.limit(0), blocks, units).count() == units_graph.to_common_units(df, blocks, units.limit(0)).count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("k", 1), (None, 2), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "H"), ("k", "K"), (None, "N")], "k string, v string")
    inner = skew.salted_join(left, right, "k")
    assert inner.count() == 301 and inner.columns == ["k", "i", "v"]
    assert skew.salted_join(left, right, "k", "left", spread="i").filter("v is null").count() == 2


def test_ledger(spark, tmp_path):
    rel = "id string, fact_a_id string, fact_b_id string, type string"
    led = ledger.Ledger(spark, str(tmp_path))
    led.append("relations", spark.createDataFrame([("1", "b", "a", "X"), ("2", "a", "b", "Y")], rel), ["id"])
    led.append("relations", spark.createDataFrame([("3", "a", "b", "Z"), ("4", "a", "c", "Z")], rel), ["id"])
    assert {tuple(r) for r in led.read("relations").select("id", "fact_a_id", "fact_b_id").collect()} == {("1", "a", "b"), ("4", "a", "c")}
    counts = {r.type: r.n for r in ledger.relations_by_type(spark.createDataFrame([("1", "a", "b", "REFINES")], rel)).collect()}
    assert counts["REFINES"] == 1 and len(counts) == 5
    f = spark.createDataFrame([("1", "d", "x_y", "X Y", "m", "50% off\\now")], "id string, doc_id string, subject_canonical_id string, subject_surface_form string, measure_canonical_id string, measure_surface_form string")
    assert ledger.query_facts(f, subject="X_Y").count() == 1 and ledger.query_facts(f, measure="%\\now").count() == 1 and ledger.query_facts(f, doc_id="q").count() == 0


def test_checkpoint(spark):
    assert cut(spark.range(3)).count() == 3


def test_hints_do_not_swallow_each_other(spark, tmp_path):
    import re

    text = "Paid ₹ 5 crore then $ 7 million and later 😀 € 9 bn. " + "x" * 100 + " ₹ in lakh, and £ 2 k."
    rows = [("d", 1, 0, text[:70], "prose"), ("e", 1, 0, "nothing", "prose"), ("e", 2, 0, text, "prose"), ("e", 3, 0, "₹ 1 cr", "prose")]
    spark.createDataFrame(rows, "doc_id string, page_no int, block_no int, text string, page_type string").write.parquet(str(tmp_path / "blocks.parquet"))
    got = {}
    for r in ledger_queries.scale_hints(spark, str(tmp_path)).orderBy("doc_id", "rn").collect():
        got.setdefault(r.doc_id, []).append(r.snippet)
    want = {}
    for d, _, _, t, _ in rows:
        for m in re.finditer(ledger_queries._HINT, t):
            want.setdefault(d, []).append(" ".join(t[max(0, m.start() - 60) : m.end() + 60].split()))
    assert got == {d: x[:3] for d, x in want.items()} and len(got["d"]) == len(got["e"]) == 3


def test_all_pages_are_read(spark, tmp_path):
    rows = [("d", p, b, f"{p}-{b} " + "w" * 50, "prose") for p in range(1, 100) for b in (0, 1)] + [("s", 30, 0, "short", "table"), ("s", 31, 0, None, "table"), ("s", 1, 0, "slide", "slide")]
    b = spark.createDataFrame(rows, "doc_id string, page_no int, block_no int, text string, page_type string")
    b.write.parquet(str(tmp_path / "blocks.parquet"))
    got = {r.doc_id: r.sample for r in ledger_queries.sample_text(spark, str(tmp_path)).collect()}
    assert got == {"d": "\n".join(r[3] for r in rows if r[0] == "d")[:4000], "s": "slide\nshort"} and len(got["d"]) == 4000
    routed = {(r.doc_id, r.route): tuple(r)[2:] for r in ledger_queries.route_pages(spark, str(tmp_path)).collect()}
    assert routed == {("d", "prose"): (1, 99, 198), ("s", "table"): (30, 31, 2), ("s", "skipped"): (1, 1, 1)}
    assert {tuple(r) for r in layout.route_pages(b, 10).collect()} == {("d", "prose", 1, 10, 20), ("s", "skipped", 1, 1, 1)}


def test_negative_numbers_are_cells(spark, tmp_path):
    rows = [(str(i), "d", "numeric", "Profit", v, (1, 7)) for i, v in enumerate([5.0, -7.25, 0.0, None])]
    spark.createDataFrame(rows, "id string, doc_id string, fact_type string, measure_surface_form string, value_number double, evidence struct<page_no:int,char_start:int>").write.parquet(str(tmp_path / "facts.parquet"))
    got = {(r.line, r.label, r.value, r.header) for r in ledger_queries.table_cells(spark, str(tmp_path)).collect()}
    assert got == {(n, "Profit", v, "Stated") for n, v in ((1, "5.00"), (2, "-7.25"), (3, "0.00"))} | {(n, "Profit", "7", "At") for n in (1, 2, 3)}
