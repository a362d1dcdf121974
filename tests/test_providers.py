import json

import pytest
from pyspark.sql import functions as F

from factloom import providers as P
from factloom.adjudicate import answered, daily_quota, explanation_prompt, narrate
from factloom.operators import layout, ledger
from factloom.sources import extraction as X


def test_rests_and_days():
    want = {"try again in 432ms": 0.432, "Please try again in 4m45.552s": 285.552, "try again in 23h59m59s": 86399, "no hint": 60, "Try again in 2h": 7200, "try again in 7m": 420}
    assert {m: P.rest_of(m) for m in want} == pytest.approx(want)
    day = [P.Refused(429, "on tokens per day (TPD): Limit"), P.Refused(429, "", ["GenerateRequestsPerDayPerProject"])]
    minute = [P.Refused(429, "requests per minute (RPM)"), P.Refused(429, "slow down per day"), P.Refused(400, "tokens per day")]
    assert all(map(P.of_the_day, day)) and not any(map(P.of_the_day, minute))
    assert [P.passes(e) for e in [P.Refused(503), P.Refused(429), ConnectionError(), P.Refused(400), day[0], ValueError()]] == [True, True, True, False, False, False]


def keys(script, rolling=True, names=("a", "b")):
    calls, naps, now = [], [], [0.0]

    def ask(key, prompt):
        calls.append(key)
        step = script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step

    return P.Keys(ask, names, rolling, clock=lambda: now[0], sleep=naps.append), calls, naps, now


DAY = P.Refused(429, "tokens per day (TPD), try again in 5m")


def test_a_key_rests_as_long_as_it_is_told():
    k, calls, naps, now = keys([DAY, "one", "two", DAY, "three", "four"])
    assert k("p") == "one" and calls == ["a", "b"] and not naps
    assert k("p") == "two" and calls[-1] == "b"
    with pytest.raises(P.Exhausted):
        k("p")
    now[0] = 301.0
    assert k("p") == "three" and k("p") == "four"


def test_a_key_rests_for_good():
    k, calls, _, now = keys([DAY, DAY], rolling=False)
    for _ in range(2):
        with pytest.raises(P.Exhausted):
            k("p")
        now[0] = 1e9
    assert calls == ["a", "b"]
    with pytest.raises(P.Exhausted):
        keys([], names=())[0]("p")


def test_retries_wait_longer_each_time():
    k, calls, naps, _ = keys([P.Refused(503)] * 4 + ["at last"])
    assert k("p") == "at last" and naps == [2, 4, 8, 16] and set(calls) == {"a"}
    k, calls, naps, _ = keys([P.Refused(503)] * 6)
    with pytest.raises(P.Refused):
        k("p")
    assert len(calls) == 6 and naps == [2, 4, 8, 16, 32]
    k, calls, naps, _ = keys([P.Refused(400, "bad")])
    with pytest.raises(P.Refused):
        k("p")
    assert len(calls) == 1


def test_the_second_provider_answers_but_for_size():
    def fail(e):
        def run(_):
            raise e

        return run

    for e in (P.Refused(400), P.Exhausted(), ConnectionError(), ValueError()):
        assert P.in_turn([("first", fail(e)), ("second", str.upper)])("x") == ("X", "second")
    assert P.in_turn([("first", str.upper), ("second", str.lower)])("x") == ("X", "first")
    assert P.in_turn([("first", lambda _: "junk"), ("second", lambda _: "{}")], json.loads)("x") == ("{}", "second")
    with pytest.raises(P.TooLarge):
        P.in_turn([("first", keys([P.Refused(413)])[0]), ("second", str.upper)])("x")
    with pytest.raises(P.Refused):
        P.in_turn([("first", fail(ValueError())), ("second", fail(P.Refused(500)))])("x")


def test_too_large_batches_are_halved_in_order():
    asked = []

    def ask(part):
        asked.append(list(part))
        if "bad" in part and len(part) == 1:
            raise P.Refused(500, "down")
        if sum(map(len, part)) > 4:
            raise P.TooLarge("413")
        return "".join(part)

    answers, failures = P.in_halves(["ab", "cd", "e", "bad", "toolong", "f"], ask)
    assert [a for _, a in answers] == ["ab", "cde", "f"] or "".join(a for _, a in answers) == "abcdef"
    assert [p for p, _ in failures] == [["bad"], ["toolong"]] and P.in_halves([], ask) == ([], [])


def test_proposals_by_batch(spark):
    def ask(items):
        if len(items) > 2:
            raise P.TooLarge("413")
        if "boom" in items:
            raise P.Refused(500, "down")
        return json.dumps(items), "m"

    b = spark.createDataFrame([("d", 0, ["a", "b", "c"]), ("d", 1, ["boom"]), ("e", 0, []), ("e", 1, None)], "doc_id string, batch_no int, items array<string>")
    got = {(r.doc_id, r.batch_no, r.first): (r["items"], r.response, r.error) for r in X.propose(b, ask).collect()}
    assert got == {("d", 0, 0): (1, '["a"]', None), ("d", 0, 1): (2, '["b", "c"]', None), ("d", 1, 0): (1, None, "500 down")}


def test_answers_are_stored(spark, tmp_path):
    store, log = str(tmp_path / "answers"), tmp_path / "log"

    def provider(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper()

    req = spark.createDataFrame([("1", "good"), ("2", "bad"), ("1", "good")], "key string, prompt string")
    for times in (1, 2):
        got = {r.key: (r.answer, r.error) for r in answered(req, store, provider).collect()}
        assert got == {"1": ("GOOD", None), "2": (None, "down")}
        asked = log.read_text().split()
        assert asked.count("good") == 1 and asked.count("bad") == times
    rel = spark.createDataFrame([("a", "b", "SUPERSEDES", "fine")], "fact_a_id string, fact_b_id string, type string, p string")
    for _ in range(2):
        assert narrate(rel, store, provider, F.col("p")).first().explanation == "FINE"
    assert log.read_text().split().count("fine") == 1


def test_prompts_and_contexts(spark):
    f = spark.createDataFrame([("1", "S", "M", "5", "said 5"), ("2", "S", None, "6", "said 6")], "id string, subject_surface_form string, measure_surface_form string, value_raw string, quote string")
    rel = spark.createDataFrame([("1", "2", "CONTRADICTS", "VALUES_DIVERGE")], "fact_a_id string, fact_b_id string, type string, reason_code string")
    p = ledger.relation_detail(rel, f, ["subject_surface_form", "measure_surface_form", "value_raw", "quote"]).select(explanation_prompt().alias("p")).first().p
    assert "CONTRADICTS / VALUES_DIVERGE" in p and "Quote: said 5" in p and "Measure: unstated" in p
    rows = [("d", '{"publisher":"P","currency":null,"scale":"crore"}'), ("e", "junk"), ("f", None)]
    got = {r.doc_id: r.context for r in X.document_contexts(spark.createDataFrame(rows, "doc_id string, answer string")).collect()}
    assert got == {"d": {"publisher": "P", "scale": "crore", "doc_id": "d"}, "e": {"doc_id": "e"}, "f": {"doc_id": "f"}}
    r = spark.sql("select 'text' t, array('h1', 'h2') h, array() n, map('a', 'b') c, array('x', null) i").select(X.context_prompt(F.col("t"), F.col("h")).alias("p"), X.context_prompt(F.col("t"), F.col("n").cast("array<string>")).alias("q"), X.batch_prompt(F.col("c"), F.col("i")).alias("b")).first()
    assert "h1\nh2" in r.p and "Mentions" not in r.q and "[0] x\n[1] " in r.b and '{"a":"b"}' in r.b
    days = spark.createDataFrame([("x", ["RequestsPerDay"]), ("x", ["PerMinute"]), ("tokens per day", None)], "m string, q array<string>")
    assert [r.d for r in days.select(daily_quota(F.col("m"), F.col("q")).alias("d")).collect()] == [True, False, True]


def test_table_facts(spark):
    said = [("d", 1, 0, 0, "S Ltd", "company", "Revenue", "numeric", [("consolidation", "wrong"), ("note", "n")], 0.9), ("d", 1, 0, 1, " ", None, "x", "numeric", None, 0.9), ("d", 1, 0, 9, "S", None, "x", "numeric", None, 0.9),
            ("e", 2, 0, 0, "T", None, "Margin", "numeric", None, 0.5)]
    s = spark.createDataFrame(said, "doc_id string, page_no int, batch_no int, cell_index int, subject_surface_form string, subject_type string, measure_surface_form string, fact_type string, qualifiers array<struct<key:string,value:string>>, confidence double")
    box = (1.0, 2.0, 3.0, 4.0)
    cells = spark.createDataFrame([("d", 1, 0, 0, 7, "(1,234)", "Consolidated 2023", box), ("d", 1, 0, 1, 7, "5", "", box), ("e", 2, 0, 0, 3, "4.5%", "FY22", box)], "doc_id string, page_no int, batch_no int, cell_index int, block_no int, value string, header string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    ctx = spark.createDataFrame([("d", "FY24", "INR", "crore")], "doc_id string, reporting_period string, currency string, scale string")
    got = {r.doc_id: r for r in X.to_table_facts(s, cells, ctx).collect()}
    d, e = got["d"], got["e"]
    assert len(got) == 2 and d.block_id == "d:p1:b7" and d.value_number == -1234 and (d.value_currency, d.value_scale, d.value_unit) == ("INR", "crore", None)
    assert d.qualifiers == {"column_header": "Consolidated 2023", "consolidation": "consolidated", "period_label": "FY23", "note": "n"} and d.evidence.table_ref == "p1" and d.evidence.quote == "(1,234)"
    assert (e.value_number, e.value_unit, e.value_currency) == (4.5, "%", None) and e.qualifiers == {"column_header": "FY22", "period_label": "FY22"}


def test_files_through_a_decoder(spark):
    def decoder(content):
        for n, text in enumerate(content.decode().split("\f"), 1):
            spans = [dict(block_no=b, line_no=i, span_no=k, text=w, x0=60.0 * k, y0=20.0 * b, x1=60.0 * k + 20, y1=20.0 * b + 9) for b, block in enumerate(text.split("\n\n")) for i, line in enumerate(block.split("\n")) for k, w in enumerate(line.split("|"))]
            yield dict(page_no=n, width=600.0, height=800.0, char_count=len(text), spans=spans, images=[], drawings=[dict(x0=0.0, y0=0.0, x1=600.0, y1=300.0)] if "slide" in text else [])

    text = "A first line of some length |that runs on\nand a second line of the block\n\nshort\n\n1|2|3\fa slide with only these few words on it, no more"
    files = spark.createDataFrame([("/in/some.report.PDF", bytearray(text.encode()))], "path string, content binary")
    pages = X.decode_pages(files, decoder)
    got = {(r.page_no, r.block_no): (r.doc_id, r.text, r.page_type) for r in X.page_blocks(pages).collect()}
    assert got == {(1, 0): ("some.report", "A first line of some length that runs on and a second line of the block", "table"), (2, 0): ("some.report", "a slide with only these few words on it, no more", "slide")}


def test_pixels_and_a_long_fold(spark):
    r = spark.sql("select struct(1d as x0, 2d as y0, 3d as x1, 4d as y1) b").select(layout.to_pixels(F.col("b"), F.lit(10.0), F.lit(0.0), F.lit(100.0), F.lit(50.0)).alias("p")).first().p
    assert (r.x0, r.x1, r.y0) == (10.0, 30.0, None)
    items = spark.range(30_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("i"), (F.col("id") % 7 + 1).cast("int").alias("c")).repartition(5)
    got = [r.batch_no for r in layout.greedy_batches(items, ["doc_id"], ["i"], F.col("c"), 20, 4).orderBy("i").collect()]
    batch, total, n, want = 0, 0, 0, []
    for i in range(30_000):
        c = i % 7 + 1
        if n and (total + c > 20 or n >= 4):
            batch, total, n = batch + 1, 0, 0
        total, n = total + c, n + 1
        want.append(batch)
    assert got == want
    cells = spark.createDataFrame([("d", 1, r, "l" * 100, "5", float(x), "h") for r in range(12) for x in (10, 20)], "doc_id string, page_no int, row_no int, label string, value string, x0 double, header string")
    b = layout.cell_batches(cells, 3500, 20).orderBy("row_no", "x0").collect()
    assert [x.batch_no for x in b] == [0] * 20 + [1] * 4 and [x.cell_index for x in b] == [*range(20), *range(4)]
