import random

import pytest

from factloom.llm import components, measures, names

LIST = [
    ("revenue_from_operations", "Revenue from operations", "money", ["Operating revenue"]), ("profit_before_tax", "Profit before tax", "money", ["PBT"]), ("profit_after_tax", "Profit after tax", "money", None),
    ("trade_receivables", "Trade receivables", "money", ["Debtors"]), ("employee_benefits_expense", "Employee benefits expense", "money", []), ("long_term_borrowings", "Long-term borrowings", "money", []),
]


def test_wordings(spark):
    want = {
        "REVENUE FROM OPERATIONS*": "revenue_from_operations", "from operations, Revenue (A+B)": "revenue_from_operations", "Reported Reveneu from ops (note 14)": "revenue_from_operations", "Turnover": "revenue_from_operations",
        "pbt - group": "profit_before_tax", "Рrofіt after​ tax [2]": "profit_after_tax", "Profit_after_ta...": "profit_after_tax", "Sundry debtors": "trade_receivables", "Emp. Benefits Exp.": "employee_benefits_expense",
        "of which Long-term borr. for the year": "long_term_borrowings", "Fire drill tokens handed out": "none", "": "none", "...": "none",
    }
    facts = spark.createDataFrame([(str(i), f) for i, f in enumerate(want)] + [("x", "Trade receivables"), ("y", None), (None, "pbt"), ("0", next(iter(want)))], "id string, measure_surface_form string")
    ml = spark.createDataFrame(LIST, "measure_id string, label string, dimension string, also_known_as array<string>")
    got = {r.id: r.measure_id for r in measures.free_wordings(facts, ml).collect()}
    assert got == {str(i): m for i, m in enumerate(want.values())}
    every = {r.id: r.measure_id for r in measures.map_measures(facts, ml).collect()}
    assert every["x"] == "trade_receivables" and every["y"] == "none"
    assert measures.free_wordings(facts.limit(0), ml).count() == 0


def test_prefix_join_against_brute_force(spark):
    rng = random.Random(7)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf"]
    entries = [(f"e{i}", " ".join(rng.sample(words, 3))) for i in range(8)]
    forms = sorted({"".join(c for c in rng.choice(entries)[1] if rng.random() > 0.12) for _ in range(60)} - {""})
    grams = lambda s: {f" {w} "[i : i + 3] for w in s.split() for i in range(len(w))}
    want = {}
    for f in forms:
        f2 = " ".join(f.split())
        s = [(len(grams(f2) & grams(l)) / len(grams(f2) | grams(l)), e) for e, l in entries]
        best = max(x for x, _ in s)
        if best >= 0.5:
            want[f] = (round(best, 9), min(e for x, e in s if x == best))
    got = measures.closest(spark.createDataFrame([(f,) for f in forms], "form string"), spark.createDataFrame(entries, "entry string, label string"), 0.5)
    assert {r.form: (round(r.similarity, 9), r.entry) for r in got.collect()} == want


def test_rewritings():
    r = lambda form: names.rewrite(form, None, {"chems": "chemicals", "chem": "chemicals"})
    assert r("Dr. Liz Gizomoduvo")[1] == r("GIZOMODUVO ELIZABETH")[1] == r("Gizomoduvo, Beth")[1] == "p|elizabeth gizomoduvo"
    assert r("E. Gizomoduvo")[1] in r("Elizabeth Gizomoduvo")[2] and r("E. Gizomoduvo")[0] == "person?"
    assert r("KofanaMeya Chems Limited")[1] == r("Chem. (P) Ltd., Kofana Meya")[1] == r("M/s Kofana-Meya Chemicals L.L.P.")[1] == "o|kofanameya|chemicals"
    assert r("Kofana Meya Pvt. Ltd.")[:2] == ("organisation?", "o|kofanameya|")
    assert r("the Company") is None and r("our company") is None
    assert names.within_one("abcd", "abdc") and names.within_one("abcd", "abd") and names.within_one("abcd", "abxd") and not names.within_one("abcd", "badc")


def test_shortened_trade_words_are_learnt(spark):
    """No list says what "frwys" or "txtls" stand for: two brands that use it beside the full word do, also for a third
    whose own name is misspelt; a word that one brand alone has links that brand's own names only."""
    assert names.shortens("tpt", "transport") and names.shortens("mfg", "manufacturing") and not names.shortens("ptt", "transport") and not names.shortens("t", "transport") and not names.shortens("rans", "transport")
    groups = [
        ["Bolari Fenu Freightways Ltd", "Bolari Fenu Frwys"], ["Kesimo Freightways", "Kesimo Frwys Limited"], ["Dorvane Lute Freightways Limited", "Dorvaen Lute Frwys"],
        ["Zanopi Textiles", "Zanopi Txtls"], ["Zanopi Transport", "Zanopi Trspt Ltd"], ["Zanopi Tls"],
    ]
    rows = [(f, "organisation") for g in groups for f in g for _ in range(3 if f == g[0] else 1)]
    got = {tuple(r) for r in names.spelling_pairs(spark.createDataFrame(rows, "subject_surface_form string, subject_type string")).collect()}
    assert got == {(a, b) for g in groups[:5] for a in g for b in g if a < b} | {tuple(sorted(("Zanopi Textiles", "Zanopi Tls"))), tuple(sorted(("Zanopi Txtls", "Zanopi Tls")))}


def test_subject_pairs(spark):
    groups = [
        ["Gumechu Pelu Chemicals LLP", "GUMECHU PELU CHEM. L.L.P.", "Chemicals LLP, Gumechu Pelu", "Gumehcu Pelu Chemicals LLP", "GumechuPelu Chems"],
        ["Gumechu Pelu Industries LLP", "Gumechu Pelu Inds."],
        ["Dorvane Freightways Limited", "Dorvane Frtways Ltd.", "Dοrvane Ltd", "dorvane freightways"],
        ["Theodore Femimifene", "Ted Femimifene", "T. Femimifene", "Femimifene, Theo", "Teodore Femimifene"],
        ["Robert Femimifene"],
        ["Ravi Kumar Mohan Lal Das Gupta", "R. K. M. L. D. Gupta", "Gupta, Ravi K. Mohan L. D."], ["Ravi Kumar Mohan Lal Das Gadgil"],
        ["Patricia Nicholas Nurutuzushu", "Nurutuzushu Patricia", "Pat N. Nurutuzushu"],
    ]
    assert names.abbreviates(["g", "g", "gupta"], ["gupta", "gopal", "gita"]) and not names.abbreviates(["g", "h"], ["gita", "gupta"]) and not names.abbreviates(["g"], ["gita", "gupta"])
    rows = [(f, "organisation" if i < 3 else "person") for i, g in enumerate(groups) for f in g] + [(g[0], None) for g in groups for _ in range(3)]
    rows += [("the Company", None), ("your Company", "organisation"), (None, None), ("", None), ("Gumechu Pelu LLP", "organisation"), ("​", None)]
    df = spark.createDataFrame(rows, "subject_surface_form string, subject_type string")
    got = {tuple(r) for r in names.spelling_pairs(df).collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}
    assert names.spelling_pairs(df.limit(0)).count() == 0


def brute_groups(pairs):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = f(a), f(b)
        if a != b:
            p[max(a, b)] = min(a, b)
    return {x: f(x) for x in p}


@pytest.mark.parametrize("seed", [0, 1])
def test_groups(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"x{rng.randrange(80):03}", f"x{rng.randrange(80):03}") for _ in range(50)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("hub", f"l{i}") for i in range(120)] + [("s", "s")]
    df = spark.createDataFrame(pairs + pairs[:5] + [(b, a) for a, b in pairs[:9]] + [(None, "q"), ("q", None)], "a string, b string")
    got = components.groups(df, "a", "b").collect()
    assert {r.vertex: r.group_id for r in got} == brute_groups(pairs) and len(got) == len(brute_groups(pairs))


def test_no_groups(spark):
    df = spark.createDataFrame([("a", "a")], "a string, b string")
    assert [tuple(r) for r in components.groups(df, "a", "b").collect()] == [("a", "a")]
    assert components.groups(df.limit(0), "a", "b").count() == 0
