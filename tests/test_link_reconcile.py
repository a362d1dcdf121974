from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import keys
from factloom.operators import link, reconcile

SCHEMA = (
    "id string, doc_id string, subject_surface_form string, measure_surface_form string, fact_type string, value_raw string, value_scale string, "
    "value_currency string, qualifiers map<string,string>, validity_start date, validity_end date"
)


def fact(i, raw="100", label="FY24", subject="Delhivery Limited", measure="Revenue from Operations", kind="numeric", start=None, end=None, scale=None, currency=None, doc="d", **q):
    return (i, doc, subject, measure, kind, raw, scale, currency, {**({"period_label": label} if label else {}), **q}, start, end)


def keyed(spark, rows):
    return keys.with_keys(spark.createDataFrame(rows, SCHEMA))


CASES = [
    (fact("a", "₹81,415.38 million", consolidation="consolidated"), fact("b", "₹8,142 Cr", consolidation="Consolidated"), "CORROBORATES", "ROUNDING_ARTIFACT"),
    (fact("a", "72,250 mn", "FY23"), fact("b", "7,225 Cr", "FY23"), "CORROBORATES", "SCALE_NORMALIZED"),
    (fact("a", "74,540.82", consolidation="standalone"), fact("b", "81,415.38", consolidation="consolidated"), "RECONCILED_BY_CONTEXT", "SCOPE_MISMATCH"),
    (fact("a", "7.8%", "Q1 FY2025/26"), fact("b", "7.8%", "2025Q2"), "CORROBORATES", "VALUES_MATCH"),
    (fact("a", "6.5%", "FY24"), fact("b", "6.5%", "FY25"), "RECONCILED_BY_CONTEXT", "PERIOD_DISJOINT"),
    (fact("a", "6.5%", "FY24"), fact("b", "6.5%", "CY2023"), "RECONCILED_BY_CONTEXT", "PERIOD_BASIS_MISMATCH"),
    (fact("a", geography="India"), fact("b", geography="global"), "RECONCILED_BY_CONTEXT", "GEOGRAPHY_MISMATCH"),
    (fact("a", geography="India"), fact("b"), "RECONCILED_BY_CONTEXT", "GEOGRAPHY_MISMATCH"),
    (fact("a", "6.4%", modality="first advance estimate"), fact("b", "6.5%", modality="actual"), "RECONCILED_BY_CONTEXT", "VINTAGE_RESTATEMENT"),
    (fact("a", "$100 million"), fact("b", "₹100 million"), "RECONCILED_BY_CONTEXT", "UNIT_MISMATCH"),
    (fact("a", "₹100 million"), fact("b", "₹150 million"), "CONTRADICTS", "VALUES_DIVERGE"),
    (fact("a", "Active", kind="categorical"), fact("b", "Resigned", kind="categorical"), "CONTRADICTS", "VALUES_DIVERGE"),
    (fact("a", "Active ", kind="categorical"), fact("b", "active", kind="categorical"), "CORROBORATES", "VALUES_MATCH"),
    (fact("a"), fact("b", subject="Falcon Autotech"), "RECONCILED_BY_CONTEXT", "UNRESOLVED"),
    (fact("a", label="sometime"), fact("b"), "RECONCILED_BY_CONTEXT", "UNRESOLVED"),
    (fact("a", "n.a."), fact("b"), "RECONCILED_BY_CONTEXT", "UNRESOLVED"),
    (fact("a", "5", consolidation="standalone"), fact("b", "5"), "CORROBORATES", "VALUES_MATCH"),
    (fact("a", "6.5%"), fact("b", "6.5"), "CORROBORATES", "SCALE_NORMALIZED"),
    (fact("a", "x", kind="assertion", start=date(2022, 1, 1), end=date(2023, 2, 11)), fact("b", "y", kind="assertion", start=date(2023, 2, 11)), "SUPERSEDES", "TEMPORAL_STATE_CHANGE"),
    (fact("a", "x", kind="assertion", start=date(2022, 1, 1), end=date(2023, 2, 11)), fact("b", "X", kind="assertion", start=date(2023, 2, 11)), "CORROBORATES", "VALUES_MATCH"),
    (fact("a", "5"), fact("b", "5", measure="Revenue for services"), "CORROBORATES", "SCALE_NORMALIZED"),
    (fact("a", None), fact("b", "5"), "RECONCILED_BY_CONTEXT", "UNRESOLVED"),
]


def test_verdicts_and_symmetry(spark):
    rows = []
    for n, (a, b, *_) in enumerate(CASES):
        rows += [(f"{n:02}a", *a[1:]), (f"{n:02}b", *b[1:])]
    f = keyed(spark, rows).select(F.substring("id", 1, 2).alias("n"), F.substring("id", 3, 1).alias("side"), F.struct(*reconcile.SIDE).alias("x"))
    a, b = (f.filter(f.side == s).select("n", F.col("x").alias(s)) for s in "ab")
    pairs = a.join(b, "n")
    out = {int(r.n): r for r in reconcile.reconcile(pairs).collect()}
    back = {int(r.n): r for r in reconcile.reconcile(pairs.select("n", F.col("a").alias("b"), F.col("b").alias("a"))).collect()}
    for n, (_, _, kind, reason) in enumerate(CASES):
        assert (out[n].type, out[n].reason_code) == (kind, reason), CASES[n]
        assert (back[n].type, back[n].reason_code) == (kind, reason), CASES[n]
        assert out[n].explanation
    assert out[0].delta.relative == pytest.approx(5.67e-5, rel=1e-2) and out[0].delta.after_normalization
    assert out[0].delta.absolute == -back[0].delta.absolute
    assert out[20].caveat and out[20].confidence == 1.0 and out[0].caveat is None
    assert out[9].delta is None


def test_group_cap_and_leak(spark):
    rows = [fact(f"{i:03}") for i in range(60)] + [fact("x", label="FY23"), fact("y", subject="Other")]
    f = keyed(spark, rows)
    got = link.find_candidates(f, ["doc_id", "id"], ["doc_id"]).groupBy("match_level").count().collect()
    assert {r.match_level: r["count"] for r in got} == {"exact": 1225}
    small = link.find_candidates(keyed(spark, rows[:20] + rows[60:]), ["doc_id", "id"], ["doc_id"], 5)
    assert small.filter("match_level = 'exact'").count() == 10
    leaky = link.candidates_for_facts(f, ["doc_id", "id"], ["doc_id"]).filter("id = '000'").groupBy("match_level").count().collect()
    assert {r.match_level: r["count"] for r in leaky} == {"exact": 50, "loose": 10}
    strict = link.candidates_for_facts(f, ["doc_id", "id"], ["doc_id"], leaky_truncation=False).filter("id = '000'").groupBy("match_level").count().collect()
    assert {r.match_level: r["count"] for r in strict} == {"exact": 50, "loose": 1}


def test_strict_loose_peers_beyond_a_hot_claim_key(spark):
    rows = [fact(f"a{i:03}") for i in range(130)] + [fact(f"b{i:03}", label="FY23") for i in range(70)] + [fact("c000", label="FY22")]
    f = keyed(spark, rows)
    got = {}
    for r in link.candidates_for_facts(f, ["doc_id", "id"], ["doc_id"], leaky_truncation=False).filter("match_level = 'loose'").collect():
        got.setdefault(r.id, set()).add(r.other_id)
    key = {r.id: r.claim_key for r in f.collect()}
    assert got == {i: set(sorted(j for j in key if key[j] != key[i])[:50]) for i in key}


def test_group_limit_is_partial_and_no_cartesian(spark):
    f = keyed(spark, [fact("a"), fact("b")])
    plan = link.find_candidates(f, ["doc_id", "id"], ["doc_id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pairs_dedup_and_anti(spark):
    pairs = spark.createDataFrame([("a", "b", "loose"), ("b", "a", "exact"), ("c", "c", "exact"), ("a", "d", "loose"), (None, "d", "loose")], "id string, other_id string, match_level string")
    u = link.unordered_pairs(pairs)
    assert {tuple(r) for r in u.collect()} == {("a", "b", "exact"), ("a", "d", "loose")}
    rel = spark.createDataFrame([("d", "a")], "fact_a_id string, fact_b_id string")
    assert [tuple(r) for r in link.without_related(u, rel).collect()] == [("a", "b", "exact")]


def test_empty(spark):
    f = keyed(spark, [fact("a")]).limit(0)
    assert reconcile.reconcile(link.find_candidates(f, ["doc_id", "id"], reconcile.SIDE)).count() == 0
