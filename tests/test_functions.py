from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import keys, names, periods, text, units


def run(spark, values, schema, **cols):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return df.select("*", *[c.alias(n) for n, c in cols.items()]).collect()


def test_values(spark):
    want = {
        "₹81,415.38 million": (81415.38, "million", "INR", 81415380000.0),
        "₹8,142 Cr": (8142, "crore", "INR", 81420000000.0),
        "5 lakh": (5, "lakh", None, 5e5),
        "10K": (10, "thousand", None, 1e4),
        "1.5bn": (1.5, "billion", None, 1.5e9),
        "8,142Cr": (8142, "crore", None, 81420000000.0),
        "6.5%": (6.5, "percent", None, 6.5),
        "6.5 per cent": (6.5, "percent", None, 6.5),
        "(1,679.68)": (-1679.68, None, None, -1679.68),
        "Rs 46 Cr": (46, "crore", "INR", 460000000.0),
        "1,600": (1600, None, None, 1600.0),
        "(-5)": (5, None, None, 5.0),
        "(452": (452, None, None, 452.0),
        "FY24 8,142": (24, None, None, 24.0),
        "no digits here": None,
        "Rs., 500": None,
        "": None,
        None: None,
    }
    for r in run(spark, list(want), "raw string", v=units.normalize_value(F.col("raw"))):
        got = r.v and (r.v.number, r.v.scale, r.v.currency, pytest.approx(r.v.base_value))
        assert got == want[r.raw], r.raw


def test_effective_value_takes_fields_where_text_is_silent(spark):
    rows = [("81.4", "Crore ", "inr"), ("81.4 million", "crore", "USD"), ("81.4", "heaps", None), (None, "crore", None)]
    got = [r.v and (r.v.scale, r.v.currency, round(r.v.base_value)) for r in run(spark, rows, "r string, s string, c string", v=units.effective_value(F.col("r"), F.col("s"), F.col("c")))]
    assert got == [("crore", "INR", 814000000), ("million", "USD", 81400000), ("heaps", None, 81), None]


def test_periods(spark):
    d = date
    want = {
        "FY24": (d(2023, 4, 1), d(2024, 3, 31), "FY_IN"),
        "FY2023-24": (d(2023, 4, 1), d(2024, 3, 31), "FY_IN"),
        "FY2024/25": (d(2024, 4, 1), d(2025, 3, 31), "FY_IN"),
        "2024-25": (d(2024, 4, 1), d(2025, 3, 31), "FY_IN"),
        "Q4 FY24": (d(2024, 1, 1), d(2024, 3, 31), "QUARTER"),
        "Q1 FY2025/26": (d(2025, 4, 1), d(2025, 6, 30), "QUARTER"),
        "2025Q2": (d(2025, 4, 1), d(2025, 6, 30), "QUARTER"),
        "CY2024": (d(2024, 1, 1), d(2024, 12, 31), "CY"),
        "nine months ended December 31, 2021": (d(2021, 4, 1), d(2021, 12, 31), "FY_IN"),
        "three months ended March 31, 2024": (d(2024, 1, 1), d(2024, 3, 31), "CY"),
        "as of March 31, 2024": (d(2024, 3, 31), d(2024, 3, 31), "FY_IN"),
        "grew 6.5 percent in FY2024/25": (d(2024, 4, 1), d(2025, 3, 31), "FY_IN"),
        "in the first quarter of FY2025/26": (d(2025, 4, 1), d(2025, 6, 30), "QUARTER"),
        "first quarter of FY26": (d(2025, 4, 1), d(2025, 6, 30), "QUARTER"),
        "Q1 2025-26": (d(2025, 1, 1), d(2025, 3, 31), "QUARTER"),
        "2024-03-31": (d(2024, 4, 1), d(2025, 3, 31), "FY_IN"),
        "FY97": (d(2096, 4, 1), d(2097, 3, 31), "FY_IN"),
        **dict.fromkeys(["sometime next quarter maybe", "FY2024", "FY2023-2024", "Q1 2025/26", "six months ended Foo 30, 2023", "as of Foo 1, 2020", "", None]),
    }
    for r in run(spark, list(want), "label string", p=periods.parse_period(F.col("label"))):
        assert (r.p and tuple(r.p)) == want[r.label], r.label


def test_fact_period_precedence(spark):
    rows = [
        ({"date": "2024-05-06", "period_label": "FY24"},),
        ({"date": "soon", "period_start": "2024-01-01", "period_end": "2024-02-01"},),
        ({"period_start": "2024-01-01", "period_label": "CY2020"},),
        ({},),
        (None,),
    ]
    got = [tuple(r.p) for r in run(spark, rows, "q map<string,string>", p=periods.fact_period(F.col("q")))]
    assert got == [(date(2024, 5, 6),) * 2, (date(2024, 1, 1), date(2024, 2, 1)), (date(2020, 1, 1), date(2020, 12, 31)), (None, None), (None, None)]


def test_entities_and_measures(spark):
    forms = ["Delhivery Limited", "DELHIVERY  ltd.", "Delhivery", "the Company", "Ms. Kalpana Jaisingh Morparia", "Vinculum Solutions Private Limited", "", None]
    got = [r.e for r in run(spark, forms, "f string", e=names.canonical_entity(F.col("f")))]
    assert got == ["delhivery_limited"] * 3 + ["unknown_self_reference", "kalpana_jaisingh_morparia", "vinculum_solutions_private", "unknown", None]
    own = [r.e for r in run(spark, ["your Company"], "f string", e=names.canonical_entity(F.col("f"), F.lit("Delhivery Ltd")))]
    assert own == ["delhivery_limited"]
    ms = ["Revenue for services (A)", "Revenue from Operations", "Net Debt", None]
    got = run(spark, ms, "f string", m=names.canonical_measure(F.col("f")), a=names.aliased_not_identical(F.col("f"), F.lit("revenue from operations")))
    assert [(r.m, r.a) for r in got] == [("revenue_from_operations", True), ("revenue_from_operations", False), ("net_debt", False), (None, False)]


def test_plain_text(spark):
    rows = ["Ｒｅvenue", "Рlant do​wn", "eﬃcient", "x¹ y²", "café – “q”", "", None]
    got = [r.p for r in run(spark, rows, "t string", p=text.plain(F.col("t")))]
    assert got == ["Revenue", "Plant down", "efficient", "x¹ y²", "café – “q”", "", None]


def fact(**kw):
    row = {"id": "f", "subject_surface_form": "Delhivery Limited", "measure_surface_form": "Revenue from Operations", "qualifiers": {"period_label": "FY24"}}
    return {**row, **kw}


FACT = "id string, subject_surface_form string, measure_surface_form string, qualifiers map<string,string>"


def test_claim_keys(spark):
    rows = [
        fact(id="a"),
        fact(id="b", subject_surface_form="Delhivery Ltd."),
        fact(id="c", qualifiers={"period_label": "FY24", "consolidation": "Standalone "}),
        fact(id="d", qualifiers={"period_label": "Q1 FY2025/26"}),
        fact(id="e", qualifiers={"period_label": "2025Q2"}),
        fact(id="g", measure_surface_form="Net Debt"),
        fact(id="h", qualifiers={"period_label": "FY24", "date": "2023-05-01"}),
        fact(id="i", qualifiers=None, subject_surface_form=None),
    ]
    k = {r.id: r for r in keys.with_keys(spark.createDataFrame(rows, FACT)).collect()}
    assert k["a"].claim_key == k["b"].claim_key != k["c"].claim_key
    assert k["a"].loose_key == k["c"].loose_key != k["g"].loose_key
    assert k["d"].claim_key == k["e"].claim_key != k["a"].claim_key != k["h"].claim_key
    assert len(k["i"].claim_key) == 64
