"""The typed verdict of a pair of facts: one CASE over context, period, modality and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import aliased_not_identical
from ..functions.periods import intervals_overlap, period_relation
from ..functions.units import effective_value, lookup

EXACT, ROUNDING = 1e-6, 1e-3
#: Markers of an estimate, confidence per reason.
ESTIMATES = ["estimate", "advance", "provisional", "projected", "forecast"]
CONFIDENCE = {
    "VALUES_MATCH": 1.0, "SCALE_NORMALIZED": 0.97, "ROUNDING_ARTIFACT": 0.9, "SCOPE_MISMATCH": 0.9,
    "GEOGRAPHY_MISMATCH": 0.85, "PERIOD_DISJOINT": 0.9, "PERIOD_BASIS_MISMATCH": 0.75, "VINTAGE_RESTATEMENT": 0.85,
    "UNIT_MISMATCH": 0.85, "TEMPORAL_STATE_CHANGE": 0.9, "VALUES_DIVERGE": 0.9, "UNRESOLVED": 0.2,
}
#: What a side of a pair must carry.
SIDE = [
    "id", "doc_id", "subject_id", "measure_key", "measure_surface_form", "fact_type", "value_raw", "value_scale", "value_currency",
    "validity_start", "validity_end", "period_start", "period_end", "consolidation", "geography", "modality",
]


def _verdict(kind: str, reason: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(reason).alias("reason_code"), text.alias("explanation"))


def _show(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("unstated"))


def reconcile(pairs: DataFrame) -> DataFrame:
    """Adds type, reason_code, explanation, caveat, delta, confidence, adjudicator to ``pairs(a, b)``.

    ``a`` and ``b`` are structs with the columns of ``SIDE``; the delta is a minus b. Silence on the
    consolidation basis is no mismatch, silence on geography is. Raw texts that are null are equal
    only to null. An unparseable value or period gives UNRESOLVED.
    """
    a, b = F.col("a"), F.col("b")
    pairs = pairs.withColumns(
        {
            "_va": effective_value(a["value_raw"], a["value_scale"], a["value_currency"]),
            "_vb": effective_value(b["value_raw"], b["value_scale"], b["value_currency"]),
            "_period": period_relation(a["period_start"], a["period_end"], b["period_start"], b["period_end"]),
        }
    )
    va, vb, period = F.col("_va"), F.col("_vb"), F.col("_period")
    gap = va["base_value"] - vb["base_value"]
    relative = F.abs(gap) / F.greatest(F.abs(va["base_value"]), F.abs(vb["base_value"]), F.lit(1e-9))
    rescaled = ~(va["scale"].eqNullSafe(vb["scale"]) & va["currency"].eqNullSafe(vb["currency"]))
    raw = lambda s: F.lower(F.trim(s["value_raw"]))
    same_raw = raw(a).eqNullSafe(raw(b))
    is_estimate = lambda s: F.coalesce(s["modality"].rlike("|".join(ESTIMATES)), F.lit(False))
    context = lambda reason, text: _verdict("RECONCILED_BY_CONTEXT", reason, text)
    numbers = lambda: F.format_string("%,.2f against %,.2f", va["base_value"], vb["base_value"])
    overlap = intervals_overlap(a["validity_start"], a["validity_end"], b["validity_start"], b["validity_end"])
    numeric = (a["fact_type"] == "numeric") & (b["fact_type"] == "numeric")
    has_delta = va.isNotNull() & vb.isNotNull() & numeric

    verdict = (
        F.when(
            ~(a["subject_id"].eqNullSafe(b["subject_id"]) & a["measure_key"].eqNullSafe(b["measure_key"])),
            context("UNRESOLVED", F.lit("The facts are about different subjects or measures.")),
        )
        .when(
            ~overlap & ~same_raw,
            _verdict("SUPERSEDES", "TEMPORAL_STATE_CHANGE", F.concat_ws("", F.lit("The value changed between periods of validity: "), _show(a["value_raw"]), F.lit(", then or before "), _show(b["value_raw"]), F.lit("."))),
        )
        .when(
            a["consolidation"] != b["consolidation"],
            context("SCOPE_MISMATCH", F.concat_ws("", F.lit("Consolidation differs: "), a["consolidation"], F.lit(" against "), b["consolidation"], F.lit("."))),
        )
        .when(
            ~a["geography"].eqNullSafe(b["geography"]),
            context("GEOGRAPHY_MISMATCH", F.concat_ws("", F.lit("Geography differs: "), _show(a["geography"]), F.lit(" against "), _show(b["geography"]), F.lit("."))),
        )
        .when(period == "disjoint", context("PERIOD_DISJOINT", F.lit("The periods have no day in common.")))
        .when(period == "overlap", context("PERIOD_BASIS_MISMATCH", F.lit("The periods overlap and are not the same.")))
        .when(
            ~a["modality"].eqNullSafe(b["modality"]) & (is_estimate(a) | is_estimate(b)),
            context("VINTAGE_RESTATEMENT", F.concat_ws("", F.lit("An estimate and a later vintage: "), _show(a["modality"]), F.lit(" against "), _show(b["modality"]), F.lit("."))),
        )
        .when(period.isNull(), context("UNRESOLVED", F.lit("The period of a fact could not be resolved.")))
        .when(~F.coalesce(numeric, F.lit(False)) & same_raw, _verdict("CORROBORATES", "VALUES_MATCH", F.lit("The stated values are the same.")))
        .when(~F.coalesce(numeric, F.lit(False)), _verdict("CONTRADICTS", "VALUES_DIVERGE", F.concat_ws("", F.lit("The stated values differ: "), _show(a["value_raw"]), F.lit(" against "), _show(b["value_raw"]), F.lit("."))))
        .when(va.isNull() | vb.isNull(), context("UNRESOLVED", F.lit("A value could not be read as a number.")))
        .when(va["currency"] != vb["currency"], context("UNIT_MISMATCH", F.concat_ws("", F.lit("Currencies differ: "), va["currency"], F.lit(" against "), vb["currency"], F.lit("."))))
        .when((relative <= EXACT) & rescaled, _verdict("CORROBORATES", "SCALE_NORMALIZED", F.concat(numbers(), F.lit(", equal in one scale."))))
        .when(relative <= EXACT, _verdict("CORROBORATES", "VALUES_MATCH", F.concat(numbers(), F.lit(", equal."))))
        .when(relative <= ROUNDING, _verdict("CORROBORATES", "ROUNDING_ARTIFACT", F.concat(numbers(), F.lit(", apart by rounding."))))
        .otherwise(_verdict("CONTRADICTS", "VALUES_DIVERGE", F.concat(numbers(), F.lit(", apart beyond rounding."))))
    )
    pairs = pairs.withColumn("_v", verdict)
    v = F.col("_v")
    compared = (v["reason_code"].isin("VALUES_MATCH", "SCALE_NORMALIZED", "ROUNDING_ARTIFACT") | (v["type"] == "CONTRADICTS")) & has_delta
    aliased = (v["type"] == "CORROBORATES") & aliased_not_identical(a["measure_surface_form"], b["measure_surface_form"])
    return pairs.withColumns(
        {
            "type": v["type"],
            "reason_code": F.when(aliased, "SCALE_NORMALIZED").otherwise(v["reason_code"]),
            "explanation": v["explanation"],
            "caveat": F.when(
                aliased,
                F.concat_ws("", F.lit("The measures are worded differently and linked as aliases ("), a["measure_surface_form"], F.lit(" ~ "), b["measure_surface_form"], F.lit("); their definitions may differ.")),
            ),
            "delta": F.when(compared, F.struct(gap.alias("absolute"), relative.alias("relative"), rescaled.alias("after_normalization"))),
            "confidence": F.coalesce(lookup(CONFIDENCE, v["reason_code"]), F.lit(0.7)),
            "adjudicator": F.lit("rule"),
        }
    ).drop("_va", "_vb", "_period", "_v")


def needs_adjudication(type_: Column, reason: Column, fact_type_a: Column, fact_type_b: Column) -> Column:
    """Unresolved pairs of categorical, relational or assertion facts; numbers and times never."""
    kinds = ["categorical", "relational", "assertion"]
    return (type_ == "RECONCILED_BY_CONTEXT") & (reason == "UNRESOLVED") & fact_type_a.isin(kinds) & fact_type_b.isin(kinds)
