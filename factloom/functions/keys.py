"""Hashed claim keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import canonical_entity, canonical_measure
from .periods import fact_period
from .text import qualifier


def _hash(*parts: Column) -> Column:
    """sha256 over the parts in place; an absent part is an empty string, so positions hold."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def with_claim_components(facts: DataFrame, doc_subject: Column | None = None) -> DataFrame:
    """Adds subject_id, measure_key, period_start, period_end, consolidation, geography, modality."""
    period = fact_period(F.col("qualifiers"))
    return facts.withColumns(
        {
            "subject_id": canonical_entity(F.col("subject_surface_form"), doc_subject),
            "measure_key": canonical_measure(F.col("measure_surface_form")),
            "period": period,
            "consolidation": qualifier(F.col("qualifiers")["consolidation"]),
            "geography": qualifier(F.col("qualifiers")["geography"]),
            "modality": qualifier(F.col("qualifiers")["modality"]),
        }
    ).withColumns({"period_start": F.col("period.start"), "period_end": F.col("period.end")}).drop("period")


def with_keys(facts: DataFrame, doc_subject: Column | None = None) -> DataFrame:
    """Adds the components and both keys; stored keys of the same name are replaced."""
    df = with_claim_components(facts.drop("claim_key", "loose_key"), doc_subject)
    c = [F.col(x) for x in ("subject_id", "measure_key", "period_start", "period_end", "consolidation", "geography")]
    return df.withColumns({"claim_key": _hash(*c), "loose_key": _hash(*c[:2])})


def fact_id(doc_id: Column, block_id: Column, subject_id: Column, measure_id: Column, raw: Column, start: Column, end: Column) -> Column:
    """Content id of a grounded fact: the same claim at the same place always gets the same id."""
    return _hash(doc_id, block_id, subject_id, measure_id, raw, start, end)


def pair_id(a: Column, b: Column, *extras: Column) -> Column:
    """Order-free id of a pair of facts."""
    return _hash(F.least(a, b), F.greatest(a, b), *extras)
