"""Types of the ledger's tables and the closed vocabularies of its verdicts."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])

EVIDENCE = T.StructType(
    [
        T.StructField("page_no", T.IntegerType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
        T.StructField("bbox", T.ArrayType(BBOX)),
        T.StructField("quote", T.StringType()),
        T.StructField("section_path", T.ArrayType(T.StringType())),
        T.StructField("table_ref", T.StringType()),
    ]
)

PROVENANCE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("extracted_at", T.TimestampType()),
        T.StructField("parser", T.StringType()),
    ]
)


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


FACTS = T.StructType(
    _strings(
        "id", "doc_id", "block_id", "subject_canonical_id", "subject_surface_form", "subject_type",
        "measure_canonical_id", "measure_surface_form", "fact_type", "value_raw",
    )
    + [T.StructField("value_number", T.DoubleType())]
    + _strings("value_unit", "value_currency", "value_scale", "value_direction")
    + [
        T.StructField("qualifiers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("validity_start", T.DateType()),
        T.StructField("validity_end", T.DateType()),
        T.StructField("evidence", EVIDENCE),
        T.StructField("confidence_extraction", T.DoubleType()),
        T.StructField("confidence_normalization", T.DoubleType()),
        T.StructField("provenance", PROVENANCE),
    ]
    + _strings("claim_key", "loose_key")
)

BLOCKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("block_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("page_type", T.StringType()),
    ]
)

DELTA = T.StructType(
    [
        T.StructField("absolute", T.DoubleType()),
        T.StructField("relative", T.DoubleType()),
        T.StructField("after_normalization", T.BooleanType()),
    ]
)

RELATIONS = T.StructType(
    _strings("id", "fact_a_id", "fact_b_id", "type", "reason_code", "explanation")
    + [T.StructField("explanation_pending", T.BooleanType())]
    + _strings("caveat")
    + [T.StructField("delta", DELTA), T.StructField("confidence", T.DoubleType())]
    + _strings("adjudicator")
)

#: The closed vocabularies, as stored.
RELATION_TYPES = ["CORROBORATES", "CONTRADICTS", "SUPERSEDES", "RECONCILED_BY_CONTEXT", "REFINES"]
REASON_CODES = [
    "VALUES_MATCH", "SCALE_NORMALIZED", "SCALE_MISMATCH", "UNIT_MISMATCH", "PERIOD_DISJOINT",
    "PERIOD_BASIS_MISMATCH", "SCOPE_MISMATCH", "GEOGRAPHY_MISMATCH", "MODALITY_MISMATCH",
    "VINTAGE_RESTATEMENT", "VALUES_DIVERGE", "UNRESOLVED", "TEMPORAL_STATE_CHANGE", "ROUNDING_ARTIFACT",
]
FACT_TYPES = ["numeric", "temporal", "categorical", "relational", "assertion"]
