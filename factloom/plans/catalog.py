"""The queries of the core operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, units_graph
from ..sources.tables import table
from ..streaming.intervals import gaps_through_state
from . import ledger_queries

Query = Callable[[SparkSession, str], DataFrame]


_QUANTITY = ("id", "doc_id", "block_id", "claim_key", "fact_type", "value_raw", "value_number", "value_unit", "value_currency", "value_scale", "evidence.quote", "evidence.char_start", "evidence.char_end")


def _quantities(spark: SparkSession, root: str) -> DataFrame:
    return units_graph.to_common_units(table(spark, root, "facts").select(*_QUANTITY), table(spark, root, "blocks"), table(spark, root, "unit_list"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _quantities(spark, root).select("id", "common_unit", F.round("common_value", 0).cast("bigint").alias("common_value"))


def p3_paths(spark: SparkSession, root: str) -> DataFrame:
    """How many quantities were named where, and by what their unit was solved."""
    return _quantities(spark, root).groupBy("named_in", "solved_by").agg(F.count("*").alias("facts"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return gaps_through_state(table(spark, root, "facts"), "loose_key", "validity_start", "validity_end")


def p5_periods(spark: SparkSession, root: str) -> DataFrame:
    return intervals.periods(table(spark, root, "facts"), "loose_key", "validity_start", "validity_end")


_ISLANDS = """
    WITH v AS (
        SELECT DISTINCT loose_key, coalesce(validity_start, '-infinity'::DATE) AS s, coalesce(validity_end, 'infinity'::DATE) AS e
        FROM facts
        WHERE loose_key IS NOT NULL AND (validity_start IS NOT NULL OR validity_end IS NOT NULL)
          AND coalesce(validity_start, '-infinity'::DATE) < coalesce(validity_end, 'infinity'::DATE)
    ), m AS (
        SELECT *, max(e) OVER (PARTITION BY loose_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v
    )
"""


def queries() -> dict[str, Query]:
    qs = [p3_found, p3_paths, p5_found, p5_periods]
    return ledger_queries.QUERIES | {q.__name__: q for q in qs}


def oracle_sql() -> dict[str, str]:
    return ledger_queries.SQL | {
        "p5_found": _ISLANDS
        + "SELECT loose_key, strftime(reach, '%Y-%m-%d') AS gap_start, strftime(s, '%Y-%m-%d') AS gap_end FROM m WHERE reach < s",
        "p5_periods": _ISLANDS
        + """, g AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY loose_key ORDER BY s, e) AS n FROM m)
            SELECT loose_key, nullif(min(s), '-infinity'::DATE) AS period_start, nullif(max(e), 'infinity'::DATE) AS period_end
            FROM g GROUP BY loose_key, n""",
    }
