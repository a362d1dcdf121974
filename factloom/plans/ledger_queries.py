"""Queries of the ledger's own operators, over whole tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, names, periods, text, units
from ..operators import ground, layout, ledger, link, reconcile
from ..session import cut, shared_folder
from ..sources.tables import blocks, facts, table
from . import sqlx as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(q: Query) -> Query:
        QUERIES[q.__name__] = q
        if sql:
            SQL[q.__name__] = sql
        return q

    return add


#: Labels for the period grammar beyond those in the tables.
LABELS = [
    "FY24", "FY2023-24", "FY2024/25", "2024-25", "Q4 FY24", "Q1 FY2025/26", "2025Q2", "CY2024", "nine months ended December 31, 2021",
    "as of March 31, 2024", "sometime next quarter maybe", "growth was 6.5 per cent in 2024-25", "in the first quarter of FY2025/26", "first quarter of FY26",
    "FY2024", "FY2023-2024", "Q1 2025/26", "Q1 2025-26", "2024-03-31", "FY97", "six months ended Foo 30, 2023", "Q3 2022", "March 5 2023", "as of Foo 1, 2020",
    "12 months ended June 30, 2020", "third quarter of FY2021-22", "",
]
_LABELS_SQL = "(VALUES " + ", ".join(f"({S.lit(x)})" for x in LABELS) + ") AS l(label)"


@query(f"""SELECT DISTINCT value_raw, {S.number('value_raw')} AS number, {S.scale('value_raw')} AS scale, {S.currency('value_raw')} AS currency,
    ({S.number('value_raw')}) * {S.multiplier(f'({S.scale("value_raw")})')} AS base_value
    FROM facts WHERE value_raw IS NOT NULL AND ({S.number('value_raw')}) IS NOT NULL""")
def normalize_units(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "facts").select("value_raw").filter("value_raw is not null").distinct().withColumn("v", units.normalize_value(F.col("value_raw")))
    return v.filter("v is not null").select("value_raw", "v.number", "v.scale", "v.currency", "v.base_value")


_EFFECTIVE = f"""
    n AS (SELECT DISTINCT ON (id) id, value_raw, value_scale, value_currency FROM facts WHERE id IS NOT NULL),
    p AS (SELECT *, {S.number('value_raw')} AS number, {S.scale('value_raw')} AS ps, {S.currency('value_raw')} AS pc FROM n),
    ev AS (SELECT id, number, CASE WHEN ps IS NULL AND coalesce(value_scale, '') <> '' THEN lower(trim(value_scale)) ELSE ps END AS scale,
        coalesce(pc, nullif(upper(trim(value_currency)), '')) AS currency,
        number * CASE WHEN ps IS NULL AND coalesce(value_scale, '') <> '' THEN {S.multiplier('(' + S.case_map('lower(trim(value_scale))', units.SCALE_NAMES) + ')')} ELSE {S.multiplier('ps')} END AS base_value
        FROM p WHERE number IS NOT NULL)"""


@query(f"WITH {_EFFECTIVE} SELECT * FROM ev")
def effective_values(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "value_raw", "value_scale", "value_currency").filter("id is not null")
    v = f.select("id", units.effective_value(F.col("value_raw"), F.col("value_scale"), F.col("value_currency")).alias("v"))
    return v.filter("v is not null").select("id", "v.number", "v.scale", "v.currency", "v.base_value")


@query(f"SELECT subject_surface_form, {S.entity('subject_surface_form')} AS subject_id, count(*) AS n FROM facts GROUP BY 1")
def canonical_entities(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "facts").groupBy("subject_surface_form").agg(F.count("*").alias("n"))
    return f.withColumn("subject_id", names.canonical_entity(F.col("subject_surface_form")))


@query(f"""SELECT measure_surface_form, {S.measure('measure_surface_form')} AS measure_key, count(*) AS n,
    coalesce({S.alias_group('measure_surface_form')} = 'revenue_from_operations' AND {S.measure_key('measure_surface_form')} <> 'revenue from operations', false) AS aliased
    FROM facts GROUP BY 1""")
def canonical_measures(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "facts").groupBy("measure_surface_form").agg(F.count("*").alias("n"))
    m = F.col("measure_surface_form")
    return f.withColumns({"measure_key": names.canonical_measure(m), "aliased": names.aliased_not_identical(m, F.lit("Revenue from operations"))})


@query(f"""WITH l AS (SELECT label FROM {_LABELS_SQL} UNION SELECT DISTINCT qualifiers['period_label'] FROM facts WHERE qualifiers['period_label'] IS NOT NULL),
    p AS (SELECT label, {S.period('label')} AS p FROM l) SELECT label, p.s AS period_start, p.e AS period_end, p.b AS basis FROM p""")
def parse_periods(spark: SparkSession, root: str) -> DataFrame:
    seen = table(spark, root, "facts").select(F.col("qualifiers")["period_label"].alias("label")).filter("label is not null")
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string").union(seen).distinct()
    p = labels.withColumn("p", periods.parse_period(F.col("label")))
    return p.select("label", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.basis").alias("basis"))


@query(f"""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, 'FY' || year(o_orderdate)::VARCHAR || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS l FROM orders),
    p AS (SELECT o_orderkey, d, o_orderkey % 3 AS k, {S.period('l')} AS p FROM o)
    SELECT o_orderkey, CASE WHEN k = 0 THEN d::DATE ELSE p.s END AS period_start, CASE WHEN k = 0 THEN d::DATE ELSE p.e END AS period_end FROM p""")
def fact_period_precedence(spark: SparkSession, root: str) -> DataFrame:
    """Orders as claims: a third states its day, a third an unreadable day, the rest a fiscal year only."""
    o = table(spark, root, "orders")
    label = F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0"))
    k = F.col("o_orderkey") % 3
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.lit("n.d."))
    q = F.map_from_arrays(F.array(F.lit("date"), F.lit("period_label")), F.array(day, label))
    return o.withColumn("p", periods.fact_period(q)).select("o_orderkey", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


_KEY_COLUMNS = ("doc_id", "subject_surface_form", "measure_surface_form", "fact_type", "value_raw", "value_scale", "value_currency", "qualifiers", "validity_start", "validity_end")


def _keyed(spark: SparkSession, root: str) -> DataFrame:
    return keys.with_keys(facts(spark, root, *_KEY_COLUMNS).filter("id is not null"))


def _stored_keys(spark: SparkSession, root: str) -> DataFrame:
    """Facts with their keys as stored: worked out once, then read by every group and pairing."""
    return cut(_keyed(spark, root).select(*reconcile.SIDE, "claim_key", "loose_key"))


@query(f"WITH {S.facts_cte()} SELECT id, claim_key, loose_key FROM f")
def claim_keys(spark: SparkSession, root: str) -> DataFrame:
    return _keyed(spark, root).select("id", "claim_key", "loose_key")


_HEADS = """,
    he AS (SELECT *, row_number() OVER (PARTITION BY claim_key ORDER BY doc_id, id) AS re, row_number() OVER (PARTITION BY loose_key ORDER BY doc_id, id) AS rl FROM f),
    pairs AS (
        SELECT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, 'exact' AS match_level FROM he a JOIN he b ON a.claim_key = b.claim_key AND a.id < b.id WHERE a.re <= 50 AND b.re <= 50
        UNION ALL
        SELECT least(a.id, b.id), greatest(a.id, b.id), 'loose' FROM he a JOIN he b ON a.loose_key = b.loose_key AND a.id < b.id AND a.claim_key <> b.claim_key WHERE a.rl <= 50 AND b.rl <= 50
    )"""


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    return link.find_candidates(_stored_keys(spark, root), ["doc_id", "id"], reconcile.SIDE)


@query(f"WITH {S.facts_cte(_HEADS)} SELECT * FROM pairs")
def candidates_capped(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "match_level")


@query(f"WITH {S.facts_cte(_HEADS)} SELECT a_id, b_id FROM pairs WHERE match_level = 'exact'")
def candidates_exact(spark: SparkSession, root: str) -> DataFrame:
    return candidates_capped(spark, root).filter("match_level = 'exact'").select("a_id", "b_id")


@query(f"WITH {S.facts_cte(_HEADS)} SELECT a_id, b_id FROM pairs WHERE match_level = 'loose'")
def candidates_loose(spark: SparkSession, root: str) -> DataFrame:
    return candidates_capped(spark, root).filter("match_level = 'loose'").select("a_id", "b_id")


_PER_FACT = """,
    d AS (SELECT doc_id, min(ingested_at) AS at FROM filings GROUP BY doc_id),
    fd AS (SELECT f.*, d.at, row_number() OVER (ORDER BY d.at NULLS FIRST, f.doc_id, f.id) AS seq, dense_rank() OVER (ORDER BY d.at NULLS FIRST, f.doc_id) AS doc_seq FROM f LEFT JOIN d USING (doc_id)),
    ex AS (SELECT a.id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY b.seq) AS rn FROM fd a JOIN fd b ON a.claim_key = b.claim_key AND a.id <> b.id AND b.doc_seq <= a.doc_seq QUALIFY rn <= 50),
    lo AS (SELECT a.id, b.id AS other_id, a.claim_key = b.claim_key AS same, b.seq FROM fd a JOIN fd b ON a.loose_key = b.loose_key AND a.id <> b.id AND b.doc_seq <= a.doc_seq)"""


def _for_facts(spark: SparkSession, root: str, leaky: bool) -> DataFrame:
    at = table(spark, root, "filings").groupBy("doc_id").agg(F.min("ingested_at").alias("at"))
    f = _stored_keys(spark, root).select("id", "doc_id", "claim_key", "loose_key").join(at, "doc_id", "left").withColumn("at", F.coalesce("at", F.lit("1900-01-01").cast("timestamp")))
    return link.candidates_for_facts(f, ["at", "doc_id", "id"], ["at", "doc_id"], leaky_truncation=leaky)


@query(f"""WITH {S.facts_cte(_PER_FACT)},
    ln AS (SELECT lo.id, lo.other_id, row_number() OVER (PARTITION BY lo.id ORDER BY lo.seq) AS rn FROM lo WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.id = lo.id AND ex.other_id = lo.other_id) QUALIFY rn <= 50)
    SELECT id, other_id, 'exact' AS match_level FROM ex UNION ALL SELECT id, other_id, 'loose' FROM ln""")
def candidates_for_fact(spark: SparkSession, root: str) -> DataFrame:
    """Each fact's own candidates in order of ingestion; exact ones cut off by the limit return as loose."""
    return _for_facts(spark, root, True)


@query(f"""WITH {S.facts_cte(_PER_FACT)},
    ln AS (SELECT id, other_id, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM lo WHERE NOT same QUALIFY rn <= 50)
    SELECT id, other_id, 'exact' AS match_level FROM ex UNION ALL SELECT id, other_id, 'loose' FROM ln""")
def candidates_for_fact_strict(spark: SparkSession, root: str) -> DataFrame:
    return _for_facts(spark, root, False)


@query(f"""WITH {S.facts_cte(_HEADS)}, done AS (SELECT DISTINCT least(fact_a_id, fact_b_id) AS a, greatest(fact_a_id, fact_b_id) AS b FROM relations)
    SELECT p.* FROM pairs p LEFT JOIN done ON done.a = p.a_id AND done.b = p.b_id WHERE done.a IS NULL""")
def candidate_dedup_anti(spark: SparkSession, root: str) -> DataFrame:
    found = candidates_capped(spark, root)
    return link.without_related(link.unordered_pairs(found, "a_id", "b_id"), table(spark, root, "relations"))


_SIDE = "f.id, f.doc_id, subject_id, measure_key, measure_surface_form, fact_type, value_raw, validity_start, validity_end, period_start, period_end, consolidation, geography, modality, number, scale, currency, base_value"
_VERDICTS = f""", {_EFFECTIVE.strip()}, s AS (SELECT {_SIDE}, ev.id IS NOT NULL AS parsed FROM f LEFT JOIN ev ON ev.id = f.id),
    ab AS (SELECT p.*, a, b FROM pairs p JOIN s a ON a.id = p.a_id JOIN s b ON b.id = p.b_id),
    x AS (SELECT *, a.fact_type = 'numeric' AND b.fact_type = 'numeric' AS numeric,
        abs(a.base_value - b.base_value) / greatest(abs(a.base_value), abs(b.base_value), 1e-9) AS rel,
        a.scale IS DISTINCT FROM b.scale OR a.currency IS DISTINCT FROM b.currency AS rescaled,
        lower(trim(a.value_raw)) IS NOT DISTINCT FROM lower(trim(b.value_raw)) AS same_raw,
        coalesce(a.validity_start, DATE '0001-01-01') < coalesce(b.validity_end, DATE '9999-12-31') AND coalesce(b.validity_start, DATE '0001-01-01') < coalesce(a.validity_end, DATE '9999-12-31') AS overlap,
        CASE WHEN a.period_start IS NULL OR a.period_end IS NULL OR b.period_start IS NULL OR b.period_end IS NULL THEN NULL WHEN a.period_start = b.period_start AND a.period_end = b.period_end THEN 'equal'
            WHEN a.period_start <= b.period_end AND b.period_start <= a.period_end THEN 'overlap' ELSE 'disjoint' END AS period,
        coalesce(regexp_matches(a.modality, 'estimate|advance|provisional|projected|forecast'), false) OR coalesce(regexp_matches(b.modality, 'estimate|advance|provisional|projected|forecast'), false) AS estimated FROM ab),
    y AS (SELECT *, CASE
        WHEN a.subject_id IS DISTINCT FROM b.subject_id OR a.measure_key IS DISTINCT FROM b.measure_key THEN 'RECONCILED_BY_CONTEXT/UNRESOLVED'
        WHEN NOT overlap AND NOT same_raw THEN 'SUPERSEDES/TEMPORAL_STATE_CHANGE'
        WHEN a.consolidation <> b.consolidation THEN 'RECONCILED_BY_CONTEXT/SCOPE_MISMATCH'
        WHEN a.geography IS DISTINCT FROM b.geography THEN 'RECONCILED_BY_CONTEXT/GEOGRAPHY_MISMATCH'
        WHEN period = 'disjoint' THEN 'RECONCILED_BY_CONTEXT/PERIOD_DISJOINT'
        WHEN period = 'overlap' THEN 'RECONCILED_BY_CONTEXT/PERIOD_BASIS_MISMATCH'
        WHEN a.modality IS DISTINCT FROM b.modality AND estimated THEN 'RECONCILED_BY_CONTEXT/VINTAGE_RESTATEMENT'
        WHEN period IS NULL THEN 'RECONCILED_BY_CONTEXT/UNRESOLVED'
        WHEN NOT coalesce(numeric, false) AND same_raw THEN 'CORROBORATES/VALUES_MATCH'
        WHEN NOT coalesce(numeric, false) THEN 'CONTRADICTS/VALUES_DIVERGE'
        WHEN NOT a.parsed OR NOT b.parsed THEN 'RECONCILED_BY_CONTEXT/UNRESOLVED'
        WHEN a.currency <> b.currency THEN 'RECONCILED_BY_CONTEXT/UNIT_MISMATCH'
        WHEN rel <= 1e-6 AND rescaled THEN 'CORROBORATES/SCALE_NORMALIZED'
        WHEN rel <= 1e-6 THEN 'CORROBORATES/VALUES_MATCH'
        WHEN rel <= 1e-3 THEN 'CORROBORATES/ROUNDING_ARTIFACT'
        ELSE 'CONTRADICTS/VALUES_DIVERGE' END AS v FROM x),
    verdicts AS (SELECT a_id, b_id, match_level, a, b, split_part(v, '/', 1) AS type,
        CASE WHEN v LIKE 'CORROBORATES%' AND {S.measure_key('a.measure_surface_form')} <> {S.measure_key('b.measure_surface_form')} AND {S.alias_group('a.measure_surface_form')} = {S.alias_group('b.measure_surface_form')} THEN 'SCALE_NORMALIZED' ELSE split_part(v, '/', 2) END AS reason_code,
        {"CASE split_part(v, '/', 2) " + " ".join(f"WHEN {S.lit(k)} THEN {c}::DOUBLE" for k, c in reconcile.CONFIDENCE.items()) + " ELSE 0.7::DOUBLE END"} AS confidence,
        CASE WHEN numeric AND a.parsed AND b.parsed AND (v LIKE 'CORROBORATES%' OR v LIKE 'CONTRADICTS%') THEN a.base_value - b.base_value END AS delta_absolute,
        CASE WHEN numeric AND a.parsed AND b.parsed AND (v LIKE 'CORROBORATES%' OR v LIKE 'CONTRADICTS%') THEN rel END AS delta_relative, sha256(a_id || '|' || b_id) AS relation_id FROM y)"""


def _verdicts(spark: SparkSession, root: str) -> DataFrame:
    return reconcile.reconcile(_pairs(spark, root))


@query(f"WITH {S.facts_cte(_HEADS + _VERDICTS)} SELECT a_id, b_id, relation_id, match_level, type, reason_code, confidence, delta_absolute, round(delta_relative, 9) AS delta_relative FROM verdicts")
def reconcile_verdicts(spark: SparkSession, root: str) -> DataFrame:
    v = _verdicts(spark, root)
    a, b = F.col("a.id"), F.col("b.id")
    delta = (F.col("delta.absolute").alias("delta_absolute"), F.round("delta.relative", 9).alias("delta_relative"))
    return v.select(a.alias("a_id"), b.alias("b_id"), keys.pair_id(a, b).alias("relation_id"), "match_level", "type", "reason_code", "confidence", *delta)


@query(f"WITH {S.facts_cte(_HEADS + _VERDICTS)} SELECT type, reason_code, count(*) AS n FROM verdicts GROUP BY ROLLUP (type, reason_code)")
def reconcile_matrix(spark: SparkSession, root: str) -> DataFrame:
    return _verdicts(spark, root).rollup("type", "reason_code").agg(F.count("*").alias("n"))


@query(f"""WITH {S.facts_cte(_HEADS + _VERDICTS)} SELECT type, count(*) FILTER (match_level = 'exact') AS exact, count(*) FILTER (match_level = 'loose') AS loose FROM verdicts GROUP BY type""")
def verdicts_by_match_level(spark: SparkSession, root: str) -> DataFrame:
    p = _verdicts(spark, root).groupBy("type").pivot("match_level", ["exact", "loose"]).agg(F.count(F.lit(1)))
    return p.select("type", F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("loose", F.lit(0)).alias("loose"))


def _one_reason(reason: str) -> None:
    def q(spark: SparkSession, root: str) -> DataFrame:
        return _verdicts(spark, root).filter(F.col("reason_code") == reason).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "type")

    q.__name__ = "verdict_" + reason.lower()
    query(f"WITH {S.facts_cte(_HEADS + _VERDICTS)} SELECT a_id, b_id, type FROM verdicts WHERE reason_code = '{reason}'")(q)


for _r in ("TEMPORAL_STATE_CHANGE", "VINTAGE_RESTATEMENT", "SCOPE_MISMATCH", "GEOGRAPHY_MISMATCH", "UNIT_MISMATCH"):
    _one_reason(_r)


def _beside(copies: str) -> str:
    """The common part of the SQL over the facts and one restated copy of each."""
    base = "(SELECT DISTINCT ON (id) * FROM facts WHERE id IS NOT NULL)"
    every = f"(SELECT * FROM {base} UNION ALL SELECT * REPLACE (id || '~' AS id, {copies}) FROM {base} WHERE value_number IS NOT NULL)"
    return S.facts_cte(_HEADS + _VERDICTS).replace("FROM facts WHERE id IS NOT NULL", f"FROM {every} WHERE id IS NOT NULL")


def _restated(spark: SparkSession, root: str, **columns) -> DataFrame:
    """Verdicts over all facts and a copy of each with a number, in which these columns are restated."""
    f = facts(spark, root, *[c for c in _KEY_COLUMNS], "value_number").filter("id is not null")
    copies = f.filter("value_number is not null").withColumns({**columns, "id": F.concat("id", F.lit("~"))})
    k = keys.with_keys(f.unionByName(copies).drop("value_number")).select(*reconcile.SIDE, "claim_key", "loose_key")
    return reconcile.reconcile(link.find_candidates(cut(k), ["doc_id", "id"], reconcile.SIDE))


@query(f"""WITH {_beside("printf('%.6f', value_number * 1.0005) AS value_raw")} SELECT a_id, b_id, type, delta_absolute IS NULL AS no_delta FROM verdicts WHERE reason_code = 'ROUNDING_ARTIFACT'""")
def verdict_rounding_artifact(spark: SparkSession, root: str) -> DataFrame:
    """Facts beside copies that state their number half a thousandth larger."""
    v = _restated(spark, root, value_raw=F.format_string("%.6f", F.col("value_number") * 1.0005)).filter("reason_code = 'ROUNDING_ARTIFACT'")
    return v.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "type", F.col("delta.absolute").isNull().alias("no_delta"))


@query(f"""WITH {_beside("'categorical' AS fact_type, MAP {} AS qualifiers, 'state ' || id AS value_raw")} SELECT a_id, b_id FROM verdicts WHERE type = 'RECONCILED_BY_CONTEXT' AND reason_code = 'UNRESOLVED'
    AND a.fact_type IN ('categorical', 'relational', 'assertion') AND b.fact_type IN ('categorical', 'relational', 'assertion')""")
def adjudication_queue(spark: SparkSession, root: str) -> DataFrame:
    """Pairs that the rules leave open and a judge may settle: the facts beside copies that are categorical and name no period."""
    v = _restated(spark, root, fact_type=F.lit("categorical"), qualifiers=F.create_map().cast("map<string,string>"), value_raw=F.concat(F.lit("state "), F.col("id")))
    return v.filter(reconcile.needs_adjudication(F.col("type"), F.col("reason_code"), F.col("a.fact_type"), F.col("b.fact_type"))).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("""WITH e AS (SELECT user_id, event_type, value, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS until_ts, lead(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS next_value FROM events)
    SELECT event_type, count(*) AS changes FROM e WHERE until_ts > ts AND value IS DISTINCT FROM next_value GROUP BY event_type""")
def supersedes_events(spark: SparkSession, root: str) -> DataFrame:
    """States of each user and event type hold until the next event; how many are superseded by another value."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, root, "events").select("event_type", "ts", "value", F.lead("ts").over(w).alias("until_ts"), F.lead("value").over(w).alias("next_value"))
    return e.filter((F.col("until_ts") > F.col("ts")) & ~F.col("value").eqNullSafe(F.col("next_value"))).groupBy("event_type").agg(F.count("*").alias("changes"))


# --- store and query functions -------------------------------------------------------------------

_REL = "(SELECT DISTINCT ON (least(fact_a_id, fact_b_id), greatest(fact_a_id, fact_b_id)) * FROM relations ORDER BY least(fact_a_id, fact_b_id), greatest(fact_a_id, fact_b_id), id)"
_F = "(SELECT DISTINCT ON (id) * FROM facts WHERE id IS NOT NULL)"


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Relations as stored: one per unordered pair, the first by id."""
    r = ledger.ordered_pair(table(spark, root, "relations"))
    return ledger.insert_ignore(r, r.limit(0), ["fact_a_id", "fact_b_id"], ["id"])


@query(f"SELECT least(fact_a_id, fact_b_id) AS fact_a_id, greatest(fact_a_id, fact_b_id) AS fact_b_id, id, type FROM {_REL}")
def relations_stored(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, root).select("fact_a_id", "fact_b_id", "id", "type")


@query(f"""SELECT r.id, r.type, a.doc_id AS a_doc_id, a.value_raw AS a_value_raw, b.doc_id AS b_doc_id, b.value_raw AS b_value_raw
    FROM relations r JOIN {_F} a ON a.id = r.fact_a_id JOIN {_F} b ON b.id = r.fact_b_id""")
def relation_detail(spark: SparkSession, root: str) -> DataFrame:
    d = ledger.relation_detail(table(spark, root, "relations").select("id", "type", "fact_a_id", "fact_b_id"), facts(spark, root, "doc_id", "value_raw"), ["doc_id", "value_raw"])
    return d.select("id", "type", "a_doc_id", "a_value_raw", "b_doc_id", "b_value_raw")


@query("""WITH d AS (SELECT min(doc_id) AS doc_id FROM facts), o AS (SELECT DISTINCT id FROM facts JOIN d USING (doc_id))
    SELECT DISTINCT id, fact_a_id, fact_b_id, type FROM relations WHERE fact_a_id IN (SELECT id FROM o) OR fact_b_id IN (SELECT id FROM o)""")
def relations_by_doc(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "facts").select("id", "doc_id")
    first = f.agg(F.min("doc_id")).first()[0]
    return ledger.relations_by_doc(table(spark, root, "relations").select("id", "fact_a_id", "fact_b_id", "type"), f, first)


@query("""SELECT t.type, count(r.type) AS n FROM (VALUES ('CORROBORATES'), ('CONTRADICTS'), ('SUPERSEDES'), ('RECONCILED_BY_CONTEXT'), ('REFINES')) AS t(type) LEFT JOIN relations r ON r.type = t.type GROUP BY t.type""")
def relations_by_type(spark: SparkSession, root: str) -> DataFrame:
    return ledger.relations_by_type(table(spark, root, "relations"))


@query(f"""SELECT id, doc_id, subject_surface_form, measure_surface_form FROM {_F} WHERE (lower(subject_canonical_id) LIKE '%freight%' OR lower(subject_surface_form) LIKE '%freight%')
    AND (lower(measure_canonical_id) LIKE '%rev_nue%' OR lower(measure_surface_form) LIKE '%rev_nue%') ORDER BY id LIMIT 500""")
def query_facts(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "doc_id", "subject_canonical_id", "subject_surface_form", "measure_canonical_id", "measure_surface_form").filter("id is not null")
    return ledger.query_facts(f, subject="Freight", measure="rev_nue").select("id", "doc_id", "subject_surface_form", "measure_surface_form")


@query("SELECT id, fact_a_id, fact_b_id, confidence FROM (SELECT DISTINCT id, fact_a_id, fact_b_id, confidence, type, reason_code FROM relations) WHERE type = 'CONTRADICTS' AND reason_code = 'VALUES_DIVERGE' ORDER BY id LIMIT 500")
def query_relations(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "relations").select("id", "fact_a_id", "fact_b_id", "confidence", "type", "reason_code").distinct()
    return ledger.query_relations(r, "CONTRADICTS", "VALUES_DIVERGE").select("id", "fact_a_id", "fact_b_id", "confidence")


@query("SELECT doc_id, publisher, ingested_at FROM (SELECT DISTINCT ON (doc_id) * FROM filings ORDER BY doc_id, ingested_at) ORDER BY ingested_at DESC")
def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """Filings newest first; a filing ingested twice counts from its first ingestion."""
    f = table(spark, root, "filings")
    return ledger.insert_ignore(f, f.limit(0), ["doc_id"], ["ingested_at"]).select("doc_id", "publisher", "ingested_at").orderBy(F.desc("ingested_at"))


@query("SELECT DISTINCT d.doc_id, d.source FROM documents d WHERE d.filing_id IN (SELECT doc_id FROM filings)")
def has_document(spark: SparkSession, root: str) -> DataFrame:
    d, f = table(spark, root, "documents"), table(spark, root, "filings").select(F.col("doc_id").alias("filing_id"))
    return d.join(f, "filing_id", "left_semi").select("doc_id", "source").distinct()


@query("SELECT doc_id, count(DISTINCT id) AS facts FROM facts GROUP BY doc_id")
def facts_by_doc(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "facts").groupBy("doc_id").agg(F.count_distinct("id").alias("facts"))


@query("""SELECT q.id, q.doc_id, q.reason, q.score FROM (SELECT DISTINCT ON (id) * FROM quarantined ORDER BY id) q
    LEFT JOIN (SELECT doc_id, min(ingested_at) AS at FROM filings GROUP BY doc_id) f USING (doc_id) ORDER BY f.at DESC NULLS LAST, q.id LIMIT 500""")
def review_queue(spark: SparkSession, root: str) -> DataFrame:
    """Quarantined proposals of the newest filings first; the review page's 500."""
    at = table(spark, root, "filings").groupBy("doc_id").agg(F.min("ingested_at").alias("at"))
    q = table(spark, root, "quarantined").dropDuplicates(["id"]).join(at, "doc_id", "left")
    return q.orderBy(F.desc_nulls_last("at"), "id").limit(500).select("id", "doc_id", "reason", "score")


@query(f"SELECT id, doc_id, value_raw FROM {_F} WHERE id = (SELECT max(id) FROM facts)")
def get_fact(spark: SparkSession, root: str) -> DataFrame:
    """Point lookup of one fact (the last by id)."""
    f = facts(spark, root, "doc_id", "value_raw")
    return f.filter(F.col("id") == F.lit(f.agg(F.max("id")).first()[0])).select("id", "doc_id", "value_raw")


@query("SELECT DISTINCT id, type, reason_code FROM relations WHERE id = (SELECT max(id) FROM relations)")
def get_relation(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "relations").select("id", "type", "reason_code")
    return r.filter(F.col("id") == F.lit(r.agg(F.max("id")).first()[0])).distinct()


@query("SELECT DISTINCT id, reason, score FROM quarantined WHERE doc_id = (SELECT min(doc_id) FROM quarantined)")
def quarantined_by_doc(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "quarantined").select("id", "doc_id", "reason", "score")
    return q.filter(F.col("doc_id") == F.lit(q.agg(F.min("doc_id")).first()[0])).drop("doc_id").distinct()


@query(f"SELECT id, value_raw FROM {_F} WHERE doc_id = (SELECT max(doc_id) FROM facts)")
def facts_of_doc(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "doc_id", "value_raw").filter("id is not null")
    return f.filter(F.col("doc_id") == F.lit(f.agg(F.max("doc_id")).first()[0])).select("id", "value_raw")


@query("""SELECT doc_id, k AS field, v AS value FROM (SELECT doc_id, unnest(['publisher', 'document_type', 'reporting_period', 'currency', 'scale', 'consolidation', 'geography']) AS k, unnest([publisher, document_type, reporting_period, currency, scale, consolidation, geography]) AS v
    FROM (SELECT DISTINCT ON (doc_id) * FROM filings ORDER BY doc_id, ingested_at)) WHERE v IS NOT NULL""")
def document_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Each filing's context as stored, without the fields that are unknown."""
    f = table(spark, root, "filings")
    d = ledger.insert_ignore(f, f.limit(0), ["doc_id"], ["ingested_at"])
    fields = ("publisher", "document_type", "reporting_period", "currency", "scale", "consolidation", "geography")
    return d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])).alias("x")).select("doc_id", "x.*").filter("value is not null")


@query("SELECT id, doc_id FROM quarantined WHERE id NOT IN (SELECT id FROM quarantined WHERE doc_id IN (SELECT doc_id FROM filings WHERE currency = 'INR') AND id IS NOT NULL) GROUP BY ALL")
def insert_ignored(spark: SparkSession, root: str) -> DataFrame:
    """What is left to append of all quarantined proposals where those of the filings in rupees are stored already."""
    q = table(spark, root, "quarantined").select("id", "doc_id")
    stored = q.join(table(spark, root, "filings").filter("currency = 'INR'").select("doc_id"), "doc_id", "left_semi")
    return ledger.insert_ignore(q, stored, ["id"], ["doc_id"]).select("id", "doc_id")


@query("""WITH f AS (SELECT doc_id, count(DISTINCT id) AS facts FROM facts GROUP BY doc_id), q AS (SELECT doc_id, count(DISTINCT id) AS quarantined FROM quarantined GROUP BY doc_id)
    SELECT coalesce(f.doc_id, q.doc_id) AS doc_id, coalesce(facts, 0) AS facts, coalesce(quarantined, 0) AS quarantined FROM f FULL JOIN q ON f.doc_id = q.doc_id""")
def ingest_counts(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "facts").groupBy("doc_id").agg(F.count_distinct("id").alias("facts"))
    q = table(spark, root, "quarantined").groupBy("doc_id").agg(F.count_distinct("id").alias("quarantined"))
    return f.join(q, "doc_id", "full").select("doc_id", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"))


@query(f"SELECT fact_type, count(*) AS facts, count(*) FILTER (lower(trim(measure_surface_form)) = lower(trim(value_raw))) AS measure_is_value FROM {_F} GROUP BY fact_type")
def measure_value_share(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "fact_type", "measure_surface_form", "value_raw").filter("id is not null")
    same = F.lower(F.trim("measure_surface_form")) == F.lower(F.trim("value_raw"))
    return f.groupBy("fact_type").agg(F.count("*").alias("facts"), F.count_if(same).alias("measure_is_value"))


@query(f"SELECT id, coalesce(qualifiers['period_label'], qualifiers['period_end'], '') AS period FROM {_F}")
def period_column(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "qualifiers").filter("id is not null")
    return f.select("id", F.coalesce(F.col("qualifiers")["period_label"], F.col("qualifiers")["period_end"], F.lit("")).alias("period"))


# --- blocks ---------------------------------------------------------------------------------------

_B = "(SELECT DISTINCT ON (doc_id, page_no, block_no) * FROM blocks)"
_HEADING = "coalesce(trim(text) <> '' AND length(trim(text)) <= 80 AND NOT regexp_matches(trim(text), '[.,;]$'), false)"


@query(f"SELECT doc_id, page_no, block_no, length(text) AS n_chars FROM {_B} WHERE length(text) >= 40")
def block_scan(spark: SparkSession, root: str) -> DataFrame:
    return layout.long_blocks(blocks(spark, root)).select("doc_id", "page_no", "block_no", F.length("text").alias("n_chars"))


@query(f"SELECT page_type, count(*) AS blocks, count(DISTINCT (doc_id, page_no)) AS pages FROM {_B} GROUP BY page_type")
def page_report(spark: SparkSession, root: str) -> DataFrame:
    b = blocks(spark, root)
    per_page = b.groupBy("page_type", "doc_id", "page_no").agg(F.count("*").alias("n"))
    return per_page.groupBy("page_type").agg(F.sum("n").alias("blocks"), F.count("*").alias("pages"))


@query(f"""SELECT doc_id, page_no, block_no, last_value(CASE WHEN {_HEADING} THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no, block_no) AS section FROM {_B}""")
def sections(spark: SparkSession, root: str) -> DataFrame:
    return layout.tag_sections(blocks(spark, root)).select("doc_id", "page_no", "block_no", "section")


_PROSE_BATCHES = f"""WITH RECURSIVE b AS (SELECT doc_id, page_no, block_no, length(text) + 120 AS c, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, block_no) AS i FROM {_B} WHERE length(text) >= 40 AND page_type = 'prose'),
    r(doc_id, i, page_no, block_no, total, n, batch_no) AS (
        SELECT doc_id, i, page_no, block_no, c, 1, 0 FROM b WHERE i = 1
        UNION ALL SELECT b.doc_id, b.i, b.page_no, b.block_no, CASE WHEN r.total + b.c > 3500 OR r.n >= 20 THEN b.c ELSE r.total + b.c END,
            CASE WHEN r.total + b.c > 3500 OR r.n >= 20 THEN 1 ELSE r.n + 1 END, r.batch_no + (r.total + b.c > 3500 OR r.n >= 20)::INT FROM r JOIN b ON b.doc_id = r.doc_id AND b.i = r.i + 1)"""


@query(f"{_PROSE_BATCHES} SELECT doc_id, page_no, block_no, batch_no FROM r")
def batching(spark: SparkSession, root: str) -> DataFrame:
    """Prompt batches of each filing's prose blocks in document order."""
    b = layout.long_blocks(blocks(spark, root)).filter("page_type = 'prose'").select("doc_id", "page_no", "block_no", F.length("text").alias("n"))
    out = layout.greedy_batches(b, ["doc_id"], ["page_no", "block_no"], F.col("n") + layout.BLOCK_COST)
    return out.select("doc_id", "page_no", "block_no", "batch_no")


@query(f"{_PROSE_BATCHES} SELECT doc_id, batch_no, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS blocks FROM r GROUP BY doc_id, batch_no")
def batch_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages and blocks that each prose batch covers."""
    return batching(spark, root).groupBy("doc_id", "batch_no").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("blocks"))


@query(f"""SELECT doc_id, CASE WHEN page_type IN ('prose', 'table') THEN page_type ELSE 'skipped' END AS route, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS blocks FROM {_B} GROUP BY 1, 2""")
def route_pages(spark: SparkSession, root: str) -> DataFrame:
    """All pages of each filing by the route they take; slides are skipped and counted."""
    return layout.route_pages(blocks(spark, root))


@query(f"SELECT doc_id, left(string_agg(text, chr(10) ORDER BY page_no, block_no), 4000) AS sample FROM {_B} WHERE text IS NOT NULL GROUP BY doc_id")
def sample_text(spark: SparkSession, root: str) -> DataFrame:
    """The first 4000 characters of each filing, over as many pages as they take, that a context provider reads."""
    return layout.opening(blocks(spark, root))


#: A currency sign, an optional amount, and a scale word.
_HINT = r"(?i)[₹$€£]\s*(?:\(?[\d,]+(?:\.\d+)?\)?\s*)?(?:in\s+)?(?:million|mn|crore|cr|lakh|lk|thousand|k|billion|bn)\b"


_RE2_HINT = S.lit(_HINT.removeprefix("(?i)"))


@query(f"""WITH t AS (SELECT doc_id, page_no, block_no, text, list_slice(regexp_extract_all(text, {_RE2_HINT}, 0, 'i'), 1, 3) AS h, regexp_split_to_array(text, {_RE2_HINT}, 'i') AS s FROM {_B} WHERE regexp_matches(text, {_RE2_HINT}, 'i')),
    u AS (SELECT *, unnest(generate_series(1, len(h))) AS k FROM t),
    v AS (SELECT *, list_sum(list_transform(list_slice(s, 1, k), lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(list_slice(h, 1, k - 1), lambda x: length(x))), 0)::BIGINT AS at FROM u),
    w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, block_no, k) AS rn, substring(text, greatest(v.at - 60, 0) + 1, v.at + length(h[k]) + 60 - greatest(v.at - 60, 0)) AS x FROM v)
    SELECT doc_id, rn, trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')) AS snippet FROM w WHERE rn <= 3""")
def scale_hints(spark: SparkSession, root: str) -> DataFrame:
    """The first three currency-and-scale mentions of each filing with 60 characters around."""
    b = blocks(spark, root).filter(F.col("text").rlike(_HINT))
    hits = b.select("doc_id", "page_no", "block_no", F.posexplode(layout.around(F.col("text"), _HINT, 60, 3)).alias("k", "hit"))
    w = Window.partitionBy("doc_id").orderBy("page_no", "block_no", "k")
    return hits.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("doc_id", "rn", text.squash(F.col("hit")).alias("snippet"))


#: A page's size in points where the tables name none.
_WIDTH, _HEIGHT = 612.0, 792.0


@query(f"""SELECT doc_id, page_no, round(sum(greatest(0, least(bbox.x1, {_WIDTH}) - greatest(bbox.x0, 0)) * greatest(0, least(bbox.y1, {_HEIGHT}) - greatest(bbox.y0, 0))) / ({_WIDTH} * {_HEIGHT}), 6) AS coverage
    FROM {_B} WHERE bbox IS NOT NULL GROUP BY doc_id, page_no""")
def page_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Share of each page under its blocks."""
    b = blocks(spark, root).filter("bbox is not null").select("doc_id", "page_no", "bbox.*")
    pages = b.select("doc_id", "page_no").distinct().select("*", F.lit(_WIDTH).alias("width"), F.lit(_HEIGHT).alias("height"))
    return layout.coverage(b, pages).select("doc_id", "page_no", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH RECURSIVE b AS (SELECT doc_id, page_no, block_no, bbox.y0 AS y0, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY bbox.y0, bbox.x0, block_no) AS i FROM {_B} WHERE bbox IS NOT NULL),
    r(doc_id, page_no, i, block_no, head, row_no) AS (
        SELECT doc_id, page_no, i, block_no, y0, 1 FROM b WHERE i = 1
        UNION ALL SELECT b.doc_id, b.page_no, b.i, b.block_no, CASE WHEN abs(b.y0 - r.head) > 2 THEN b.y0 ELSE r.head END, r.row_no + (abs(b.y0 - r.head) > 2)::INT FROM r JOIN b ON b.doc_id = r.doc_id AND b.page_no = r.page_no AND b.i = r.i + 1)
    SELECT doc_id, page_no, block_no, row_no FROM r""")
def page_rows(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of each page clustered into rows by their top edge."""
    b = blocks(spark, root).filter("bbox is not null").select("doc_id", "page_no", F.col("block_no").alias("span_no"), "bbox.y0", "bbox.x0")
    return layout.cluster_rows(b, layout.PAGE).select("doc_id", "page_no", F.col("span_no").alias("block_no"), "row_no")


def _figures(spark: SparkSession, root: str) -> DataFrame:
    """Each filing's numeric values of one page as a page to rebuild: the tables hold no spans, so one is laid out from
    the facts themselves. A row per fact: its wording, its number, and where on the page its quote begins; above
    them two headers that do not stand over the middle of their columns, a scale annotation and a title."""
    f = facts(spark, root, "doc_id", "fact_type", "measure_surface_form", "value_number", "evidence.page_no", "evidence.char_start").filter("fact_type = 'numeric' and value_number is not null and id is not null and page_no is not null")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("id")))
    y = F.lit(100.0) + F.col("n") * 12

    def span(no, text, x0, x1, y0):
        return F.struct(no.cast("int").alias("span_no"), text.alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), y0.alias("y0"), (y0 + 8).alias("y1"))

    row = F.array(
        span(F.col("n") * 3, F.col("measure_surface_form"), 10.0, 180.0, y),
        span(F.col("n") * 3 + 1, F.col("value_number").cast("decimal(24,2)").cast("string"), 200.0, 260.0, y + 1),
        span(F.col("n") * 3 + 2, F.coalesce("char_start", F.lit(0)).cast("string"), 320.0, 350.0, y + 1.5),
    )
    top = F.array(
        span(F.lit(0), F.lit("Stated"), 195.0, 215.0, F.lit(95.0)), span(F.lit(1), F.lit("At"), 340.0, 360.0, F.lit(95.5)),
        span(F.lit(2), F.lit("(in million)"), 200.0, 260.0, F.lit(80.0)), span(F.lit(-1), F.lit("Figures of the page"), 200.0, 340.0, F.lit(42.0)),
    )
    cells = f.select("doc_id", "page_no", F.inline(row))
    head = f.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.inline(top))
    return cells.unionByName(head).withColumn("block_no", F.lit(0))


@query(f"""WITH f AS (SELECT *, evidence.page_no AS page_no, coalesce(evidence.char_start, 0) AS pos, row_number() OVER (PARTITION BY doc_id, evidence.page_no ORDER BY id) AS n FROM {_F}
        WHERE fact_type = 'numeric' AND value_number IS NOT NULL AND evidence.page_no IS NOT NULL),
    c AS (SELECT doc_id, page_no, n AS line, measure_surface_form AS m, cast(value_number AS DECIMAL(24,2))::VARCHAR AS value, 230.0 AS mid FROM f
        UNION ALL SELECT doc_id, page_no, n, measure_surface_form, pos::VARCHAR, 335.0 FROM f)
    SELECT doc_id, page_no, line, CASE WHEN regexp_matches(trim(m), '^[+-]?[₹$]?\\(?[\\d,]+(\\.\\d+)?\\)?%?$') THEN NULL ELSE trim(m) END AS label, value, CASE WHEN mid <= (215 + 340) / 2 THEN 'Stated' ELSE 'At' END AS header FROM c""")
def table_cells(spark: SparkSession, root: str) -> DataFrame:
    """The cells found again from the laid-out pages, with the label of their row and the header they stand under."""
    c = layout.header_cells(_figures(spark, root))
    # rows are counted from the title: the headers' row and those above come first
    line = F.dense_rank().over(Window.partitionBy(*layout.PAGE).orderBy("row_no"))
    return c.select(*layout.PAGE, line.alias("line"), "label", "value", "header")


@query(f"""SELECT DISTINCT doc_id, evidence.page_no AS page_no, 'Figures of the page — (in million)' AS caption FROM {_F} WHERE fact_type = 'numeric' AND value_number IS NOT NULL AND evidence.page_no IS NOT NULL""")
def table_captions(spark: SparkSession, root: str) -> DataFrame:
    return layout.captions(_figures(spark, root))


@query(f"""WITH RECURSIVE f AS (SELECT *, evidence.page_no AS page_no, coalesce(evidence.char_start, 0) AS pos, row_number() OVER (PARTITION BY doc_id, evidence.page_no ORDER BY id) AS n FROM {_F}
        WHERE fact_type = 'numeric' AND value_number IS NOT NULL AND evidence.page_no IS NOT NULL),
    l AS (SELECT *, CASE WHEN regexp_matches(trim(measure_surface_form), '^[+-]?[₹$]?\\(?[\\d,]+(\\.\\d+)?\\)?%?$') THEN 0 ELSE coalesce(length(trim(measure_surface_form)), 0) END AS label FROM f),
    c AS (SELECT doc_id, page_no, n * 2 - 1 AS i, label + 6 + length(cast(value_number AS DECIMAL(24,2))::VARCHAR) + 30 AS c FROM l UNION ALL SELECT doc_id, page_no, n * 2, label + 2 + length(pos::VARCHAR) + 30 FROM l),
    r(doc_id, page_no, i, total, k, batch_no) AS (
        SELECT doc_id, page_no, i, c, 1, 0 FROM c WHERE i = 1
        UNION ALL SELECT c.doc_id, c.page_no, c.i, CASE WHEN r.total + c.c > 3500 OR r.k >= 20 THEN c.c ELSE r.total + c.c END, CASE WHEN r.total + c.c > 3500 OR r.k >= 20 THEN 1 ELSE r.k + 1 END,
            r.batch_no + (r.total + c.c > 3500 OR r.k >= 20)::INT FROM r JOIN c ON c.doc_id = r.doc_id AND c.page_no = r.page_no AND c.i = r.i + 1)
    SELECT doc_id, page_no, batch_no, count(*) AS cells FROM r GROUP BY ALL""")
def cell_batching(spark: SparkSession, root: str) -> DataFrame:
    """Prompt batches of each page's cells in reading order."""
    b = layout.cell_batches(layout.header_cells(_figures(spark, root)))
    return b.groupBy(*layout.PAGE, "batch_no").agg(F.count("*").alias("cells"))


@query(f"""SELECT id, evidence.bbox[1].x0 * 1275 / {612.0} AS x0, evidence.bbox[1].y0 * 1650 / {792.0} AS y0, evidence.bbox[1].x1 * 1275 / {612.0} AS x1, evidence.bbox[1].y1 * 1650 / {792.0} AS y1 FROM {_F} WHERE len(evidence.bbox) > 0""")
def evidence_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Where each fact's evidence lies on its page as drawn at 150 dots an inch."""
    f = facts(spark, root, "evidence.bbox").filter("id is not null and size(bbox) > 0")
    box = layout.to_pixels(F.col("bbox")[0], F.lit(_WIDTH), F.lit(_HEIGHT), F.lit(1275.0), F.lit(1650.0))
    return f.select("id", box.alias("b")).select("id", *[F.round(f"b.{c}", 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


#: Micro-batches that the incremental query makes of the filings.
_STEPS = 4
_DELIVERY = f"""d AS (SELECT doc_id, min(ingested_at) AS arrived FROM filings GROUP BY doc_id),
    st AS (SELECT doc_id, ntile({_STEPS}) OVER (ORDER BY arrived NULLS LAST, doc_id) AS step FROM d)"""


@query(f"""WITH {S.facts_cte(f""", {_DELIVERY},
    fd AS (SELECT f.*, coalesce(st.step, 1) AS doc_seq, row_number() OVER (ORDER BY f.doc_id, f.id) AS seq FROM f LEFT JOIN st USING (doc_id)),
    ex AS (SELECT a.id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY b.seq) AS rn FROM fd a JOIN fd b ON a.claim_key = b.claim_key AND a.id <> b.id AND b.doc_seq <= a.doc_seq QUALIFY rn <= 50),
    lo AS (SELECT a.id, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY b.seq) AS rl FROM fd a JOIN fd b ON a.loose_key = b.loose_key AND a.id <> b.id AND b.doc_seq <= a.doc_seq
        LEFT JOIN ex ON ex.id = a.id AND ex.other_id = b.id WHERE ex.id IS NULL QUALIFY rl <= 50),
    pairs AS (SELECT least(id, other_id) AS a_id, greatest(id, other_id) AS b_id, 'any' AS match_level FROM (SELECT id, other_id FROM ex UNION ALL SELECT id, other_id FROM lo) GROUP BY 1, 2)
    """ + _VERDICTS)} SELECT a_id AS fact_a_id, b_id AS fact_b_id, type, reason_code, confidence FROM verdicts""")
def incremental_ingest(spark: SparkSession, root: str) -> DataFrame:
    """All facts through the streaming ingestion into a fresh ledger of the shared folder, in _STEPS deliveries
    by the filings' order of ingestion (facts of unknown filings come first); every stored relation."""
    from ..streaming.ingest import ingest_stream

    at = table(spark, root, "filings").groupBy("doc_id").agg(F.min("ingested_at").alias("at"))
    # the filings' dates are few beside the facts; ntile needs them in one order
    step = at.select("doc_id", F.ntile(_STEPS).over(Window.orderBy(F.asc_nulls_last("at"), "doc_id")).alias("step"))
    arrived = cut(table(spark, root, "facts").join(step, "doc_id", "left").withColumn("step", F.coalesce("step", F.lit(1))))
    with shared_folder(spark) as base:
        led = ledger.Ledger(spark, base + "/tables")
        for n in range(1, _STEPS + 1):
            arrived.filter(F.col("step") == n).drop("step").write.mode("append").parquet(base + "/arrivals")
            ingest_stream(spark, base + "/arrivals", led, base + "/progress").awaitTermination()
        return cut(led.read("relations").select("fact_a_id", "fact_b_id", "type", "reason_code", "confidence"))


_HEADERS = ["FY24", "fy 23", "Consolidated 2024", "Standalone", "Year ended March 31, 2023", "Q4 FY24", "", "Particulars 2019"]


@query(f"""WITH h AS (SELECT header FROM (VALUES {', '.join(f'({S.lit(x)})' for x in _HEADERS)}) AS t(header)), d AS (SELECT DISTINCT ON (doc_id) doc_id, reporting_period FROM filings ORDER BY doc_id, ingested_at),
    x AS (SELECT doc_id, header, nullif(lower(regexp_extract(header, '\\b(standalone|consolidated)\\b', 1, 'i')), '') AS consolidation, try_cast(nullif(regexp_extract(header, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INT) AS y,
        try_cast(nullif(regexp_extract(reporting_period, 'FY\\s?(\\d{{2}})\\b', 1), '') AS INT) + 2000 AS e, reporting_period FROM h, d)
    SELECT doc_id, header, consolidation, CASE WHEN regexp_matches(trim(header), '^FY\\s?\\d{{2}}$', 'i') THEN regexp_replace(upper(trim(header)), '\\s+', '', 'g') WHEN y = e THEN reporting_period WHEN y = e - 1 THEN 'FY' || lpad(((e - 1) % 100)::VARCHAR, 2, '0') END AS period_label FROM x""")
def header_qualifiers(spark: SparkSession, root: str) -> DataFrame:
    """Column headers read against each filing's reporting period; the headers are a list of eight."""
    f = table(spark, root, "filings")
    d = ledger.insert_ignore(f, f.limit(0), ["doc_id"], ["ingested_at"]).select("doc_id", "reporting_period", F.explode(F.array(*map(F.lit, _HEADERS))).alias("header"))
    q = layout.header_qualifiers(F.col("header"), F.col("reporting_period"))
    return d.withColumn("q", q).select("doc_id", "header", F.col("q")["consolidation"].alias("consolidation"), F.col("q")["period_label"].alias("period_label"))


@query(f"""SELECT DISTINCT value_raw, try_cast(regexp_replace(replace(replace(replace(trim(value_raw), ',', ''), '(', '-'), ')', ''), '%$', '') AS DOUBLE) AS number FROM facts WHERE value_raw IS NOT NULL""")
def table_numbers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "facts").select("value_raw").filter("value_raw is not null").distinct().withColumn("number", layout.table_number(F.col("value_raw")))


@query(f"""SELECT id, {S.slug('subject_surface_form', 'unknown')} AS subject_slug,
    sha256(doc_id || '|' || block_id || '|' || {S.slug('subject_surface_form', 'unknown')} || '|' || {S.slug('measure_surface_form', 'unknown')} || '|' || value_raw || '|' || coalesce(evidence.char_start::VARCHAR, '') || '|' || coalesce(evidence.char_end::VARCHAR, '')) AS content_id
    FROM {_F}""")
def fact_ids(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "doc_id", "block_id", "subject_surface_form", "measure_surface_form", "value_raw", "evidence.char_start", "evidence.char_end").filter("id is not null")
    s, m = text.slug(F.col("subject_surface_form")), text.slug(F.col("measure_surface_form"))
    c = F.col
    return f.select("id", s.alias("subject_slug"), keys.fact_id(c("doc_id"), c("block_id"), s, m, c("value_raw"), c("char_start"), c("char_end")).alias("content_id"))


_CITED = f"""g AS (SELECT f.id, f.evidence.quote AS quote, b.text FROM {_F} f LEFT JOIN {_B} b ON f.block_id = b.doc_id || ':p' || b.page_no::VARCHAR || ':b' || b.block_no::VARCHAR)"""


def _grounded(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "doc_id", "block_id", "evidence.quote").filter("id is not null")
    b = blocks(spark, root).select(F.concat("doc_id", F.lit(":p"), "page_no", F.lit(":b"), "block_no").alias("block_id"), "text")
    return ground.ground(f, b, ["block_id"])


@query(f"""WITH {_CITED} SELECT id, strpos(text, quote) - 1 AS char_start, strpos(text, quote) - 1 + length(quote) AS char_end FROM g WHERE trim(quote) <> '' AND contains(text, quote)""")
def ground_exact(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root, "block_id", "evidence.quote").filter("id is not null")
    b = blocks(spark, root).select(F.concat("doc_id", F.lit(":p"), "page_no", F.lit(":b"), "block_no").alias("block_id"), "text")
    at = F.instr(F.col("text"), F.col("quote"))
    return f.filter(F.trim("quote") != "").join(b, "block_id").filter(at > 0).select("id", (at - 1).alias("char_start"), (at - 1 + F.length("quote")).alias("char_end"))


@query()
def ground_fuzzy(spark: SparkSession, root: str) -> DataFrame:
    """Every fact through the gate: exact hits in the JVM, the rest aligned in Arrow batches."""
    return _grounded(spark, root).select("id", F.round("score", 6).alias("score"), "char_start", "char_end", "reason")


@query()
def ground_counts(spark: SparkSession, root: str) -> DataFrame:
    return _grounded(spark, root).groupBy(F.coalesce(F.regexp_replace("reason", r" [\d.]+ below.*", " below threshold"), F.lit("grounded")).alias("outcome")).agg(F.count("*").alias("n"))


#: Provider messages with and without a wait.
_MESSAGES = ["try again in 432ms", "Please try again in 4m45.552s", "try again in 23h59m59s", "no hint", "tokens per day (TPD) reached, try again in 7m", "requests per minute (RPM)", "Try again in 2h", ""]


@query(f"""WITH m AS (SELECT * FROM (VALUES {', '.join(f'({S.lit(x)})' for x in _MESSAGES)}) AS t(message)),
    p AS (SELECT message, coalesce(try_cast(nullif(regexp_extract(message, 'try again in\\s+(?:\\d+m)?(?:\\d+h)?(?:(\\d+)h)?', 0, 'i'), '') AS VARCHAR), '') AS hint, lower(regexp_extract(message, 'try again in\\s+([0-9hms.]+)', 1, 'i')) AS t FROM m),
    q AS (SELECT message, t, try_cast(nullif(regexp_extract(t, '^(\\d+)h', 1), '') AS DOUBLE) AS h, try_cast(nullif(regexp_extract(t, '^(?:\\d+h)?(\\d+)m(?:[^s]|$)', 1), '') AS DOUBLE) AS mi,
        try_cast(nullif(regexp_extract(t, '([\\d.]+)s$', 1), '') AS DOUBLE) AS s, try_cast(nullif(regexp_extract(t, '(\\d+)ms$', 1), '') AS DOUBLE) AS ms FROM p)
    SELECT message, CASE WHEN h IS NULL AND mi IS NULL AND s IS NULL AND ms IS NULL THEN 60.0::DOUBLE ELSE coalesce(h, 0) * 3600 + coalesce(mi, 0) * 60 + coalesce(s, 0) + coalesce(ms, 0) / 1000 END AS wait_seconds,
        regexp_matches(message, '\\b(?:requests|tokens)\\s+per\\s+day\\b|\\((?:rpd|tpd)\\)', 'i') AS daily FROM q""")
def retry_after(spark: SparkSession, root: str) -> DataFrame:
    from ..adjudicate import daily_quota, retry_seconds

    m = spark.createDataFrame([(x,) for x in _MESSAGES], "message string")
    return m.select("message", retry_seconds(F.col("message")).alias("wait_seconds"), daily_quota(F.col("message")).alias("daily"))


@query("""WITH l AS (SELECT year(l_shipdate - INTERVAL 3 MONTH) AS fy, quarter(l_shipdate - INTERVAL 3 MONTH) AS q, cast(l_extendedprice * 100 AS DECIMAL(18, 0)) AS cents FROM lineitem)
    SELECT fy, q, count(*) AS lines, cast(sum(cents) AS DOUBLE) / 100 AS revenue FROM l GROUP BY ROLLUP (fy, q)""")
def fiscal_quarter_rollup(spark: SparkSession, root: str) -> DataFrame:
    at = F.add_months(F.to_date("l_shipdate"), -3)
    l = table(spark, root, "lineitem").select(F.year(at).cast("bigint").alias("fy"), F.quarter(at).cast("bigint").alias("q"), F.round(F.col("l_extendedprice") * 100, 0).cast("decimal(18,0)").alias("cents"))
    return l.rollup("fy", "q").agg(F.count("*").alias("lines"), (F.sum("cents").cast("double") / 100).alias("revenue"))
