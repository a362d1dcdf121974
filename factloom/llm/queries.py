"""Queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut
from ..sources.tables import table
from . import components, evidence, leaks, measures, mixing, names, packing, topics

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return measures.free_wordings(table(spark, root, "facts").select("id", "measure_surface_form"), table(spark, root, "measure_list"))


def p1_measures(spark: SparkSession, root: str) -> DataFrame:
    """Every fact with its measure put right, labels included."""
    facts = table(spark, root, "facts").select("id", "measure_surface_form").filter("id is not null").dropDuplicates(["id"])
    return measures.map_measures(facts, table(spark, root, "measure_list")).select("id", "measure_id", F.round("similarity", 6).alias("similarity"))


def p2_batches(spark: SparkSession, root: str) -> DataFrame:
    return packing.batches(table(spark, root, "blocks"), table(spark, root, "batch_limits"))


def p2_room(spark: SparkSession, root: str) -> DataFrame:
    """Per profile: the characters batched, the fewest batches that could hold them, and whether every batch keeps its
    capacity, every block is whole or alone too large, and at most a tenth more batches are used than could be."""
    limits, blocks = table(spark, root, "batch_limits"), table(spark, root, "blocks")
    packed = cut(packing.batches(blocks, limits))
    room = packing.room_report(packed, limits)
    load = packed.groupBy("profile", "batch_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("n"))
    size = packed.groupBy("profile", "doc_id", "page_no", "block_no").agg(F.max("char_end").alias("n"), F.count("*").alias("pieces"))
    caps = F.broadcast(limits.select("profile", "capacity_chars").distinct())
    holds = load.join(caps, "profile").groupBy("profile").agg(F.bool_and(F.col("n") <= F.col("capacity_chars")).alias("holds"))
    whole = size.join(caps, "profile").groupBy("profile").agg(F.bool_and((F.col("pieces") == 1) | (F.col("n") > F.col("capacity_chars"))).alias("whole"))
    tight = (F.col("batches") <= F.col("least_batches") * 1.1).alias("tight")
    return room.join(holds, "profile").join(whole, "profile").select("profile", "chars", F.col("least_batches").cast("bigint").alias("least_batches"), "holds", "whole", tight)


def p2_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the batches are, and how near the curve keeps what is in one."""
    limits = table(spark, root, "batch_limits")
    return packing.room_report(packing.batches(table(spark, root, "blocks"), limits), limits)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return evidence.disguised_quotes(table(spark, root, "facts").select("id", "block_id", F.col("evidence.quote").alias("quote")), table(spark, root, "blocks"))


def p4_unified(spark: SparkSession, root: str) -> DataFrame:
    return evidence.unified_texts(table(spark, root, "facts").select("id", F.col("evidence.quote").alias("quote")), table(spark, root, "blocks"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return names.spelling_pairs(table(spark, root, "facts").select("subject_surface_form", "subject_type"))


def p6_subjects(spark: SparkSession, root: str) -> DataFrame:
    """Every spelling with the rewriting of its subject, the corrected canonical id."""
    return names.entities(table(spark, root, "facts").select("subject_surface_form", "subject_type"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = table(spark, root, "relations").filter("type = 'CORROBORATES'").select("fact_a_id", "fact_b_id")
    return components.groups(pairs, "fact_a_id", "fact_b_id").select(F.col("vertex").alias("fact_id"), "group_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.shared_runs(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_near(spark: SparkSession, root: str) -> DataFrame:
    """Documents with a whole item in them, up to a tenth of its words inserted, left out or replaced."""
    return leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), None, 0.1).select("doc_id", "item_id", "edits").distinct()


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Every item and in how many documents it leaked."""
    return leaks.leak_report(table(spark, root, "documents"), table(spark, root, "eval_items")).drop("windows")


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_caps(spark: SparkSession, root: str) -> DataFrame:
    """Per source with text: its target share of the mix and whether no document comes more often than its cap."""
    targets = table(spark, root, "mix_targets")
    s = mixing.shares(table(spark, root, "documents"), targets).join(F.broadcast(targets.select("source", "max_repeats")), "source")
    return s.select("source", "target_share", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"))


def _areas(spark: SparkSession, root: str) -> DataFrame:
    return topics.subjects(*[table(spark, root, t) for t in ("documents", "doc_labels", "area_list", "eval_items")])


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _areas(spark, root).select("doc_id", "area").distinct()


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    """Documents per area."""
    return _areas(spark, root).groupBy("area").agg(F.count_distinct("doc_id").alias("documents"))


def queries() -> dict[str, Query]:
    qs = [p1_found, p1_measures, p2_batches, p2_room, p2_fill, p4_found, p4_unified, p6_found, p6_subjects, p7_found, p8_found, p8_near, p8_items, p9_mix, p9_shares, p9_caps, p10_found, p10_composition]
    return {q.__name__: q for q in qs}


def _one_form(e: str) -> str:
    """SQL of a text in one form: look-alikes, full-width forms, spaces and hyphens by table, hidden characters dropped,
    ligatures spelt out, marks composed, runs of spaces as one."""
    pairs = {**text.LOOKALIKES, **text.WIDE, **{x: " " for x in text.SPACES}, **{x: "-" for x in text.HYPHENS}}
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate({e}, {lit(''.join(pairs) + text.INVISIBLE)}, {lit(''.join(pairs.values()))})"
    for one, to in text.LIGATURES.items():
        out = f"replace({out}, {lit(one)}, {lit(to)})"
    return f"regexp_replace(nfc_normalize({out}), ' +', ' ', 'g')"


def _runs(table: str, key: str) -> str:
    """SQL of the distinct runs of 13 words of a table's texts."""
    words = f"regexp_extract_all(lower({_one_form('text')}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"
    return f"""SELECT DISTINCT {key}, array_to_string(list_slice(w, k, k + 12), ' ') AS run
        FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 12)) AS k FROM (SELECT {key}, {words} AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL))"""


def oracle_sql() -> dict[str, str]:
    """Plain SQL for the operators that SQL can state over whole tables in reasonable time."""
    cited = """(SELECT f.id, f.evidence.quote AS quote, b.text FROM facts f JOIN blocks b ON f.block_id = b.doc_id || ':p' || b.page_no::VARCHAR || ':b' || b.block_no::VARCHAR
        WHERE f.id IS NOT NULL AND f.evidence.quote IS NOT NULL AND b.text IS NOT NULL)"""
    shared = f"SELECT DISTINCT d.doc_id, i.item_id FROM ({_runs('documents', 'doc_id')}) d JOIN ({_runs('eval_items', 'item_id')}) i USING (run)"
    return {
        "p4_found": f"""SELECT DISTINCT id FROM (SELECT id, {_one_form('quote')} AS q, {_one_form('text')} AS t FROM {cited} WHERE NOT contains(text, quote)) WHERE trim(q) <> '' AND contains(t, q)""",
        "p8_found": shared,
        "p8_items": f"""SELECT i.item_id, min(i.suite) AS suite, count(DISTINCT s.doc_id) AS documents FROM eval_items i LEFT JOIN ({shared}) s USING (item_id) GROUP BY i.item_id""",
        "p9_caps": """SELECT source, target_share, true AS capped FROM mix_targets t WHERE EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0)""",
        "p2_room": """WITH b AS (SELECT doc_id, page_no, block_no, min(coalesce(length(text), 0)) AS n FROM blocks WHERE doc_id IS NOT NULL AND page_no IS NOT NULL AND block_no IS NOT NULL GROUP BY ALL),
            c AS (SELECT doc_id, sum(n) AS n FROM b GROUP BY doc_id)
            SELECT profile, sum(n)::BIGINT AS chars, sum(greatest(ceil(n / capacity_chars), 1))::BIGINT AS least_batches, true AS holds, true AS whole, true AS tight FROM c, batch_limits GROUP BY profile""",
        "p7_found": """
            WITH RECURSIVE e AS (
                SELECT fact_a_id AS u, fact_b_id AS v FROM relations
                WHERE type = 'CORROBORATES' AND fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL
                UNION SELECT fact_b_id, fact_a_id FROM relations
                WHERE type = 'CORROBORATES' AND fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL
            ), r(u, g) AS (
                SELECT u, u FROM e UNION SELECT e.v, r.g FROM r JOIN e ON e.u = r.u
            )
            SELECT u AS fact_id, min(g) AS group_id FROM r GROUP BY u
        """
    }
