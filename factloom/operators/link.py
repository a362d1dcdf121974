"""Candidate pairs of facts that may state the same claim.

Groups are capped by the feature's own definition (a fact compares with its first N peers). The cap
runs below the pairing: ``row_number <= N`` becomes a partial and a final group limit, so a key that
holds a third of the table sends at most N rows per task into the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import salted_join

MAX_GROUP = 50


def first_of_group(facts: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each key by ``order``; rows with a null key belong to no group."""
    w = Window.partitionBy(key).orderBy(*order)
    return facts.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)


def group_heads(facts: DataFrame, key: str, order: list, limit: int, payload: Column) -> DataFrame:
    """One row per key: ``heads``, the first ``limit`` payloads in order (an array of bounded length)."""
    heads = first_of_group(facts, key, order, limit).select(key, F.struct("_rn", payload.alias("p")).alias("h"))
    return heads.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("h")), lambda x: x["p"]).alias("heads"))


def spread_heads(facts: DataFrame, order: list, limit: int, payload: Column) -> DataFrame:
    """One row per loose key: ``heads`` holds, for any one claim key left out, the first ``limit`` payloads of
    the others in order.

    No more than ``limit`` facts of a claim key are among the first ``limit`` of the others, so each claim
    key keeps that many, and the first ``2 * limit`` of those suffice whichever claim key is left out."""
    w = Window.partitionBy("loose_key", "claim_key").orderBy(*order)
    some = facts.filter(F.col("loose_key").isNotNull()).withColumn("_cn", F.row_number().over(w)).filter(F.col("_cn") <= limit)
    return group_heads(some, "loose_key", order, 2 * limit, payload)


def _pairs_within(groups: DataFrame, level: str) -> DataFrame:
    """All pairs of each bounded ``heads`` array, the smaller id first."""
    a = groups.filter(F.size("heads") > 1).select("heads", F.posexplode("heads").alias("i", "x"))
    p = a.select("x", F.explode(F.slice("heads", F.col("i") + 2, F.size("heads"))).alias("y"))
    swap = F.col("x.id") > F.col("y.id")
    return p.filter(F.col("x.id") != F.col("y.id")).select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"),
        F.lit(level).alias("match_level"),
    )


def find_candidates(facts: DataFrame, order: list, payload: list[str], limit: int = MAX_GROUP) -> DataFrame:
    """(a, b, match_level): pairs among the first ``limit`` facts of each claim key (exact), then of each
    loose key (loose); a pair comes once, exact where both hold.

    ``facts`` has id, claim_key, loose_key, one row per id. Facts with a null key pair with nothing on
    that key. Ties in ``order`` must be broken by the caller (end it with ``id``).
    """
    p = F.struct("id", "claim_key", *[c for c in payload if c not in ("id", "claim_key")])
    exact = _pairs_within(group_heads(facts, "claim_key", order, limit, p), "exact")
    loose = _pairs_within(group_heads(facts, "loose_key", order, limit, p), "loose")
    return exact.unionByName(loose.filter(~F.col("a.claim_key").eqNullSafe(F.col("b.claim_key"))))


def candidates_for_facts(
    facts: DataFrame, order: list[str], visible_by: list[str], limit: int = MAX_GROUP, leaky_truncation: bool = True
) -> DataFrame:
    """(id, other_id, match_level): for each fact, its first ``limit`` exact and first ``limit`` loose peers
    among the facts visible to it (``visible_by`` not later than its own; ``order`` must start with it).

    With ``leaky_truncation`` the loose list excludes only the exact peers that were returned, so exact
    peers beyond the limit come back as loose; without it every exact peer is excluded.
    """
    vis = F.struct(*visible_by)
    p = F.struct(F.col("id"), F.col("claim_key"), vis.alias("vis"))
    f = facts.select("id", "claim_key", "loose_key", vis.alias("vis"))
    exact = group_heads(facts, "claim_key", order, limit + 1, p).withColumnRenamed("heads", "eh")
    loose = group_heads(facts, "loose_key", order, 2 * limit + 1, p) if leaky_truncation else spread_heads(facts, order, limit, p)
    loose = loose.withColumnRenamed("heads", "lh")
    # a hot key's facts, each with its heads, are spread over salts
    j = salted_join(salted_join(f, exact, "claim_key", "left", spread="id"), loose, "loose_key", "left", spread="id")
    empty = F.array().cast("array<string>")

    def others(heads: str) -> Column:
        return F.filter(F.col(heads), lambda h: (h["id"] != F.col("id")) & (h["vis"] <= F.col("vis")))

    j = j.withColumn("e", F.coalesce(F.transform(F.slice(others("eh"), 1, limit), lambda h: h["id"]), empty))
    if leaky_truncation:
        keep = F.filter(others("lh"), lambda h: ~F.array_contains(F.col("e"), h["id"]))
    else:
        keep = F.filter(others("lh"), lambda h: ~h["claim_key"].eqNullSafe(F.col("claim_key")))
    j = j.withColumn("l", F.coalesce(F.transform(F.slice(keep, 1, limit), lambda h: h["id"]), empty))
    tagged = F.concat(
        F.transform("e", lambda x: F.struct(x.alias("other_id"), F.lit("exact").alias("match_level"))),
        F.transform("l", lambda x: F.struct(x.alias("other_id"), F.lit("loose").alias("match_level"))),
    )
    return j.select("id", F.inline(tagged))


def unordered_pairs(pairs: DataFrame, a: str = "id", b: str = "other_id") -> DataFrame:
    """One row per unordered pair; exact wins over loose; pairs with a null or with itself are dropped."""
    p = pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a_id"), F.greatest(a, b).alias("b_id"), "match_level")
    return p.groupBy("a_id", "b_id").agg(F.min("match_level").alias("match_level"))


def without_related(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs that no stored relation covers, whichever way round it was stored."""
    done = relations.select(F.least("fact_a_id", "fact_b_id").alias("a_id"), F.greatest("fact_a_id", "fact_b_id").alias("b_id"))
    return pairs.join(done.distinct(), ["a_id", "b_id"], "left_anti")
