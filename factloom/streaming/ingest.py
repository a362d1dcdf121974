"""Incremental ingestion: new fact files are linked against the ledger and only new pairs are reconciled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import pair_id, with_keys
from ..operators import link, reconcile
from ..operators.ledger import Ledger
from ..operators.skew import salted_join
from ..schema import FACTS
from ..session import cut


#: (stage, data) of an ingestion's progress.
Notify = Callable[[str, dict], None]


def new_pairs(new: DataFrame, store: DataFrame, limit: int = link.MAX_GROUP) -> DataFrame:
    """(a, b, match_level) of each new fact with its first peers in the store (new facts included), by key and
    then by looser key, an unordered pair once. Both tables carry the components and keys.

    The exact peers taken are left out of the loose ones before those are cut; exact peers beyond the limit
    come back as loose, as in ``link.candidates_for_facts``. A hot key's facts meet its heads in salts."""
    payload = F.struct(*reconcile.SIDE, "claim_key")
    order = ["doc_id", "id"]
    n = new.select(payload.alias("x"), F.col("id").alias("_id"), "claim_key", "loose_key")
    other = F.filter("heads", lambda h: h["id"] != F.col("x.id"))
    # facts of one claim key share their loose key, so the exact peers taken are the first of the claim key here too
    taken = F.transform(F.slice(F.filter(other, lambda h: h["claim_key"].eqNullSafe(F.col("x.claim_key"))), 1, limit), lambda h: h["id"])
    out = None
    for level, key, most in (("exact", "claim_key", limit + 1), ("loose", "loose_key", 2 * limit + 1)):
        heads = link.group_heads(store.join(new.select(key).distinct(), key, "left_semi"), key, order, most, payload)
        p = salted_join(n, heads, key, spread="_id")
        if level == "loose":
            p = p.withColumn("taken", taken)
            mine = F.slice(F.filter(other, lambda h: ~F.array_contains(F.col("taken"), h["id"])), 1, limit)
        else:
            mine = F.slice(other, 1, limit)
        p = p.select("x", F.explode(mine).alias("y"), F.lit(level).alias("match_level"))
        out = p if out is None else out.unionByName(p)
    swap = F.col("x.id") > F.col("y.id")
    p = out.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), "match_level")
    w = Window.partitionBy("a.id", "b.id").orderBy("match_level")
    return p.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ingest_batch(ledger: Ledger, batch: DataFrame, batch_id: int = 0, notify: Notify | None = None) -> None:
    """One micro-batch: link and reconcile the facts that are not stored yet, then store them.

    Replaying a batch changes nothing, wherever it broke off: relations are written first, the facts last,
    so facts that are stored have all their relations, and a replay works out again whatever the stored
    facts do not vouch for. All three appends ignore what is there (ids are content ids). Rows without an
    id are left out; of repeated ids one is kept. ``notify(stage, data)`` hears of the stages ``started``,
    ``already_ingested``, ``candidates_found``, ``facts_persisted``, ``done`` and ``error``, each with the batch's
    number; what it raises stops the batch."""
    tell = notify or (lambda stage, data: None)
    try:
        tell("started", {"batch": batch_id})
        seen = ledger.read("facts")
        fresh = batch.filter("id is not null").dropDuplicates(["id"])
        if seen is not None:
            fresh = fresh.join(seen.select("id"), "id", "left_anti")
        # fixed before the appends below, which would otherwise make their own rows look already stored
        fresh = cut(with_keys(fresh))
        count = fresh.count()
        if not count:
            tell("already_ingested", {"batch": batch_id})
            return
        new = fresh.select(*Ledger.KEYS)
        store = ledger.keys(new)
        whole = new if store is None else store.join(new.select("id"), "id", "left_anti").unionByName(new)
        r = reconcile.reconcile(new_pairs(new, whole)).select(
            pair_id(F.col("a.id"), F.col("b.id")).alias("id"), F.col("a.id").alias("fact_a_id"), F.col("b.id").alias("fact_b_id"),
            "type", "reason_code", "explanation", F.lit(False).alias("explanation_pending"), "caveat", "delta", "confidence", "adjudicator",
        )
        r = cut(r)
        by_type = {x["type"]: x["count"] for x in r.groupBy("type").count().collect()}
        tell("candidates_found", {"batch": batch_id, "count": sum(by_type.values())})
        ledger.append("relations", r, ["id"])
        ledger.append("keys", new)
        ledger.append("facts", fresh)
        tell("facts_persisted", {"batch": batch_id, "count": count})
        tell("done", {"batch": batch_id, "facts": count, "relations_by_type": by_type})
    except Exception as e:
        tell("error", {"batch": batch_id, "message": str(e)})
        raise


def ingest_stream(spark: SparkSession, source: str, ledger: Ledger, checkpoint: str, notify: Notify | None = None) -> StreamingQuery:
    """Facts from parquet files dropped into ``source``, until all that are there are ingested."""
    stream = spark.readStream.schema(FACTS).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, i: ingest_batch(ledger, df, i, notify)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fiscal_quarters(events: DataFrame, ts: str, late: str = "1 day") -> DataFrame:
    """Streaming counts per fiscal quarter (April start) with a watermark; append mode emits closed days."""
    day = F.window(ts, "1 day")
    e = events.withWatermark(ts, late).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    shifted = F.add_months(F.to_date(F.col("window.start")), -3)
    return e.select(F.year(shifted).alias("fiscal_year"), F.quarter(shifted).alias("quarter"), F.to_date(F.col("window.start")).alias("day"), "event_type", "n", "total")
