"""The ledger as parquet tables: append-only writes that ignore what is there, and its query functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import with_keys
from ..operators.reconcile import SIDE
from ..schema import RELATION_TYPES


def insert_ignore(new: DataFrame, existing: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """The rows of ``new`` to append: none whose key exists, one per key (the first by ``order``)."""
    fresh = new.join(existing.select(*keys).distinct(), keys, "left_anti")
    if order is None:
        return fresh.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return fresh.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ordered_pair(relations: DataFrame) -> DataFrame:
    """Relations stored with the smaller fact id first; the delta keeps its sign as computed."""
    return relations.withColumns({"fact_a_id": F.least("fact_a_id", "fact_b_id"), "fact_b_id": F.greatest("fact_a_id", "fact_b_id")})


class Ledger:
    """Tables under one folder. Writes append; a retried batch adds nothing."""

    TABLES = {"documents": ["doc_id"], "facts": ["id"], "quarantined": ["id"], "relations": ["fact_a_id", "fact_b_id"], "keys": ["id"]}
    #: Columns of a fact that linking and reconciling read, worked out once when it is first seen.
    KEYS = [*SIDE, "claim_key", "loose_key"]
    #: The folder of keys is laid out by a hash of the loose key, so a batch reads the parts its keys are in.
    PARTS = 64

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(name)) if self.exists(name) else None

    def append(self, name: str, rows: DataFrame, order: list | None = None) -> None:
        if name == "relations":
            rows = ordered_pair(rows)
        keys = self.TABLES[name]
        old = self.read(name)
        if name == "facts":
            if not {"claim_key", "subject_id"} <= set(rows.columns):
                rows = with_keys(rows)
            rows = rows.drop("subject_id", "measure_key", "period_start", "period_end", "consolidation", "geography", "modality")
        out = insert_ignore(rows.select(*self.KEYS) if name == "keys" else rows, old if old is not None else rows.limit(0), keys, order)
        if name == "keys":
            stored = self.read("facts")
            if old is None and stored is not None:  # a ledger from before keys were kept
                out = out.unionByName(with_keys(stored).select(*self.KEYS).join(out.select("id"), "id", "left_anti"))
            # one file for each part of a batch, and more for one that a hot key fills
            out = out.withColumn("part", self.part()).hint("rebalance", "part")
            out.write.mode("append").partitionBy("part").parquet(self.path(name))
        else:
            out.write.mode("append").parquet(self.path(name))

    @classmethod
    def part(cls) -> Column:
        return F.pmod(F.xxhash64("loose_key"), F.lit(cls.PARTS)).cast("int")

    def keys(self, new: DataFrame) -> DataFrame | None:
        """Stored keys of facts that may pair with those of ``new(loose_key)``: facts of one claim key share their
        loose key, so only the parts of the new loose keys are read. A ledger without keys works them out."""
        stored = self.read("keys")
        if stored is None:
            old = self.read("facts")
            return None if old is None else with_keys(old).select(*self.KEYS)
        near = F.broadcast(new.select(self.part().alias("part")).distinct())  # PARTS rows at most
        return stored.join(near, "part", "left_semi").select(*self.KEYS)

    def get(self, name: str, key: str) -> DataFrame | None:
        """The row with this id (point lookup by the table's own key); no row where it is unknown."""
        rows = self.read(name)
        return None if rows is None else rows.filter(F.col("id" if name == "relations" else self.TABLES[name][0]) == key)

    def of_document(self, name: str, doc_id: str) -> DataFrame | None:
        """Facts or quarantined proposals of one document."""
        rows = self.read(name)
        return None if rows is None else rows.filter(F.col("doc_id") == doc_id)


def _like(needle: str) -> str:
    """The needle inside LIKE; its ``%`` and ``_`` stay wildcards, a backslash is literal."""
    return "%" + needle.lower() + "%"


def query_facts(facts: DataFrame, doc_id: str | None = None, subject: str | None = None, measure: str | None = None, limit: int = 500) -> DataFrame:
    """Facts by document and by part of a subject's or measure's id or wording; the first ``limit`` by id."""
    f = facts
    if doc_id is not None:
        f = f.filter(F.col("doc_id") == doc_id)
    for side, needle in (("subject", subject), ("measure", measure)):
        if needle is not None:
            hit = [f"lower({side}_{c}) LIKE :n ESCAPE '\x01'" for c in ("canonical_id", "surface_form")]
            f = f.filter(F.expr(" OR ".join(hit).replace(":n", "'" + _like(needle).replace("\\", "\\\\").replace("'", "\\'") + "'")))
    return f.orderBy("id").limit(limit)


def query_relations(relations: DataFrame, type: str | None = None, reason_code: str | None = None, limit: int = 500) -> DataFrame:
    r = relations
    if type is not None:
        r = r.filter(F.col("type") == type)
    if reason_code is not None:
        r = r.filter(F.col("reason_code") == reason_code)
    return r.orderBy("id").limit(limit)


def relation_detail(relations: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Relations with the named columns of both facts, as a_... and b_...; relations of unknown facts drop out."""
    a = facts.select(*[F.col(c).alias(f"a_{c}") for c in columns], F.col("id").alias("fact_a_id"))
    b = facts.select(*[F.col(c).alias(f"b_{c}") for c in columns], F.col("id").alias("fact_b_id"))
    return relations.join(a, "fact_a_id").join(b, "fact_b_id")


def relations_by_doc(relations: DataFrame, facts: DataFrame, doc_id: str) -> DataFrame:
    """Relations with a fact of the document on either side: two semi-joins instead of an OR join."""
    own = facts.filter(F.col("doc_id") == doc_id).select("id")
    a = relations.join(own, relations["fact_a_id"] == own["id"], "left_semi")
    b = relations.join(own, relations["fact_b_id"] == own["id"], "left_semi")
    return a.unionByName(b).distinct() if not any(t.startswith("map") for _, t in relations.dtypes) else a.unionByName(b).dropDuplicates(["id"])


def relations_by_type(relations: DataFrame) -> DataFrame:
    """Counts of all five types, also of those that do not occur."""
    types = relations.sparkSession.createDataFrame([(t,) for t in RELATION_TYPES], "type string")
    counts = relations.filter("type is not null").groupBy("type").agg(F.count("*").alias("n"))
    return types.join(counts, "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
