"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 128
#: Salts of a hot key at least; more where the session shuffles into more partitions.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", spread: str | None = None, salts: int | None = None) -> DataFrame:
    """``left.join(right, key, how)`` (inner or left) where ``left`` may be skewed on ``key``.

    Hot keys are found by a pre-aggregated count; fewer than HOT_SHARE of them exist at any size, so
    the list is broadcast. Their left rows get one of ``salts`` salts (as many as shuffle partitions,
    SALTS at least, unless given) from the hash of ``spread`` (the whole row where none is given) and the matching right rows are repeated once per salt; all other
    rows have salt 0. Null keys never match. Clashing names other than ``key`` must be renamed before.
    """
    if salts is None:
        salts = max(SALTS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    hot = counts.filter(F.col("count") * HOT_SHARE > total).select(F.col(key).alias("_k"), F.lit(True).alias("_hot"))
    mark = lambda df: df.join(F.broadcast(hot), df[key].eqNullSafe(F.col("_k")), "left").drop("_k")
    row_hash = F.xxhash64(F.col(spread)) if spread else F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")])
    lhs = mark(left).withColumn("_salt", F.when(F.col("_hot"), F.pmod(row_hash, F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    rhs = mark(right).withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return lhs.join(rhs, [key, "_salt"], how).drop("_salt")
