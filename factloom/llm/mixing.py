"""Sources mixed to target shares of tokens by Poisson replication.

A document of source s is repeated min(K, cap) times, K Poisson with the mean at which the source meets
its share; K is read off the inverse distribution at a number hashed from the seed and the document's
id, so a rerun, a lost executor or another partitioning gives the same mix. The means are found from
one pass over token counts per source, and then set by a second pass that adds up the tokens that a
grid of means near each would really give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GRID = 41


def count_tokens(c: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of a whole text under a public byte-level BPE vocabulary; null and empty texts have none."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        for texts in batches:
            known = texts.fillna("")
            yield pd.Series([len(x) for x in enc.encode_ordinary_batch(known.to_list(), num_threads=1)], dtype="int64")

    return run(c)


def capped_mean(lam: float, cap: int) -> float:
    """Mean of min(K, cap), K Poisson with mean ``lam``."""
    p = math.exp(-lam)
    below = total = 0.0
    for k in range(cap):
        below += p
        total += k * p
        p *= lam / (k + 1)
    return total + cap * (1 - below)


def rate_for(mean: float, cap: int) -> float:
    """The Poisson mean at which ``capped_mean`` is ``mean`` (below ``cap``)."""
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return (lo + hi) / 2


def cdf(lam: float, cap: int) -> list[float]:
    """P(K <= k) for k = 0 .. cap-1."""
    p, out, total = math.exp(-lam), [], 0.0
    for k in range(cap):
        total += p
        out.append(total)
        p *= lam / (k + 1)
    return out


def _uniform(doc_id: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") / float(1 << 53)


def _copies(u: Column, steps: Column) -> Column:
    """min(K, cap) by inversion: how many steps of the distribution lie at or below ``u``."""
    return F.size(F.filter(steps, lambda s: u >= s))


def plan(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, fill: float = 0.9, seed: int = 7, path: str = TOKENIZER) -> tuple[list[dict], DataFrame]:
    """Per target source its Poisson mean and distribution steps; and the counted documents (doc_id, source, n)."""
    t = [r.asDict() for r in targets.filter("source is not null and target_share > 0 and max_repeats >= 1").dropDuplicates(["source"]).collect()]
    counted = cut(docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").select("doc_id", "source", count_tokens("text", path).alias("n")))
    have = {r["source"]: r["n"] or 0 for r in counted.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    t = [x for x in t if have.get(x["source"], 0) > 0]
    whole = sum(x["target_share"] for x in t)
    if not t:
        return [], counted
    # the largest mix in which every source keeps its share below its cap
    most = min(x["max_repeats"] * have[x["source"]] * whole / x["target_share"] for x in t) * fill
    total = min(most, total_tokens) if total_tokens else most
    grid = []
    for x in t:
        x["goal"] = total * x["target_share"] / whole
        lam = rate_for(x["goal"] / have[x["source"]], x["max_repeats"])
        x["grid"] = [lam * float(f) for f in np.linspace(0.9, 1.1, GRID)]
        steps = [cdf(g, x["max_repeats"]) for g in x["grid"]]
        # a mean's mix changes where u passes one of its steps: tokens are added up between all means' steps
        x["edges"] = sorted({s for g in steps for s in g})
        grid.append((x["source"], x["edges"]))
    edges = docs.sparkSession.createDataFrame(grid, "source string, edges array<double>")
    at = F.size(F.filter("edges", lambda e: F.col("u") >= e))
    per = counted.withColumn("u", _uniform(F.col("doc_id"), seed)).join(F.broadcast(edges), "source").groupBy("source", at.alias("at")).agg(F.sum("n").alias("n"))
    held = {(r["source"], r["at"]): r["n"] or 0 for r in per.collect()}
    given = []
    for x in t:
        for i, g in enumerate(x["grid"]):
            steps = cdf(g, x["max_repeats"])
            # behind ``at`` edges u is at least the last of them and below the next
            copies = [sum(s <= e for s in steps) for e in [-1.0, *x["edges"]]]
            given.append({"source": x["source"], "i": i, "tokens": sum(held.get((x["source"], k), 0) * c for k, c in enumerate(copies))})
    for x in t:
        near = min((r for r in given if r["source"] == x["source"]), key=lambda r: (abs(r["tokens"] - x["goal"]), r["i"]))
        x["rate"], x["tokens"] = x["grid"][near["i"]], near["tokens"]
        x["steps"] = cdf(x["rate"], x["max_repeats"])
        del x["edges"]
    return t, counted


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, fill: float = 0.9, seed: int = 7, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, copy_no, text): the mix, shuffled globally.

    Sources that are null or no target are left out; so is a target without tokens, whose share goes to the
    others in proportion. No document comes more than its source's ``max_repeats`` times. The size of the
    mix is ``total_tokens``, or ``fill`` of the largest at which every source can keep its share (a source
    at its very cap could not be Poisson). Documents with equal ids share their number of copies.
    """
    chosen, _ = plan(docs, targets, total_tokens, fill, seed, path)
    steps = docs.sparkSession.createDataFrame([(x["source"], x["steps"]) for x in chosen], "source string, steps array<double>")
    d = docs.select("doc_id", "source", "text").join(F.broadcast(steps), "source")
    n = _copies(_uniform(F.col("doc_id"), seed), F.col("steps"))
    copies = d.withColumn("n", n).filter("n > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "text")
    at = F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("at", at).repartition(parts, "at").sortWithinPartitions("at").drop("at")


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, fill: float = 0.9, seed: int = 7, path: str = TOKENIZER) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, copies, most_repeats): what the mix really holds."""
    chosen, counted = plan(docs, targets, total_tokens, fill, seed, path)
    spark = docs.sparkSession
    steps = spark.createDataFrame([(x["source"], x["target_share"], x["steps"]) for x in chosen], "source string, target_share double, steps array<double>")
    c = counted.join(F.broadcast(steps), "source").withColumn("k", _copies(_uniform(F.col("doc_id"), seed), F.col("steps")))
    g = c.groupBy("source", "target_share").agg(F.sum(F.col("n") * F.col("k")).alias("tokens"), F.count_if(F.col("k") > 0).alias("documents"), F.sum("k").alias("copies"), F.max("k").alias("most_repeats"))
    whole = g.agg(F.sum("tokens")).scalar()
    return g.withColumn("actual_share", F.col("tokens") / whole)
