"""Narration and adjudication by a pluggable provider, with a cache; verdicts stay the rules'."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.keys import pair_id
from .schema import REASON_CODES, RELATION_TYPES
from .session import cut

#: prompt -> text; raising, or an empty text, means failure.
Provider = Callable[[str], str]
DEFAULT_WAIT = 60.0
WORKERS = 4


def retry_seconds(message: Column) -> Column:
    """The wait that a message asks for ("try again in 1h2m3.5s", "432ms"); none gives the default."""
    hint = F.regexp_extract(message, r"(?i)try again in\s+((?:\d+h)?(?:\d+m(?!s))?(?:[\d.]+s)?(?:\d+ms)?)", 1)
    part = lambda p: F.nullif(F.regexp_extract(hint, p, 1), F.lit("")).try_cast("double")
    h, m, s, ms = part(r"(?i)(\d+)h"), part(r"(?i)(\d+)m(?!s)"), part(r"(?i)([\d.]+)s"), part(r"(?i)(\d+)ms")
    total = F.coalesce(h, F.lit(0.0)) * 3600 + F.coalesce(m, F.lit(0.0)) * 60 + F.coalesce(s, F.lit(0.0)) + F.coalesce(ms, F.lit(0.0)) / 1000
    return F.when(F.coalesce(h, m, s, ms).isNull(), F.lit(DEFAULT_WAIT)).otherwise(total)


def daily_quota(message: Column, quotas: Column | None = None) -> Column:
    """Whether a refusal is for the day: by the unit in its message, or by the id of a quota (array of strings)."""
    by_id = F.coalesce(F.exists(quotas, lambda q: F.lower(q).contains("day")), F.lit(False)) if quotas is not None else F.lit(False)
    return by_id | message.rlike(r"(?i)\b(?:requests|tokens)\s+per\s+day\b|\((?:rpd|tpd)\)")


def cached(requests: DataFrame, cache: DataFrame, provider: Provider, workers: int = WORKERS) -> DataFrame:
    """(key, answer, error) for ``requests(key, prompt)``: from ``cache(key, answer)`` where it holds the key, else
    from the provider, at most ``workers`` calls at a time. A failed call has a null answer and its error."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["key"], pdf["prompt"]):
                try:
                    answer = provider(prompt)
                    rows.append((key, answer or None, None if answer else "empty answer"))
                except Exception as e:  # one failed call must not fail the others
                    rows.append((key, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    r = requests.dropDuplicates(["key"])
    known = r.select("key").join(cache.select("key", "answer"), "key").select("key", "answer", F.lit(None).cast("string").alias("error"))
    asked = r.join(cache, "key", "left_anti").repartition(workers).mapInPandas(ask, "key string, answer string, error string")
    return known.unionByName(asked)


def answered(requests: DataFrame, store: str, provider: Provider, workers: int = WORKERS) -> DataFrame:
    """``cached`` with its cache in the parquet folder ``store``: what the provider answers is stored there before it is
    returned, so no request is paid for twice; failures are not stored and are asked again next time."""
    spark = requests.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    schema = "key string, answer string"
    known = spark.read.schema(schema).parquet(store) if there else spark.createDataFrame([], schema)
    r = requests.dropDuplicates(["key"])
    got = cut(cached(r.join(known, "key", "left_anti"), known.limit(0), provider, workers))
    got.filter("answer is not null").select("key", "answer").write.mode("append").parquet(store)
    old = known.dropDuplicates(["key"]).join(r.select("key"), "key", "left_semi").select("key", "answer", F.lit(None).cast("string").alias("error"))
    # a copy of what was there before the append: the folder has grown
    new = got.select("key").withColumn("_new", F.lit(True))
    return old.join(new, "key", "left_anti").unionByName(got)


def narrate(relations: DataFrame, cache: DataFrame | str, provider: Provider, prompt: Column, version: str = "v1") -> DataFrame:
    """``relations`` with the provider's explanation; type, reason, confidence and adjudicator are not touched.
    A failure leaves the explanation null and ``explanation_pending`` true. ``cache`` is a table of answers, or the
    folder of one, in which new answers are stored."""
    r = relations.withColumn("_key", pair_id(F.col("fact_a_id"), F.col("fact_b_id"), F.lit(version)))
    asked = r.select(F.col("_key").alias("key"), prompt.alias("prompt"))
    got = answered(asked, cache, provider) if isinstance(cache, str) else cached(asked, cache, provider)
    j = r.join(got.select(F.col("key").alias("_key"), "answer"), "_key", "left")
    return j.withColumns({"explanation": F.col("answer"), "explanation_pending": F.col("answer").isNull()}).drop("_key", "answer")


def facts_in_words(side: str) -> Column:
    """One fact of a relation's detail (columns a_... or b_...) as lines of a prompt."""
    named = [("Subject", "subject_surface_form"), ("Measure", "measure_surface_form"), ("Value", "value_raw"), ("Quote", "quote")]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(f"{side}_{c}").cast("string"), F.lit("unstated"))) for label, c in named])


def explanation_prompt() -> Column:
    """The request to explain a settled verdict, over ``ledger.relation_detail`` with the columns of ``facts_in_words``."""
    verdict = F.concat_ws(" / ", "type", "reason_code")
    ask = "Explain in at most two sentences why this settled verdict holds, from the two quotes alone. The verdict itself is not to be changed."
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Verdict: "), verdict), F.concat(F.lit("First fact\n"), facts_in_words("a")), F.concat(F.lit("Second fact\n"), facts_in_words("b")))


def adjudicated(relations: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdicts from ``answers(key pair ids fact_a_id, fact_b_id, type, reason_code, explanation)``: only those inside
    the closed vocabularies are taken, marked ``llm`` and without a delta; others leave the rule's verdict."""
    ok = answers.filter(F.col("type").isin(RELATION_TYPES) & F.col("reason_code").isin(REASON_CODES))
    a = ok.select(F.least("fact_a_id", "fact_b_id").alias("_a"), F.greatest("fact_a_id", "fact_b_id").alias("_b"), F.col("type").alias("_t"), F.col("reason_code").alias("_r"), F.col("explanation").alias("_e"))
    on = (F.least("fact_a_id", "fact_b_id") == F.col("_a")) & (F.greatest("fact_a_id", "fact_b_id") == F.col("_b"))
    j = relations.join(a.dropDuplicates(["_a", "_b"]), on, "left")
    hit = F.col("_t").isNotNull()
    out = {"type": F.coalesce("_t", "type"), "reason_code": F.coalesce("_r", "reason_code"), "explanation": F.coalesce("_e", "explanation"), "adjudicator": F.when(hit, "llm").otherwise(F.col("adjudicator"))}
    if "delta" in relations.columns:
        out["delta"] = F.when(~hit, F.col("delta"))
    return j.withColumns(out).drop("_a", "_b", "_t", "_r", "_e")
