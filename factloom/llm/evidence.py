"""Quotes and the blocks they cite, in one form of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unify import unify, unify_both


def cited(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, quote, text): each fact that has a quote with its block; repeats of a fact stay."""
    b = blocks.select(F.concat("doc_id", F.lit(":p"), "page_no", F.lit(":b"), "block_no").alias("block_id"), "text")
    # a block that very many facts cite is split by AQE, as both sides are sorted and joined
    return facts.filter("quote is not null and id is not null").select("id", "block_id", "quote").join(b, "block_id").select("id", "quote", "text")


def disguised_quotes(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id): facts whose quote is no substring of its block and is one once both are in one form.

    Facts without a quote or a block are left out, as are quotes of only invisible characters. A fact or
    block that comes twice gives one row.
    """
    rest = cited(facts, blocks).filter(~F.contains("text", "quote"))
    seen = rest.select("id", unify_both("quote", "text").alias("u"))
    return seen.filter((F.trim("u.a") != "") & F.contains("u.b", "u.a")).select("id").distinct()


def unified_texts(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(kind, key, text): every quote and every block text in one form."""
    quotes = facts.filter("id is not null").select(F.lit("quote").alias("kind"), F.col("id").alias("key"), F.col("quote").alias("text"))
    texts = blocks.select(F.lit("block"), F.concat("doc_id", F.lit(":p"), "page_no", F.lit(":b"), "block_no"), "text")
    return quotes.union(texts).withColumn("text", unify("text"))
