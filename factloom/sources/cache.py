"""Result cache by content: requests whose answer is stored are not asked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_key(*parts: Column) -> Column:
    """Content key of a request: the hash of its parts as canonical JSON (struct fields in a fixed order)."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i:02}") for i, p in enumerate(parts)])), 256)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("key"), "key", "left_anti")


def doc_id_of(path: Column) -> Column:
    """A document's id: the file's name without folder and extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
