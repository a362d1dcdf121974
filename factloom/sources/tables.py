"""Readers of the ledger's tables and of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def facts(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Facts, one row per id (rows that repeat an id have the same content). Only the named columns are
    scanned; rows without an id are kept once each by their content."""
    df = table(spark, root, "facts")
    if columns:
        df = df.select("id", *[c for c in columns if c != "id"])
    return df.dropDuplicates(["id"])


def blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks, one row per (doc_id, page_no, block_no); of rows that repeat a key one is kept."""
    return table(spark, root, "blocks").dropDuplicates(["doc_id", "page_no", "block_no"])


def block_id(doc_id: str = "doc_id", page_no: str = "page_no", block_no: str = "block_no"):
    return F.concat(F.col(doc_id), F.lit(":p"), F.col(page_no).cast("string"), F.lit(":b"), F.col(block_no).cast("string"))
