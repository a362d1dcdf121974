"""Session helper: settings the engine relies on, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Set on sessions built here. On a cluster the submitter's own values win (see ``get_session``).
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword ``conf`` uses ``_`` for ``.`` in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local folder only where it is unset (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix=f"factloom-{os.getpid()}-"))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: lineage is cut in the shared folder, so lost executors do no harm."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder beside the checkpoints, which all executors share; it is removed at the end."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/work-{uuid.uuid4().hex}"
    try:
        yield base
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def written(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that cuts lineage by a table in the shared folder, for loops of joins: a checkpoint keeps the
    estimated size of its plan, which a loop multiplies until planning takes longer than the work, while a
    table has the size of its files. The tables are removed at the end: what leaves must be ``cut``."""
    with shared_folder(spark) as base:
        n = 0

        def keep(df: DataFrame) -> DataFrame:
            nonlocal n
            n += 1
            df.write.parquet(f"{base}/{n}")
            return spark.read.schema(df.schema).parquet(f"{base}/{n}")

        yield keep
