"""Continuous periods and gaps in a stream: each key's ordered disjoint-interval map is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import IntervalMap, _keyed, merged_per_task
from ..session import cut, shared_folder


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*map(list, state.get)) if state.exists else IntervalMap()
    for pdf in batches:
        for s, e in zip(pdf["s"].tolist(), pdf["e"].tolist()):
            m.insert(s, e)
    state.update((m.starts, m.ends))
    gaps = m.gaps()
    yield pd.DataFrame({"k": [key[0]], "periods": [len(m.starts)], "gap_starts": [[g[0] for g in gaps]], "gap_ends": [[g[1] for g in gaps]]})


def stream_gaps(stream: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, periods, gap_starts, gap_ends) of every key that a micro-batch touched, gaps in days since 1970.

    The state of a key is its merged intervals only. Intervals are taken as in ``operators.intervals``.
    """
    return _by_state(_keyed(stream, key, start, end)).withColumnRenamed("k", key)


def _by_state(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("k").applyInPandasWithState(
        _update, "k string, periods int, gap_starts array<int>, gap_ends array<int>", "starts array<int>, ends array<int>", "update", GroupStateTimeout.NoTimeout
    )


def gaps_through_state(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, gap_start, gap_end) as ``operators.intervals.gaps`` gives them, through the keyed state: the intervals,
    merged per task before the shuffle so that a hot key arrives as few, are streamed into the keys' maps until
    none is left; a key's last gaps hold. The stream's folders lie in the shared checkpoint folder and are removed."""
    with shared_folder(df.sparkSession) as base:
        merged_per_task(df, key, start, end).write.parquet(base + "/in")
        stream = df.sparkSession.readStream.schema("k string, s int, e int").parquet(base + "/in")

        def keep(gaps: DataFrame, n: int) -> None:
            # a batch that is done again writes the same file anew
            gaps.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

        _by_state(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", base + "/state").trigger(availableNow=True).start().awaitTermination()
        if not df.sparkSession.read.parquet(base + "/in").head(1):
            last = df.sparkSession.createDataFrame([], "k string, gap_starts array<int>, gap_ends array<int>")
        else:
            out = df.sparkSession.read.schema("k string, periods int, gap_starts array<int>, gap_ends array<int>, batch long").parquet(base + "/out")
            last = out.withColumn("_rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("batch")))).filter("_rn = 1")
        day = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)), "yyyy-MM-dd")
        gaps = last.select("k", F.inline(F.arrays_zip(F.col("gap_starts").alias("s"), F.col("gap_ends").alias("e"))))
        return cut(gaps.select(F.col("k").alias(key), day("s").alias("gap_start"), day("e").alias("gap_end")))
