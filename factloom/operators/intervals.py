"""Continuous periods and gaps of each key's intervals, by keyed disjoint-interval maps.

An ``IntervalMap`` is the keyed state: ordered disjoint intervals; an insertion finds its overlaps by
binary search and merges them. In batch, every task first keeps the maps of the keys it meets and
sends only their merged intervals into the shuffle (so a hot key arrives as at most one interval per
two days and task), then the maps of one key are merged. ``streaming/intervals.py`` keeps the same map
in a stream's state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unbounded ends, in days.
LOW, HIGH = -(2**31), 2**31 - 1
#: Intervals that a task keeps before it sends the maps on; bounds the memory of the first step.
FLUSH = 200_000


class IntervalMap:
    """Ordered disjoint half-open intervals of whole days; touching intervals are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> int:
        """Insert [start, end); returns the change in the number of intervals. An end not after its start is ignored."""
        if end <= start:
            return 0
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]
        return 1 - (j - i)

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


def _keyed(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(k, s, e) in days; intervals with both ends null, or an end not after its start, are none."""
    epoch = F.lit("1970-01-01").cast("date")
    s = F.coalesce(F.datediff(F.col(start), epoch), F.lit(LOW))
    e = F.coalesce(F.datediff(F.col(end), epoch), F.lit(HIGH))
    has = F.col(key).isNotNull() & (F.col(start).isNotNull() | F.col(end).isNotNull())
    return df.filter(has).select(F.col(key).alias("k"), s.alias("s"), e.alias("e")).filter("s < e")


def _fold_batch(maps: dict[str, IntervalMap], pdf: pd.DataFrame) -> int:
    grown = 0
    for k, s, e in zip(pdf["k"].to_numpy(), pdf["s"].tolist(), pdf["e"].tolist()):
        m = maps.get(k)
        if m is None:
            m = maps[k] = IntervalMap()
        grown += m.insert(s, e)
    return grown


def _frame(maps: dict[str, IntervalMap]) -> pd.DataFrame:
    n = np.fromiter((len(m.starts) for m in maps.values()), dtype=np.int64, count=len(maps))
    keys = np.repeat(np.array(list(maps), dtype=object), n)
    s = np.fromiter((x for m in maps.values() for x in m.starts), dtype=np.int64, count=int(n.sum()))
    e = np.fromiter((x for m in maps.values() for x in m.ends), dtype=np.int64, count=int(n.sum()))
    return pd.DataFrame({"k": keys, "s": s.astype("int32"), "e": e.astype("int32")})


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    maps: dict[str, IntervalMap] = {}
    held = 0
    for pdf in batches:
        held += _fold_batch(maps, pdf)
        if held > FLUSH:
            yield _frame(maps)
            maps, held = {}, 0
    if maps:
        yield _frame(maps)


def _final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive ordered by key: the map of a key is complete when the next key begins."""
    maps: dict[str, IntervalMap] = {}
    for pdf in batches:
        last = pdf["k"].iloc[-1] if len(pdf) else None
        _fold_batch(maps, pdf)
        if len(maps) > 1:
            open_map = maps.pop(last)
            yield _frame(maps)
            maps = {last: open_map}
    if maps:
        yield _frame(maps)


def merged_per_task(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(k, s, e) in days: each task's intervals, merged per key."""
    return _keyed(df, key, start, end).mapInPandas(_partial, "k string, s int, e int")


def periods(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, period_start, period_end): the maximal continuous stretches of each key.

    Half-open, null = unbounded. Null keys, intervals with both ends null and intervals with an end not
    after their start are left out. Repeated and nested intervals change nothing; an empty table gives
    no rows. Other columns are ignored.
    """
    merged = merged_per_task(df, key, start, end)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = merged.repartition(n, "k").sortWithinPartitions("k").mapInPandas(_final, "k string, s int, e int")
    day = lambda c, none: F.when(F.col(c) != none, F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)))
    return done.select(F.col("k").alias(key), day("s", LOW).alias("period_start"), day("e", HIGH).alias("period_end"))


def _gap_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gaps between neighbouring rows of one key; the last row of a batch is carried over."""
    carry: pd.DataFrame | None = None
    for pdf in _final(batches):
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k, s, e = pdf["k"].to_numpy(), pdf["s"].to_numpy(), pdf["e"].to_numpy()
        same = k[1:] == k[:-1]
        yield pd.DataFrame({"k": k[1:][same], "s": e[:-1][same], "e": s[1:][same]})
        carry = pdf.iloc[-1:]


def gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, gap_start, gap_end): the stretches between a key's intervals that none covers, as
    ``yyyy-MM-dd``. Touching intervals leave no gap; a key with one period has none. See ``periods``."""
    merged = merged_per_task(df, key, start, end)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = merged.repartition(n, "k").sortWithinPartitions("k").mapInPandas(_gap_rows, "k string, s int, e int")
    day = lambda c: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)), "yyyy-MM-dd")
    return out.select(F.col("k").alias(key), day("s").alias("gap_start"), day("e").alias("gap_end"))
