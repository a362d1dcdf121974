"""Blocks of a filing into batches of fixed capacity, along a space-filling curve.

A block's hashed word vector is projected to three dimensions; its cell's Hilbert index orders the
blocks of a filing so that neighbours are alike. A range sort on (filing, index) cuts the order into
partitions of even size, also within one very large filing; each partition packs its stretch of the
curve. Only the last OPEN batches are open at a time, so a batch holds neighbours of the curve: a block
goes into the fullest of them that still holds it, and where a new one is opened beyond OPEN, the
fullest is closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .unify import slices
from .words import word_hashes

DIMENSIONS, BITS, BUCKETS = 3, 10, 4096
#: Batches open at a time: more of them leave less room, fewer keep nearer neighbours together.
OPEN = 16


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer cells (rows x dimensions, values below 2**bits); Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def curve_keys(texts: pa.Array) -> np.ndarray:
    """The Hilbert index of each text's projected word vector; texts without words are at the middle cell."""
    plane = np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))
    out = []
    for part in slices(texts):
        words, ends = word_hashes(part)
        sums = np.concatenate([np.zeros((1, DIMENSIONS)), np.cumsum(plane[(words % np.uint64(BUCKETS)).astype(np.int64)], axis=0)])
        first = np.concatenate([[0], ends[:-1]])
        n = np.maximum(ends - first, 1)[:, None]
        at = (np.tanh((sums[ends] - sums[first]) / np.sqrt(n)) + 1) / 2
        out.append(hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = curve_keys(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "page_no", "block_no", "n")] + [pa.array(keys, pa.int64())], names=["doc_id", "page_no", "block_no", "n", "hkey"])


class Packer:
    """At most ``most`` open batches as [room, name]; an item goes where it leaves least room, else opens a batch."""

    def __init__(self, capacity: int, most: int = OPEN) -> None:
        self.capacity, self.most, self.open = capacity, most, []

    def put(self, n: int, name: str) -> str:
        """The name of the item's batch, its own where it opens one."""
        best = None
        for batch in self.open:
            if n <= batch[0] and (best is None or batch[0] < best[0]):
                best = batch
        if best is None:
            best = [self.capacity, name]
            self.open.append(best)
            if len(self.open) > self.most:
                # never the new one, which is last and fullest only by being filled below
                self.open.remove(min(self.open[:-1], key=lambda x: x[0]))
        best[0] -= n
        return best[1]


def _pack(profiles: list[tuple[str, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc: object = object()
        packers: dict[str, Packer] = {}
        place = 0
        for pdf in batches:
            rows = []
            for d, page, block, n in zip(pdf["doc_id"], pdf["page_no"], pdf["block_no"], pdf["n"]):
                if d != doc:
                    doc, place, packers = d, 0, {p: Packer(c) for p, c in profiles}
                place += 1
                for p, packer in packers.items():
                    cap = packer.capacity
                    for piece, start in enumerate(range(0, max(n, 1), cap)):
                        size = min(cap, n - start)
                        # a batch is named by the piece that opened it
                        name = packer.put(size, f"{p}:{d}:p{page}:b{block}:{piece}")
                        rows.append((p, d, name, page, block, piece, start, start + size, place))
            yield pd.DataFrame(rows, columns=["profile", "doc_id", "batch_id", "page_no", "block_no", "piece_no", "char_start", "char_end", "place"])

    return run


def batches(blocks: DataFrame, limits: DataFrame, partitions: int | None = None) -> DataFrame:
    """(profile, doc_id, batch_id, page_no, block_no, piece_no, char_start, char_end, place): every block of every
    filing in a batch of each profile of ``limits(profile, capacity_chars)``; ``place`` numbers the blocks of the
    filing's stretch of the curve.

    A batch holds blocks of one filing and at most its capacity. A block is cut only if it alone exceeds
    the capacity: into full pieces and a rest that shares a batch like any block. A block that comes
    twice counts once (the shorter text); null and empty texts take no room and are placed too; blocks
    without a key are left out; limits that are null or below 1 give no batches. The limits are a table of
    a few rows.
    """
    profiles = [(r[0], int(r[1])) for r in limits.filter("profile is not null and capacity_chars >= 1").distinct().orderBy("profile").collect()]
    b = blocks.filter("doc_id is not null and page_no is not null and block_no is not null")
    keyed = b.select("doc_id", "page_no", "block_no", F.coalesce(F.length("text"), F.lit(0)).alias("n"), "text").mapInArrow(
        _keyed, "doc_id string, page_no int, block_no int, n int, hkey long"
    )
    # texts stay where they are: repeats are dropped from lengths and keys; those are worked out once, as the range sort reads them twice
    k = keyed.groupBy("doc_id", "page_no", "block_no").agg(F.min(F.struct("n", "hkey")).alias("x"))
    k = cut(k.select("doc_id", "page_no", "block_no", "x.n", "x.hkey"))
    cols = ["doc_id", "hkey", "page_no", "block_no"]
    n = partitions or int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = k.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    schema = "profile string, doc_id string, batch_id string, page_no int, block_no int, piece_no int, char_start int, char_end int, place int"
    return order.mapInPandas(_pack(profiles), schema)


def room_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(profile, batches, chars, least_batches, fill, stretch): how full the batches are; ``least_batches`` is the sum
    over filings of their characters divided by the capacity, rounded up, which no packing can go below.
    ``stretch`` is the median length of curve from a batch's first to its last block, in its own blocks: 1 where
    a batch holds a piece of the curve without gaps."""
    per_batch = packed.groupBy("profile", "doc_id", "batch_id").agg(
        F.sum(F.col("char_end") - F.col("char_start")).alias("c"), ((F.max("place") - F.min("place") + 1) / F.count_distinct("place")).alias("s")
    )
    per_doc = per_batch.groupBy("profile", "doc_id").agg(F.count("*").alias("b"), F.sum("c").alias("c"))
    j = per_doc.join(F.broadcast(limits.select("profile", "capacity_chars").distinct()), "profile")
    room = j.groupBy("profile").agg(
        F.sum("b").alias("batches"),
        F.sum("c").alias("chars"),
        F.sum(F.greatest(F.ceil(F.col("c") / F.col("capacity_chars")), F.lit(1))).alias("least_batches"),
        (F.sum("c") / F.sum(F.col("b") * F.col("capacity_chars"))).alias("fill"),
    )
    return room.join(per_batch.groupBy("profile").agg(F.percentile_approx("s", 0.5, 1000).alias("stretch")), "profile")
