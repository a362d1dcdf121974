"""Passages of test items inside a corpus: CGK embedding, repeated bit sampling, exact verification.

A passage is a window of words: a whole item, or each stretch of a given length of it. Windows of the
same length of the documents are compared with it. The CGK random walk copies a window into three times
its length, staying on or leaving a word by a random bit of the word: windows at a small edit distance
come out at a small Hamming distance, equal windows equal. Keys of sampled positions, several per walk
and from as many walks as the target recall needs (measured on simulated edits of the same length), are
looked up in the items' sorted keys, and each hit is verified by its exact edit distance in words.
Before that, windows that share too few pairs of neighbouring words with any item to be within the edits
are left out (the q-gram lemma, so none is lost). Documents are read once and never shuffled; the items,
a stated query set, go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .unify import slices
from .words import mix, word_hashes

WINDOW = 13
#: Windows of items that go to the tasks at once (about 8 bytes per key and window).
ITEM_WINDOWS = 1 << 20
#: Windows of documents that are embedded at once in a task.
CHUNK = 1 << 16
#: Positions of the embedding in a key, keys that are sampled from one walk, and walks at most.
SAMPLED, PER_WALK, MOST_WALKS = 5, 4, 64
#: Simulated windows on which the chance of a key to meet is measured.
SIMULATED = 2000
_MULTIPLY = np.uint64(0x2545F4914F6CDD1D)


def embed(words: np.ndarray, starts: np.ndarray, window: int, walk: int) -> np.ndarray:
    """PER_WALK keys of each window (keys x windows): hashes of SAMPLED positions of its CGK embedding each."""
    rng = np.random.default_rng(7919 + walk)
    length = 2 * window  # where a walk stays on every other word it is through by then, and what follows is the same for all
    wanted = np.zeros((PER_WALK, length), bool)
    for k in range(PER_WALK):
        wanted[k, rng.choice(length, min(SAMPLED, length), replace=False)] = True
    last = int(np.flatnonzero(wanted.any(0))[-1])
    with np.errstate(over="ignore"):
        bits = mix(words ^ mix(np.uint64(walk + 1) * np.uint64(0xD1342543DE82EF95)))
        step, sym = np.concatenate([bits, [np.uint64(0)]]), np.concatenate([words, [np.uint64(0)]])
        pad = len(words)
        at = np.zeros(len(starts), np.int64)
        keys = np.repeat(np.arange(PER_WALK, dtype=np.uint64)[:, None] + np.uint64(PER_WALK * walk), len(starts), axis=1)
        for j in range(last + 1):
            inside = at < window
            pos = np.where(inside, starts + at, pad)
            for k in np.flatnonzero(wanted[:, j]):
                keys[k] = mix(keys[k] * _MULTIPLY + sym[pos])
            # every step has a bit of its own: 64 of the word's hash, then of a hash of that
            word_bits = step[pos] if j < 64 else mix(step[pos] + np.uint64(j // 64))
            at += ((word_bits >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) & inside
    return keys


@functools.cache
def walks_for(recall: float, edits: int, window: int) -> int:
    """Walks after which a window with ``edits`` random edits is met with probability ``recall``: the least number at
    which that share of SIMULATED windows, each edited at random places, shares a key with its original."""
    if edits == 0:
        return 1
    rng = np.random.default_rng(31)
    a = rng.integers(1, 1 << 62, (SIMULATED, window), dtype=np.int64).astype(np.uint64)
    b = []
    for row in a:
        r = list(row)
        left = edits
        while left > 0:
            kind = rng.integers(3) if left > 1 else 0
            i = int(rng.integers(window))
            if kind == 0:
                r[i] = np.uint64(rng.integers(1, 1 << 62))
                left -= 1
            elif kind == 1:  # one word more, and the last falls out of the window
                r = (r[:i] + [np.uint64(rng.integers(1, 1 << 62))] + r[i:])[:window]
                left -= 2
            else:
                r = r[:i] + r[i + 1 :] + [np.uint64(rng.integers(1, 1 << 62))]
                left -= 2
        b.append(r)
    words = np.concatenate([a.ravel(), np.array(b, np.uint64).ravel()])
    starts = np.arange(2 * SIMULATED) * window
    met = np.zeros(SIMULATED, bool)
    for walk in range(MOST_WALKS):
        k = embed(words, starts, window, walk)
        met |= (k[:, :SIMULATED] == k[:, SIMULATED:]).any(0)
        if met.mean() >= recall:
            return walk + 1
    raise ValueError(f"{edits} edits in {window} words need more than {MOST_WALKS} walks for a recall of {recall}")


def allowed(edits: float, window: int) -> int:
    """Edits of a window: a number of words, or below 1 a share of its length."""
    return int(edits) if edits >= 1 or edits == 0 else int(edits * window)


@dataclass
class Passages:
    """The items' windows of one length: words, starts and item of each; per walk and key the sorted keys."""

    window: int
    edits: int
    words: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    grams: np.ndarray
    keys: list[list[tuple[np.ndarray, np.ndarray]]]


def _windows(ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within rows, and their rows."""
    first = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    n = np.maximum(ends - first - window + 1, 0)
    rows = np.repeat(np.arange(len(ends)), n)
    stops = np.cumsum(n)
    return np.arange(int(stops[-1]) if len(n) else 0) - np.repeat(stops - n, n) + first[rows], rows


def _grams(words: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbouring words."""
    with np.errstate(over="ignore"):
        return mix(words[:-1] * _MULTIPLY + mix(words[1:])) if len(words) else np.zeros(0, np.uint64)


#: Bits of a hash by which pairs of words are looked up before the exact look.
_TABLE = 20


def _known(grams: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Running count of the pairs that are ``wanted`` (sorted), one longer than ``grams``."""
    hit = np.zeros(len(grams) + 1, np.int64)
    if len(grams) and len(wanted):
        table = np.zeros(1 << _TABLE, bool)
        mask = np.uint64((1 << _TABLE) - 1)
        table[(wanted & mask).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(grams & mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(wanted, grams[maybe]), len(wanted) - 1)
        hit[maybe[wanted[at] == grams[maybe]] + 1] = 1
    return np.cumsum(hit)


def prepare(items: list[tuple[int, str]], window: int | None, edits: float, recall: float) -> list[Passages]:
    """Passages of the items by length: whole items (``window`` None), or all their windows of one length."""
    words, ends = word_hashes(pa.array([t for _, t in items], pa.string()))
    ids = np.array([i for i, _ in items], np.int64)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    grams = _grams(words)
    out = []
    for n in [window] if window else sorted(set((ends - first).tolist()) - {0}):
        if window:
            starts, rows = _windows(ends, n)
        else:
            rows = np.flatnonzero(ends - first == n)
            starts = first[rows]
        if not len(starts):
            continue
        e = allowed(edits, n)
        keys = []
        for walk in range(walks_for(recall, e, n)):
            found = embed(words, starts, n, walk)
            orders = [np.argsort(k, kind="stable") for k in found]
            keys.append([(k[o], o) for k, o in zip(found, orders)])
        mine = np.unique(grams[(starts[:, None] + np.arange(n - 1)).ravel()]) if n > 1 else np.zeros(0, np.uint64)
        out.append(Passages(n, e, words, starts, ids[rows], mine, keys))
    return out


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distance in words of each row of ``x`` to the same row of ``y``, all rows at once."""
    n, m = x.shape[1], y.shape[1]
    prev = np.tile(np.arange(m + 1, dtype=np.int16), (len(x), 1))
    for i in range(n):
        cur = np.empty_like(prev)
        cur[:, 0] = i + 1
        cur[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (y != x[:, i : i + 1]))
        # along the row a cell is at most its left neighbour and one: a running minimum of the cells less their place
        cur = np.minimum.accumulate(cur - np.arange(m + 1, dtype=np.int16), axis=1) + np.arange(m + 1, dtype=np.int16)
        prev = cur
    return prev[:, -1].astype(np.int64)


def _near(words: np.ndarray, ends: np.ndarray, p: Passages, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (starts and rows) that share enough neighbouring pairs with the items: an edit changes two at most."""
    starts, rows = _windows(ends, p.window)
    need = p.window - 1 - 2 * p.edits
    if need <= 0 or not len(starts):
        return starts, rows
    ok = known[starts + p.window - 1] - known[starts] >= need
    return starts[ok], rows[ok]


def _banded(x: np.ndarray, y: np.ndarray, edits: int) -> np.ndarray:
    """Whether so many words of each row of ``x`` stand in ``y`` within ``edits`` places that the rows may be as near as
    that: every word that is not edited does."""
    n = x.shape[1]
    met = x == y
    for d in range(1, edits + 1):
        met[:, d:] |= x[:, d:] == y[:, :-d]
        met[:, :-d] |= x[:, :-d] == y[:, d:]
    return met.sum(axis=1) >= n - edits


def _hits(words: np.ndarray, starts: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into starts, item, edits) of verified windows."""
    at: list[np.ndarray] = []
    win: list[np.ndarray] = []
    span = np.arange(p.window)
    for walk, tables in enumerate(p.keys):
        for k, (keys, order) in zip(embed(words, starts, p.window, walk), tables):
            lo = np.searchsorted(keys, k)
            some = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == k)
            if not len(some):
                continue
            n = np.searchsorted(keys, k[some], side="right") - lo[some]
            stops = np.cumsum(n)
            inner = np.arange(int(stops[-1])) - np.repeat(stops - n, n)
            a, w = np.repeat(some, n), order[np.repeat(lo[some], n) + inner]
            for c in range(0, len(a), CHUNK):
                i, j = a[c : c + CHUNK], w[c : c + CHUNK]
                ok = _banded(words[starts[i][:, None] + span], p.words[p.starts[j][:, None] + span], p.edits)
                at.append(i[ok])
                win.append(j[ok])
    if not at:
        none = np.zeros(0, np.int64)
        return none, none, none
    pair = np.unique(np.concatenate(at) * len(p.starts) + np.concatenate(win))
    a, w = pair // len(p.starts), pair % len(p.starts)
    far = np.zeros(len(a), np.int64)
    for c in range(0, len(a), CHUNK):
        x, y = words[starts[a[c : c + CHUNK]][:, None] + span], p.words[p.starts[w[c : c + CHUNK]][:, None] + span]
        differ = np.flatnonzero((x != y).any(axis=1))
        far[c + differ] = edit_distances(x[differ], y[differ]) if p.edits else 1
    ok = far <= p.edits
    return a[ok], p.item[w[ok]], far[ok]


def _search(passages: list[Passages]):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("windows", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(done, len(part)).to_numpy(zero_copy_only=False)
                done += len(part)
                words, ends = word_hashes(part)
                grams = _grams(words)
                found = []
                for p in passages:
                    starts, rows = _near(words, ends, p, _known(grams, p.grams))
                    for c in range(0, len(starts), CHUNK):
                        a, item, d = _hits(words, starts[c : c + CHUNK], p)
                        found.append(np.stack([rows[c : c + CHUNK][a], item, d]))
                if not found:
                    continue
                f = np.concatenate(found, axis=1)
                if not f.shape[1]:
                    continue
                pairs, inverse, n = np.unique(f[:2], axis=1, return_inverse=True, return_counts=True)
                least = np.full(pairs.shape[1], 1 << 30)
                np.minimum.at(least, inverse.ravel(), f[2])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[pairs[0]], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(least, pa.int32()), pa.array(n, pa.int32())],
                    schema=schema,
                )

    return run


def leaks(docs: DataFrame, items: DataFrame, window: int | None = WINDOW, edits: float = 0, recall: float = 0.95) -> DataFrame:
    """(doc_id, item_id, edits, windows): documents that hold a window of an item with at most ``edits`` words inserted,
    left out or replaced (below 1: a share of the window); the fewest edits and the number of windows met.

    A window is ``window`` words of the item, or the whole item where that is None. Words are runs of letters
    and digits, without case, look-alikes and hidden characters. Equal windows are always met, a window with
    edits with probability ``recall``. Items shorter than the window, documents shorter than that, null texts
    and null ids give no rows. ``docs(doc_id, text)``; repeated documents give repeated rows, repeated items
    count once.
    """
    q = items.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    total = q.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total * PER_WALK * (walks_for(recall, allowed(edits, window), window) if window else MOST_WALKS) / ITEM_WINDOWS))
    d = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for b in range(blocks):
        block = [(r[0], r[1]) for r in q.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()]
        part = d.mapInArrow(_search(prepare(block, window, edits, recall)), "doc_id long, item_id long, edits int, windows int")
        out = part if out is None else out.unionByName(part)
    return out


def shared_runs(docs: DataFrame, items: DataFrame, run: int = WINDOW, edits: int = 1) -> DataFrame:
    """(doc_id, item_id): documents that share ``run`` consecutive words with the item: near windows of that length,
    of which the exact check keeps those without an edit."""
    return leaks(docs, items, run, edits).filter("edits = 0").select("doc_id", "item_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, suite, documents, windows): every item and in how many documents it leaked."""
    hits = leaks(docs, items, window).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("windows").alias("windows"))
    every = items.groupBy("item_id").agg(F.min("suite").alias("suite"))
    return every.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("windows", F.lit(0)).alias("windows"))
