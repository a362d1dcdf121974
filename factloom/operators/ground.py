"""Grounding of proposals: the quote must be found in the block it cites."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

THRESHOLD = 92.0
#: Dashes that count as a plain hyphen.
DASHES = "‐‑‒–—―−­"


#: Code points above decompose into nothing else.
_TOP = 0x30000


@functools.cache
def _expansions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many, where, what): the folded code points of every code point, one after the other in one array."""
    forms = [unicodedata.normalize("NFKC", chr(c)) if not 0xD800 <= c < 0xE000 else chr(c) for c in range(_TOP)]
    for dash in DASHES:
        forms[ord(dash)] = "-"
    size = np.fromiter(map(len, forms), np.int64, _TOP)
    flat = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    spaces = [c for c in range(0x3001) if chr(c).isspace()]
    flat[np.isin(flat, spaces)] = 0x20
    return size, np.cumsum(size) - size, flat


def fold_all(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Each text folded (compatibility forms, plain hyphens, single spaces), and for each of its characters the
    index it came from. All texts are one array of code points: expansions are gathered, then the characters
    that follow a space as a space are masked out."""
    size, where, flat = _expansions()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    low = cps < _TOP
    n = np.where(low, size[np.where(low, cps, 0)], 1)
    source = np.repeat(np.arange(len(cps)), n)
    inner = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
    out = np.where(low[source], flat[np.where(low, where[np.where(low, cps, 0)], 0)[source] + np.where(low[source], inner, 0)], cps[source])
    row = np.repeat(np.arange(len(texts)), lengths)[source]
    again = np.zeros(len(out), bool)
    again[1:] = (out[1:] == 0x20) & (out[:-1] == 0x20) & (row[1:] == row[:-1])
    out, source, row = out[~again], source[~again], row[~again]
    ends = np.cumsum(np.bincount(row, minlength=len(texts)))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    whole = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    first = np.cumsum(lengths) - lengths
    return [whole[i:j] for i, j in zip(begins, ends)], [source[i:j] - f for i, j, f in zip(begins, ends, first)]


def _lcs_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def _lcs(masks: dict[str, int], m: int, text: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    v, full = (1 << m) - 1, (1 << m) - 1
    for ch in text:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def best_window(quote: str, block: str) -> tuple[float, int, int]:
    """(score 0-100, start, end): the window of ``block`` most like ``quote`` by 2*LCS/(lengths).

    Windows have the quote's length, cut at the block's ends. A quote longer than the block is scored
    against the whole block. Equal scores: the first window.
    """
    m, n = len(quote), len(block)
    if not m or not n:
        return 0.0, 0, 0
    pos = block.find(quote)
    if pos >= 0:
        return 100.0, pos, pos + m
    if m > n:
        s, _, _ = best_window(block, quote)
        return s, 0, n
    # no window scores above the characters it shares with the quote
    chars = {c: i for i, c in enumerate(dict.fromkeys(quote))}
    need = np.bincount([chars[c] for c in quote], minlength=len(chars))
    codes = np.array([chars.get(c, -1) for c in block])
    starts = np.arange(-(m - 1), n)
    lo, hi = np.maximum(starts, 0), np.minimum(starts + m, n)
    shared = np.zeros(len(starts), dtype=np.int64)
    for k in range(len(chars)):
        seen = np.concatenate([[0], np.cumsum(codes == k)])
        shared += np.minimum(seen[hi] - seen[lo], need[k])
    total = m + hi - lo
    bound = 200.0 * shared / total
    masks = _lcs_masks(quote)
    first = int(bound.argmax())
    if bound[first] <= 0:
        return 0.0, 0, 0
    common = _lcs(masks, m, block[lo[first] : hi[first]])
    best, at = 200.0 * common / total[first], first
    # a window moved on by d characters shares d more at most, so windows that cannot reach the best are
    # jumped over; before the best window an equal score counts too, as the first of equals is wanted
    reach = np.flatnonzero(bound >= best)
    last, had = -1, m
    for w, most, size in zip(reach.tolist(), bound[reach].tolist(), total[reach].tolist()):
        if last >= 0:
            most = min(most, 200.0 * (had + w - last) / size)
        if most < best or most == best and w >= at:
            continue
        had, last = _lcs(masks, m, block[lo[w] : hi[w]]), w
        score = 200.0 * had / size
        if score > best or score == best and w < at:
            best, at = score, w
    return best, int(lo[at]), int(hi[at])


_RESULT = "struct<score double, start int, end int, reason string>"


def _gate(quote: str | None, q: str, b: str, at: np.ndarray, threshold: float) -> tuple[float, int | None, int | None, str | None]:
    if quote is None or not quote.strip():
        return 0.0, None, None, "empty evidence_quote"
    if not q or not b:
        return 0.0, None, None, "quote or block empty after normalization"
    score, start, end = best_window(q, b)
    if score < threshold:
        return score, None, None, f"partial_ratio {score:.1f} below threshold {threshold:.0f}"
    return score, int(at[start]), int(at[end - 1]) + 1, None


def _fuzzy(threshold: float):
    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for open_, quotes, texts in batches:
            out = pd.DataFrame({"score": np.zeros(len(open_)), "start": None, "end": None, "reason": None}, index=open_.index)
            todo = np.flatnonzero(open_.to_numpy(dtype=bool))
            raw = [quotes.iloc[i] for i in todo]
            folded, _ = fold_all([x or "" for x in raw])
            # rows of a batch often cite the same block
            named = {t: k for k, t in enumerate(dict.fromkeys(texts.iloc[i] or "" for i in todo))}
            blocks, at = fold_all(list(named))
            rows = []
            for i, x, q in zip(todo, raw, folded):
                k = named[texts.iloc[i] or ""]
                rows.append(_gate(x, q, blocks[k], at[k], threshold))
            if rows:
                out.iloc[todo] = pd.DataFrame(rows, columns=out.columns, index=out.index[todo]).astype(object)
            yield out.astype({"score": "float64", "start": "Int32", "end": "Int32"})

    return run


def ground(proposals: DataFrame, blocks: DataFrame, on: list[str], quote: Column | str = "quote", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, char_start, char_end, reason to each proposal; ``reason`` null means grounded.

    One join (skew-safe on the block) serves all: exact hits are decided in the JVM, only the rest gets its
    texts into the Arrow-batched aligner. A proposal without its block gets reason "no source block"; an empty quote or block has a reason of
    its own. Every proposal comes out exactly once. Score 0-100; ``threshold`` is inclusive.
    """
    q = F.col(quote) if isinstance(quote, str) else quote
    left = proposals.withColumns({"_q": q, "_on": F.struct(*on)})
    right = blocks.select(F.struct(*on).alias("_on"), F.col(text).alias("_t"), F.lit(True).alias("_has"))
    at = F.when(F.trim("_q") != "", F.instr(F.col("_t"), F.col("_q")))
    j = salted_join(left, right, "_on", "left").withColumn("_at", at).drop("_on")
    found = F.coalesce(F.col("_at") > 0, F.lit(False))
    lost = F.col("_has").isNull()
    aligned = ~found & ~lost
    g = j.withColumn("_g", _fuzzy(threshold)(aligned, F.when(aligned, F.col("_q")), F.when(aligned, F.col("_t"))))
    start = F.col("_at") - 1
    return g.withColumns(
        {
            "score": F.when(found, 100.0).when(lost, 0.0).otherwise(F.col("_g.score")),
            "char_start": F.when(found, start).when(~lost, F.col("_g.start")),
            "char_end": F.when(found, start + F.length("_q")).when(~lost, F.col("_g.end")),
            "reason": F.when(lost, "no source block").when(~found, F.col("_g.reason")),
        }
    ).drop("_q", "_t", "_has", "_at", "_g")
