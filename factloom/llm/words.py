"""Words of whole Arrow columns as 64-bit hashes, without string calls per row."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from .unify import TOP, points, unify_points

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case where that is one code point, and whether it is a letter, digit or mark."""
    import unicodedata

    lower, word = np.arange(TOP, dtype=np.int64), np.zeros(TOP, bool)
    for cp in range(TOP):
        ch = chr(cp)
        word[cp] = unicodedata.category(ch)[0] in "LNM"
        if len(low := ch.lower()) == 1:
            lower[cp] = ord(low)
    # TOP stands for all above
    return np.append(lower, TOP), np.append(word, False)


_powers: list[np.ndarray] = []


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, p)]).astype(np.uint64), dtype=np.uint64) for p in (_P, _P_INV)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the words of all rows in order, and each row's end among them.

    Words are runs of letters and digits of the unified, lower-case text. Null and empty rows have none.
    """
    hashes, ends, *_ = word_spans(arr)
    return hashes, ends


def word_spans(arr: pa.Array) -> tuple[np.ndarray, ...]:
    """(hashes, word ends by row, first and end code point of each word, code points, their row ends)."""
    lower, word = _tables()
    cps, ends = unify_points(*points(arr))
    low = np.minimum(cps, TOP)
    is_word, high = word[low], cps >= TOP
    cps = np.where(high, cps, lower[low]) if high.any() else lower[low]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    fresh = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    fresh = fresh[fresh < len(cps)]
    begin[fresh] |= is_word[fresh]
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:] | begin[1:]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    with np.errstate(over="ignore"):
        power, back = _powers_of(len(cps))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(cps.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
        hashes = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(s, ends, side="left"), s, e, cps, ends
