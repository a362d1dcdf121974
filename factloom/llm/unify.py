"""Visually identical text in one form, on whole Arrow buffers of code points.

A column's bytes become one code-point array; a lookup table gives every code point's expansion
(nothing for invisible ones, a plain space for any space, the Latin letter for a look-alike, plain
forms for full-width letters and ligatures, canonical decomposition for the rest); expansion offsets
move the rows' ends; combining marks are then put in canonical order and composed in rounds over all
rows at once. No string call is made per row.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import HYPHENS, LOOKALIKES

#: Code points above are left as they are (private planes and unassigned), but for the invisible tags.
TOP = 0x30000
#: Rows are worked on in slices of about so many bytes; one longer row is a slice of its own.
SLICE = 1 << 21
#: Letters and signs without a mark that are drawn as nothing.
BLANKS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
_HANGUL = (0xAC00, 0xD7A4)


def _expand(cp: int) -> list[int]:
    ch = chr(cp)
    cat = unicodedata.category(ch)
    prepended = 0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2)  # drawn format signs
    if cp in BLANKS or cat == "Cf" and not prepended or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F:
        return []
    if ch.isspace():
        return [0x20]
    if ch in HYPHENS:
        return [0x2D]
    if ch in LOOKALIKES:
        return [ord(LOOKALIKES[ch])]
    if _HANGUL[0] <= cp < _HANGUL[1]:
        return [cp]
    d = unicodedata.decomposition(ch).split()
    if d and d[0].startswith("<"):
        to = [int(x, 16) for x in d[1:]]
        letters = d[0] == "<compat>" and cat[0] == "L" and len(to) > 1 and all(chr(x).isalpha() for x in to)
        if d[0] not in ("<wide>", "<narrow>", "<noBreak>") and not letters:
            return [cp]
        return [y for x in to for y in _expand(x)]
    return [y for x in d for y in _expand(int(x, 16))] if d else [cp]


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point: where its expansion begins, how long it is, its combining class; and
    the sorted keys of composable pairs with what they compose to."""
    flat: list[int] = []
    first, size = np.zeros(TOP, np.int32), np.ones(TOP, np.int32)
    ccc = np.zeros(TOP, np.uint8)
    pairs: dict[int, int] = {}
    for cp in range(TOP):
        first[cp] = len(flat)
        if 0xD800 <= cp < 0xE000:
            flat.append(cp)
            continue
        to = _expand(cp)
        size[cp] = len(to)
        flat.extend(to)
        ccc[cp] = unicodedata.combining(chr(cp))
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(cp) and not _HANGUL[0] <= cp < _HANGUL[1]:
            base = unicodedata.normalize("NFC", d[:-1])
            if len(base) == 1 and unicodedata.combining(d[-1]):
                pairs[ord(base) << 21 | ord(d[-1])] = cp
    keys = np.array(sorted(pairs), np.int64)
    # by code point up to TOP, which stands for all above: stays (0), is another one (1), is none or several (2)
    kind = np.full(TOP + 1, 2, np.uint8)
    kind[:TOP][size == 1] = 1
    kind[:TOP][(size == 1) & (np.array(flat, np.int64)[np.minimum(first, len(flat) - 1)] == np.arange(TOP))] = 0
    jamo = np.zeros(TOP + 1, bool)
    jamo[0x1161:0x1176] = jamo[0x11A8:0x11C3] = True
    return {"kind": kind, "jamo": jamo, "mark": np.append(ccc > 0, False), "first": first, "size": size, "flat": np.array(flat, np.int64), "ccc": ccc, "keys": keys, "to": np.array([pairs[k] for k in keys], np.int64)}


def _gather(cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its expansion; the rows' ends moved along. Most stay as they are: only the
    others are looked up, and only where one becomes none or several do the rest move."""
    t = tables()
    kind = t["kind"][np.minimum(cps, TOP)]
    one, odd = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    out = cps.copy()
    out[one] = t["flat"][t["first"][cps[one]]]
    if not len(odd):
        return out, ends
    c = cps[odd]
    low = np.minimum(c, TOP - 1)
    n = np.where(c < TOP, t["size"][low], np.where((c >= 0xE0000) & (c < 0xE1000), 0, 1)).astype(np.int64)
    counts = np.ones(len(cps), np.int64)
    counts[odd] = n
    moved = np.concatenate([[0], np.cumsum(n - 1)])
    out = np.repeat(out, counts)
    at, first = odd + moved[:-1], t["first"][low]
    for k in range(int(n.max())):
        more = (n > k) & (c < TOP)
        out[at[more] + k] = t["flat"][first[more] + k]
    return out, ends + moved[np.searchsorted(odd, ends)]


def _compose(cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    low = np.minimum(cps, TOP)
    marks, jamo = np.flatnonzero(t["mark"][low]), np.flatnonzero(t["jamo"][low])
    if not len(marks) and not len(jamo):
        return cps, ends
    keep = np.ones(len(cps), bool)
    ccc = np.zeros(len(cps), np.int64)
    ccc[marks] = t["ccc"][cps[marks]]
    if len(marks):
        row = np.searchsorted(ends, marks, side="right")
        head = np.diff(marks, prepend=-2) != 1
        head |= np.diff(row, prepend=-1) != 0
        run = np.cumsum(head) - 1
        # canonical order within a run of marks: stable by class
        order = np.lexsort((np.arange(len(marks)), ccc[marks], run))
        cps[marks], ccc[marks] = cps[marks][order], ccc[marks][order]
        starts = np.flatnonzero(head)
        rank = np.arange(len(marks)) - starts[run]
        starter = marks[starts] - 1
        row_first = np.concatenate([[0], ends])[row[starts]]
        has = starter >= row_first  # a run at a row's start has nothing to compose with
        last = np.zeros(len(starts), np.int64)
        by_rank = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
        for r in range(int(rank.max()) + 1):
            m = by_rank[cuts[r] : cuts[r + 1]]
            g, at = run[m], marks[m]
            free = has[g] & (last[g] < ccc[at])
            key = cps[starter[g]] << 21 | cps[at]
            k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            hit = free & (t["keys"][k] == key)
            cps[starter[g[hit]]] = t["to"][k[hit]]
            keep[at[hit]] = False
            last[g[~hit]] = ccc[at[~hit]]
    if len(jamo):
        # Hangul by its arithmetic: lead + vowel, then syllable + tail
        inner = np.ones(max(len(cps) - 1, 0), bool)
        inner[ends[(ends > 0) & (ends < len(cps))] - 1] = False
        lv = np.flatnonzero((cps[:-1] >= 0x1100) & (cps[:-1] < 0x1113) & (cps[1:] >= 0x1161) & (cps[1:] < 0x1176) & inner)
        if len(lv):
            cps[lv + 1] = 0xAC00 + ((cps[lv] - 0x1100) * 21 + cps[lv + 1] - 0x1161) * 28
            keep[lv] = False
        tail = np.flatnonzero((cps[:-1] >= 0xAC00) & (cps[:-1] < 0xD7A4) & ((cps[:-1] - 0xAC00) % 28 == 0) & (cps[1:] > 0x11A7) & (cps[1:] < 0x11C3) & inner)
        if len(tail):
            cps[tail + 1] = cps[tail] + cps[tail + 1] - 0x11A7
            keep[tail] = False
    return cps[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def unify_points(cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row ends -> those of the unified text, runs of spaces as one space."""
    cps, ends = _compose(*_gather(cps, ends))
    if len(cps):
        space = cps == 0x20
        again = np.flatnonzero(space[1:] & space[:-1]) + 1
        again = again[~np.isin(again, ends)]  # each row begins anew
        if len(again):
            keep = np.ones(len(cps), bool)
            keep[again] = False
            cps, ends = cps[keep], ends - np.searchsorted(again, ends)
    return cps, ends


def points(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row ends of a string array; null rows are empty."""
    arr = pa.concat_arrays([arr.cast(pa.large_string())])
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    cps = np.frombuffer(bytes(raw).decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return cps, lead[offsets[1:] - offsets[0]]


def to_array(cps: np.ndarray, ends: np.ndarray, nulls: np.ndarray) -> pa.Array:
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode()
    width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(width)])[ends]]).astype(np.int64)
    valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data), valid).cast(pa.string())


def slices(arr: pa.Array) -> Iterator[pa.Array]:
    """Pieces of whole rows of about SLICE bytes."""
    if not len(arr):
        return
    arr = pa.concat_arrays([arr.cast(pa.large_string())])
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    piece = (offsets[:-1] - offsets[0]) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(arr)]
    for a, b in zip(cuts, cuts[1:]):
        yield arr.slice(a, b - a)


def unify_array(arr: pa.Array) -> pa.Array:
    """Unified text of a string array; null stays null, empty stays empty."""
    out = []
    for part in slices(arr):
        nulls = part.is_null().to_numpy(zero_copy_only=False)
        out.append(to_array(*unify_points(*points(part)), nulls))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def unify(c: Column | str) -> Column:
    """The text in one form: equal looks give equal strings. Letter case, accents, raised digits and
    punctuation stay; the kind and number of spaces and invisible characters do not. Null gives null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield unify_array(arr)

    return run(c)


def unify_both(a: Column | str, b: Column | str) -> Column:
    """STRUCT(a, b) of two texts in one form. As one call of both it stays above the join that brings them together, so
    only the rows that are left there are worked on and no second copy of a text is shuffled."""

    @F.arrow_udf("struct<a:string,b:string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.StructArray.from_arrays([unify_array(x), unify_array(y)], ["a", "b"])

    return run(a, b)
