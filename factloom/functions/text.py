"""Text folding as JVM-side column expressions (no Python in the row path)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alike letters of other scripts and the Latin letter each is drawn as.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian, dotless and long-legged Latin
    "օ": "o", "ս": "u", "ӏ": "l",
}

#: Every white-space code point (by property) other than the plain space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")
#: Invisible code points: format controls of the basic plane, by property, and variation selectors.
INVISIBLE = "".join(
    c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)])
    if unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F
) + "͏"
#: Full-width ASCII, by rule.
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
#: Hyphens drawn alike (hyphen, non-breaking hyphen).
HYPHENS = "‐‑"
LIGATURES = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFB00, 0xFB07)}


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def squash(c: Column) -> Column:
    """All white space runs (any kind) to one plain space, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain(c: Column) -> Column:
    """Visually equal text in one spelling: full-width, look-alikes, ligatures, odd spaces, hidden marks.

    Case, accents and punctuation stay; decomposed accents are not composed. Null gives null, empty
    gives empty.
    """
    pairs = {**LOOKALIKES, **WIDE, **{s: " " for s in SPACES}, **{h: "-" for h in HYPHENS}}
    # characters of the source list beyond the target list are deleted
    c = F.translate(c, "".join(pairs) + INVISIBLE, "".join(pairs.values()))
    for lig, to in LIGATURES.items():
        c = F.replace(c, F.lit(lig), F.lit(to))
    return c


def compat(c: Column) -> Column:
    """The part of compatibility folding that a column expression can state: full-width forms,
    compatibility spaces, super-script digits, ligatures and the ellipsis. Hidden characters stay."""
    supers = {"¹": "1", "²": "2", "³": "3"}
    wide_spaces = {s: " " for s in SPACES if unicodedata.normalize("NFKC", s) == " "}
    c = F.translate(c, *map("".join, zip(*{**WIDE, **supers, **wide_spaces}.items())))
    for lig, to in {**LIGATURES, "…": "..."}.items():
        c = F.replace(c, F.lit(lig), F.lit(to))
    return c


def slug(c: Column, empty: str = "unknown") -> Column:
    """Lower case, runs of other than a-z 0-9 to one underscore, ends trimmed; blank gives ``empty``."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(c.isNull(), None).otherwise(F.coalesce(F.nullif(s, F.lit("")), F.lit(empty)))


def qualifier(c: Column) -> Column:
    """A qualifier for comparison: trimmed, lower case, blank gives null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))
