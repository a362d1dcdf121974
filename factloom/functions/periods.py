"""Fiscal and calendar periods in free text, as one ordered CASE per grammar rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from .units import lookup

#: Names used by the grammar.
MONTHS = {m: i for i, m in enumerate(
    ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"], 1)}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4}
COUNTS = {w: i for i, w in enumerate(
    ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"], 1)}
_DATE = r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
_I = "(?i)"
_MONTHS_ENDED = _I + r"(\d+|" + "|".join(COUNTS) + r")\s+months?\s+ended\s+(.+)"
_AS_OF = _I + r"\bas\s+of\s+(.+)"


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where year, month and day make none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def _g(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _part(at: Column, months: int | Column, basis: str) -> Column:
    """A period before its ends are worked out: whole months from ``at``; none: the day ``at``; below none:
    that many months up to ``at``."""
    n = F.lit(months) if isinstance(months, int) else months
    return F.when(at.isNotNull() & n.isNotNull(), F.struct(at.alias("at"), n.alias("n"), F.lit(basis).alias("basis")))


def fiscal_year(y: Column) -> Column:
    return _part(_ymd(y, F.lit(4), F.lit(1)), 12, "FY_IN")


def calendar_year(y: Column) -> Column:
    return _part(_ymd(y, F.lit(1), F.lit(1)), 12, "CY")


def fiscal_quarter(y: Column, q: Column) -> Column:
    """Quarter ``q`` of the fiscal year that starts in April of ``y``."""
    return _part(F.add_months(_ymd(y, F.lit(4), F.lit(1)), ((q - 1) * 3).cast("int")), 3, "QUARTER")


def calendar_quarter(y: Column, q: Column) -> Column:
    return _part(F.add_months(_ymd(y, F.lit(1), F.lit(1)), ((q - 1) * 3).cast("int")), 3, "QUARTER")


def _ends(p: Column) -> Column:
    start = F.when(p["n"] < 0, F.trunc(F.add_months(p["at"], p["n"] + 1), "MM")).otherwise(p["at"])
    end = F.when(p["n"] > 0, F.last_day(F.add_months(p["at"], p["n"] - 1))).otherwise(p["at"])
    basis = F.when((p["n"] < 0) & (F.month(start) != 4), "CY").otherwise(p["basis"])
    return F.when(p.isNotNull(), F.struct(start.alias("start"), end.alias("end"), basis.alias("basis")))


def parse_date(text: Column) -> Column:
    """The first ``Month d[,] yyyy``; null where it is no date, later ones are not tried."""
    month = lookup(MONTHS, F.lower(_g(text, _DATE, 1)))
    return F.when(month.isNotNull(), _ymd(_g(text, _DATE, 3), month, _g(text, _DATE, 2)))


def parse_period(expr: Column) -> Column:
    """STRUCT(start, end, basis), ends inclusive; the first rule of the grammar that hits decides.

    Two-digit years are 20yy. "months ended" and "as of" with a bad date give null without trying
    later rules. Null or unmatched text gives null.
    """
    t = F.trim(expr)
    yy = lambda p, n: _g(t, p, n).cast("int") + F.lit(1999)  # fiscal year 20yy starts the year before
    num = lambda p, n: _g(t, p, n).cast("int")
    nth = lambda p: lookup(ORDINALS, F.lower(_g(t, p, 1)))
    words = r"\b(first|second|third|fourth)\s+quarter\s+of\s+FY\s*"
    p1, p2 = _I + words + r"(\d{4})\s*[/-]\s*(\d{2,4})\b", _I + words + r"(\d{2})\b"
    p3, p4, p5 = (_I + r"\bQ([1-4])\s*FY\s*" + rest for rest in (r"(\d{4})\s*/\s*(\d{2})\b", r"(\d{4})\s*-\s*(\d{2})\b", r"(\d{2})\b"))
    p6, p7 = _I + r"\b(\d{4})\s*Q([1-4])\b", _I + r"\bQ([1-4])\s+(\d{4})\b(?!\s*/)"
    p8, p9, p10 = (_I + r"\bFY\s*" + rest for rest in (r"(\d{4})\s*/\s*(\d{2})\b", r"(\d{4})\s*-\s*(\d{2})\b", r"(\d{2})\b"))
    p11, p14 = _I + r"\bCY\s*(\d{4})\b", r"(?<!\d)(\d{4})\s*-\s*(\d{2})(?!\d)"
    rules = [
        (p1, fiscal_quarter(num(p1, 2), nth(p1))),
        (p2, fiscal_quarter(yy(p2, 2), nth(p2))),
        (p3, fiscal_quarter(num(p3, 2), num(p3, 1))),
        (p4, fiscal_quarter(num(p4, 2), num(p4, 1))),
        (p5, fiscal_quarter(yy(p5, 2), num(p5, 1))),
        (p6, calendar_quarter(num(p6, 1), num(p6, 2))),
        (p7, calendar_quarter(num(p7, 2), num(p7, 1))),
        (p8, fiscal_year(num(p8, 1))),
        (p9, fiscal_year(num(p9, 1))),
        (p10, fiscal_year(yy(p10, 1))),
        (p11, calendar_year(num(p11, 1))),
    ]
    count = F.lower(_g(t, _MONTHS_ENDED, 1))
    n = F.coalesce(count.try_cast("int"), lookup(COUNTS, count))
    rules += [
        (_MONTHS_ENDED, _part(parse_date(_g(t, _MONTHS_ENDED, 2)), -n, "FY_IN")),
        (_AS_OF, _part(parse_date(_g(t, _AS_OF, 1)), 0, "FY_IN")),
        (p14, fiscal_year(num(p14, 1))),
    ]
    out = _part(parse_date(t), 0, "FY_IN")
    for pattern, value in reversed(rules):
        out = F.when(t.rlike(pattern), value).otherwise(out)
    return let(out, _ends)


def _iso(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def fact_period(qualifiers: Column) -> Column:
    """STRUCT(start, end) of a fact: its date, else both period ends, else its label; bad text falls through."""
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    both = pair(_iso(qualifiers["period_start"]), _iso(qualifiers["period_end"]))
    return F.coalesce(
        let(_iso(qualifiers["date"]), lambda d: F.when(d.isNotNull(), pair(d, d))),
        let(both, lambda p: F.when(p["start"].isNotNull() & p["end"].isNotNull(), p)),
        let(parse_period(qualifiers["period_label"]), lambda p: pair(p["start"], p["end"])),
    )


def period_relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """equal, overlap or disjoint (inclusive ends); null where any end is unknown."""
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.when(
        known,
        F.when((a0 == b0) & (a1 == b1), "equal").when((a0 <= b1) & (b0 <= a1), "overlap").otherwise("disjoint"),
    )


def intervals_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Half-open intervals, null ends unbounded."""
    low, high = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    return (F.coalesce(a0, low) < F.coalesce(b1, high)) & (F.coalesce(b0, low) < F.coalesce(a1, high))
