"""Numbers, scales and currencies stated inside a value's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Scale words, their name and multiplier.
SCALE_NAMES = {
    "thousand": "thousand", "k": "thousand", "lakh": "lakh", "million": "million", "mn": "million",
    "crore": "crore", "cr": "crore", "billion": "billion", "bn": "billion",
}
MULTIPLIERS = {"thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7, "billion": 1e9}
#: Currency patterns, first hit wins.
CURRENCIES = [
    ("₹", "INR"), (r"(?i)\bRs\.?\b", "INR"), (r"(?i)\bINR\b", "INR"), (r"\$", "USD"),
    (r"(?i)\bUSD\b", "USD"), ("€", "EUR"), (r"(?i)\bEUR\b", "EUR"), ("£", "GBP"), (r"(?i)\bGBP\b", "GBP"),
]
#: The first number, per cent and scale words as they are recognised.
NUMBER = r"\(?-?[\d,]+(?:\.\d+)?\)?"
PERCENT = r"(?i)%|\bper\s*cent\b|\bpercent\b"
SCALE = r"(?i)(?<![a-zA-Z])(thousand|billion|million|crore|lakh|bn|cr|mn|k)(?![a-zA-Z])"


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def parse_number(raw: Column) -> Column:
    """The first number of the text: both brackets mean minus, commas are dropped; none gives null."""
    token = F.nullif(F.regexp_extract(raw, NUMBER, 0), F.lit(""))

    def signed(t: Column) -> Column:
        value = F.regexp_replace(t, "[(),]", "").try_cast("double")
        return value * F.when(t.contains("(") & t.contains(")"), -1.0).otherwise(1.0)

    return let(token, signed)


def normalize_value(raw: Column) -> Column:
    """STRUCT(raw, number, scale, scale_multiplier, currency, base_value), null where no number reads.

    A per cent sign decides first: multiplier 1, no currency. Null or numberless text gives null.
    """
    currency = F.lit(None).cast("string")
    for pattern, code in reversed(CURRENCIES):
        currency = F.when(raw.rlike(pattern), code).otherwise(currency)
    percent = raw.rlike(PERCENT)
    word = F.nullif(F.lower(F.regexp_extract(raw, SCALE, 1)), F.lit(""))
    scale = F.when(percent, "percent").otherwise(lookup(SCALE_NAMES, word))
    parsed = F.struct(parse_number(raw).alias("number"), scale.alias("scale"), currency.alias("currency"))

    def full(p: Column) -> Column:
        multiplier = F.coalesce(lookup(MULTIPLIERS, p["scale"]), F.lit(1.0))
        own = F.when(~p["scale"].eqNullSafe(F.lit("percent")), p["currency"])
        return F.when(
            p["number"].isNotNull(),
            F.struct(
                raw.alias("raw"), p["number"].alias("number"), p["scale"].alias("scale"), multiplier.alias("scale_multiplier"),
                own.alias("currency"), (p["number"] * multiplier).alias("base_value"),
            ),
        )

    return let(parsed, full)


def effective_value(raw: Column, scale: Column, currency: Column) -> Column:
    """``normalize_value`` with the fact's own scale and currency where the text names none."""
    own = F.nullif(F.lower(F.trim(scale)), F.lit(""))
    own_multiplier = F.coalesce(lookup({k: MULTIPLIERS[n] for k, n in SCALE_NAMES.items()}, own), F.lit(1.0))

    def fill(v: Column) -> Column:
        use_own = v["scale"].isNull() & (F.coalesce(scale, F.lit("")) != "")
        multiplier = F.when(use_own, own_multiplier).otherwise(v["scale_multiplier"])
        return F.when(
            v.isNotNull(),
            F.struct(
                v["number"].alias("number"),
                F.when(use_own, F.lower(F.trim(scale))).otherwise(v["scale"]).alias("scale"),
                F.coalesce(v["currency"], F.nullif(F.upper(F.trim(currency)), F.lit(""))).alias("currency"),
                (v["number"] * multiplier).alias("base_value"),
            ),
        )

    return let(normalize_value(raw), fill)
