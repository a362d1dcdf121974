"""Canonical ids of subjects and measures: alias tables, then slugs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compat, let, slug, squash

#: Canonical id and its known spellings.
ENTITY_ALIASES = {
    "delhivery_limited": ["Delhivery Limited", "Delhivery Ltd", "Delhivery Ltd.", "Delhivery"],
    "kalpana_jaisingh_morparia": ["Kalpana Jaisingh Morparia", "Ms. Kalpana Jaisingh Morparia", "Ms Kalpana Jaisingh Morparia"],
    "munish_ravinder_varma": ["Munish Ravinder Varma", "Mr. Munish Ravinder Varma"],
    "agus_tandiono": ["Agus Tandiono", "Mr. Agus Tandiono"],
}
MEASURE_ALIASES = {
    "revenue_from_operations": [
        "Revenue from Operations", "Revenue for services", "Revenue for services (A)",
        "Revenue from customers", "Revenue from customers (A+B)",
    ],
}
#: Self-references, one leading honorific, one trailing company suffix.
SELF_REFERENCES = ["the company", "your company", "our company"]
HONORIFIC = r"(?i)^(mr|mrs|ms|dr|messrs)\.?\s+"
SUFFIX = r"(?i)\b(limited|ltd)\.?\s*$"


def entity_key(form: Column) -> Column:
    """Comparison key of a subject: compatibility folded, one honorific and one company suffix less."""
    c = F.regexp_replace(F.trim(compat(form)), HONORIFIC, "")
    return F.lower(squash(F.regexp_replace(c, SUFFIX, "")))


def _alias(key: Column, groups: Mapping[str, list[str]], rule: Callable[[Column], Column]) -> Column:
    """The id of the group that has the key among its spellings, keys made by the same rule; none gives null."""
    found = F.lit(None).cast("string")
    for cid, forms in groups.items():
        found = F.when(key.isin([rule(F.lit(f)) for f in forms]), cid).otherwise(found)
    return found


def canonical_entity(form: Column, doc_subject: Column | None = None, aliases: Mapping[str, list[str]] = ENTITY_ALIASES) -> Column:
    """Alias id, else slug. "the/your/our company" gives ``doc_subject``'s id, or
    ``unknown_self_reference`` where none is known. Null gives null, blank gives ``unknown``."""
    if doc_subject is None:
        own = F.lit("unknown_self_reference")
    else:
        subject = F.when(doc_subject.isin(list(aliases)), doc_subject).otherwise(canonical_entity(doc_subject, None, aliases))
        own = F.coalesce(subject, F.lit("unknown_self_reference"))
    known = lambda key: F.coalesce(_alias(key, aliases, entity_key), slug(key))
    return let(entity_key(form), lambda key: F.when(key.isin(SELF_REFERENCES), own).otherwise(known(key)))


def measure_key(form: Column) -> Column:
    return F.lower(squash(compat(form)))


def canonical_measure(form: Column) -> Column:
    """Alias id, else slug; null gives null, blank gives ``unknown_measure``."""
    return let(measure_key(form), lambda key: F.coalesce(_alias(key, MEASURE_ALIASES, measure_key), slug(key, "unknown_measure")))


def aliased_not_identical(a: Column, b: Column) -> Column:
    """True where two wordings share an alias group and are not the same text; never null."""
    ka, kb = measure_key(a), measure_key(b)
    return F.coalesce((ka != kb) & (_alias(ka, MEASURE_ALIASES, measure_key) == _alias(kb, MEASURE_ALIASES, measure_key)), F.lit(False))
