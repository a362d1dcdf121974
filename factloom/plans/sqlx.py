"""The core's scalar rules as SQL text, for the side-by-side check in another engine."""

from __future__ import annotations

import re

from ..functions import names, units
from ..functions.text import LIGATURES, SPACES, WIDE
from ..functions.periods import COUNTS, MONTHS


def _plain_entity(s: str) -> str:
    """The entity key of the plain spellings in the alias table, for the other engine's side of the comparison."""
    s = re.sub(names.HONORIFIC, "", s.strip())
    return re.sub(r"\s+", " ", re.sub(names.SUFFIX, "", s).strip()).lower()


def _spellings(groups: dict[str, list[str]], key) -> dict[str, str]:
    return {key(form): cid for cid, forms in groups.items() for form in forms}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, table: dict, otherwise: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {lit(str(k))} THEN {lit(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {otherwise} END"


def compat(e: str) -> str:
    import unicodedata

    table = {**WIDE, "¹": "1", "²": "2", "³": "3", **{s: " " for s in SPACES if unicodedata.normalize("NFKC", s) == " "}}
    out = f"translate({e}, {lit(''.join(table))}, {lit(''.join(table.values()))})"
    for a, b in {**LIGATURES, "…": "..."}.items():
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return out


WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def squash(e: str) -> str:
    return f"trim(regexp_replace({e}, {lit(WS)}, ' ', 'g'))"


def slug(e: str, empty: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), {lit(empty)})"


def entity_key(e: str) -> str:
    e = f"regexp_replace(trim({compat(e)}), '^(mr|mrs|ms|dr|messrs)\\.?\\s+', '', 'i')"
    return f"lower({squash(f'regexp_replace({e}, {lit(chr(92) + 'b(limited|ltd)' + chr(92) + '.?' + chr(92) + 's*$')}, {lit('')}, {lit('i')})')})"


def entity(e: str) -> str:
    key = entity_key(e)
    aliases = _spellings(names.ENTITY_ALIASES, _plain_entity)
    return f"CASE WHEN {key} IN ({', '.join(map(lit, names.SELF_REFERENCES))}) THEN 'unknown_self_reference' ELSE coalesce({case_map(key, aliases)}, {slug(key, 'unknown')}) END"


def measure_key(e: str) -> str:
    return f"lower({squash(compat(e))})"


def measure(e: str) -> str:
    key = measure_key(e)
    return f"coalesce({case_map(key, _spellings(names.MEASURE_ALIASES, lambda x: " ".join(x.split()).lower()))}, {slug(key, 'unknown_measure')})"


def alias_group(e: str) -> str:
    return case_map(measure_key(e), _spellings(names.MEASURE_ALIASES, lambda x: " ".join(x.split()).lower()))


def qualifier(e: str) -> str:
    return f"nullif(lower(trim({e})), '')"


def number(e: str) -> str:
    token = f"nullif(regexp_extract({e}, '\\(?-?[\\d,]+(?:\\.\\d+)?\\)?', 0), '')"
    value = f"try_cast(regexp_replace({token}, '[(),]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN contains({token}, '(') AND contains({token}, ')') THEN -({value}) ELSE {value} END"


def is_percent(e: str) -> str:
    return f"regexp_matches({e}, '%|\\bper\\s*cent\\b|\\bpercent\\b', 'i')"


def scale(e: str) -> str:
    word = f"lower(regexp_extract({e}, '(?:^|[^a-zA-Z])(thousand|billion|million|crore|lakh|bn|cr|mn|k)(?:[^a-zA-Z]|$)', 1, 'i'))"
    return f"CASE WHEN {is_percent(e)} THEN 'percent' ELSE {case_map(word, units.SCALE_NAMES)} END"


def currency(e: str) -> str:
    whens = [f"WHEN regexp_matches({e}, {lit(p.removeprefix('(?i)'))}, 'i') THEN {lit(c)}" for p, c in units.CURRENCIES]
    return f"CASE WHEN {is_percent(e)} THEN NULL {' '.join(whens)} END"


def multiplier(name: str) -> str:
    return f"CASE {name} " + " ".join(f"WHEN {lit(k)} THEN {v:.1f}::DOUBLE" for k, v in units.MULTIPLIERS.items()) + " ELSE 1.0::DOUBLE END"


def _date(e: str) -> str:
    p = r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    month = "CASE lower(regexp_extract({e}, '{p}', 1)) ".format(e=e, p=p) + " ".join(f"WHEN {lit(m)} THEN {i}" for m, i in MONTHS.items()) + " END"
    return f"try_cast(regexp_extract({e}, '{p}', 3) || '-' || lpad(({month})::VARCHAR, 2, '0') || '-' || lpad(regexp_extract({e}, '{p}', 2), 2, '0') AS DATE)"


def period(e: str) -> str:
    """STRUCT(s, e, b) of a label, or NULL."""
    t = f"trim({e})"
    ex = lambda p, n: f"regexp_extract({t}, {lit(p)}, {n}, 'i')"
    num = lambda p, n: f"try_cast({ex(p, n)} AS INT)"
    st = lambda s, e, b: f"{{'s': {s}, 'e': {e}, 'b': {b}}}"
    fy = lambda y: st(f"make_date({y}, 4, 1)", f"make_date({y} + 1, 3, 31)", "'FY_IN'")
    qs = lambda start: st(f"({start})::DATE", f"last_day(({start} + INTERVAL 2 MONTH)::DATE)", "'QUARTER'")
    fq = lambda y, q: qs(f"(make_date({y}, 4, 1) + to_months(3 * ({q} - 1)))")
    cq = lambda y, q: qs(f"(make_date({y}, 1, 1) + to_months(3 * ({q} - 1)))")
    nth = lambda p: f"(CASE lower({ex(p, 1)}) WHEN 'first' THEN 1 WHEN 'second' THEN 2 WHEN 'third' THEN 3 WHEN 'fourth' THEN 4 END)"
    words = r"\b(first|second|third|fourth)\s+quarter\s+of\s+FY\s*"
    p1, p2 = words + r"(\d{4})\s*[/-]\s*(\d{2,4})\b", words + r"(\d{2})\b"
    p3, p4, p5 = (r"\bQ([1-4])\s*FY\s*" + r for r in (r"(\d{4})\s*/\s*(\d{2})\b", r"(\d{4})\s*-\s*(\d{2})\b", r"(\d{2})\b"))
    p6, p7 = r"\b(\d{4})\s*Q([1-4])\b", r"\bQ([1-4])\s+(\d{4})\b\s*(?:[^/\s]|$)"
    p8, p9, p10 = (r"\bFY\s*" + r for r in (r"(\d{4})\s*/\s*(\d{2})\b", r"(\d{4})\s*-\s*(\d{2})\b", r"(\d{2})\b"))
    p11, p14 = r"\bCY\s*(\d{4})\b", r"(?:^|[^0-9])(\d{4})\s*-\s*(\d{2})(?:[^0-9]|$)"
    p12, p13 = r"(\d+|" + "|".join(COUNTS) + r")\s+months?\s+ended\s+(.+)", r"\bas\s+of\s+(.+)"
    n = f"coalesce({num(p12, 1)}, CASE lower({ex(p12, 1)}) " + " ".join(f"WHEN {lit(w)} THEN {i}" for w, i in COUNTS.items()) + " END)"
    end = _date(ex(p12, 2))
    start = f"date_trunc('month', {end} - to_months({n} - 1))::DATE"
    at, bare = _date(ex(p13, 1)), _date(t)
    span = lambda s, e, b: f"CASE WHEN ({e}) IS NOT NULL THEN {st(s, e, b)} END"
    rules = [
        (p1, fq(num(p1, 2), nth(p1))), (p2, fq(f"({num(p2, 2)} + 1999)", nth(p2))), (p3, fq(num(p3, 2), num(p3, 1))), (p4, fq(num(p4, 2), num(p4, 1))),
        (p5, fq(f"({num(p5, 2)} + 1999)", num(p5, 1))), (p6, cq(num(p6, 1), num(p6, 2))), (p7, cq(num(p7, 2), num(p7, 1))), (p8, fy(num(p8, 1))), (p9, fy(num(p9, 1))),
        (p10, fy(f"({num(p10, 1)} + 1999)")), (p11, st(f"make_date({num(p11, 1)}, 1, 1)", f"make_date({num(p11, 1)}, 12, 31)", "'CY'")),
        (p12, span(start, end, f"CASE WHEN month({start}) = 4 THEN 'FY_IN' ELSE 'CY' END")), (p13, span(at, at, "'FY_IN'")), (p14, fy(num(p14, 1))),
    ]
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {lit(p)}, 'i') THEN {v}" for p, v in rules) + f" ELSE {span(bare, bare, lit('FY_IN'))} END"


#: One row per fact, with the components and both keys of its claim.
def facts_cte(extra: str = "") -> str:
    iso = lambda k: f"CASE WHEN regexp_matches(qualifiers['{k}'], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(qualifiers['{k}'] AS DATE) END"
    return f"""
    ff AS (SELECT DISTINCT ON (id) * FROM facts WHERE id IS NOT NULL),
    fp AS (
        SELECT *, {entity('subject_surface_form')} AS subject_id, {measure('measure_surface_form')} AS measure_key,
            {iso('date')} AS pd, {iso('period_start')} AS ps, {iso('period_end')} AS pe, {period("qualifiers['period_label']")} AS pl,
            {qualifier("qualifiers['consolidation']")} AS consolidation, {qualifier("qualifiers['geography']")} AS geography, {qualifier("qualifiers['modality']")} AS modality
        FROM ff
    ),
    fc AS (
        SELECT * EXCLUDE (claim_key, loose_key),
            CASE WHEN pd IS NOT NULL THEN pd WHEN ps IS NOT NULL AND pe IS NOT NULL THEN ps ELSE pl.s END AS period_start,
            CASE WHEN pd IS NOT NULL THEN pd WHEN ps IS NOT NULL AND pe IS NOT NULL THEN pe ELSE pl.e END AS period_end
        FROM fp
    ),
    f AS (
        SELECT *,
            sha256(coalesce(subject_id, '') || '|' || coalesce(measure_key, '') || '|' || coalesce(period_start::VARCHAR, '') || '|' || coalesce(period_end::VARCHAR, '') || '|' || coalesce(consolidation, '') || '|' || coalesce(geography, '')) AS claim_key,
            sha256(coalesce(subject_id, '') || '|' || coalesce(measure_key, '')) AS loose_key
        FROM fc
    ){extra}"""
