"""Free wordings mapped to the closest entry of a reference list: prefix-filter similarity join.

A wording and an entry are sets of word-padded character trigrams, so order of words does not count.
Trigrams are ordered by rarity over all sets; two sets of Jaccard similarity ``t`` must share a trigram
within the first ``|x| - ceil(t*|x|) + 1`` of each, so only those are joined. Pairs whose sizes, or whose
positions of the shared trigram, rule ``t`` out are dropped; the rest is verified exactly and the best
entry is kept. Only distinct wordings take part; facts meet the result by a skew-safe join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash
from ..operators.skew import salted_join
from ..session import cut
from .unify import unify

#: Least similarity of a match.
THRESHOLD = 0.4
#: Entries of the list up to which it is broadcast; a longer list is joined by shuffle.
BROADCAST_ENTRIES = 100_000
#: Common short and other names of accounting and operating measures, by the list's ids.
COMMON_NAMES = {
    "revenue_from_operations": ["turnover", "net sales", "revenue from ops"], "profit_after_tax": ["net profit", "net income", "post tax profit"], "profit_before_tax": ["pre tax profit"],
    "cost_of_materials_consumed": ["comc"],
    "depreciation_and_amortisation": ["depn & amort", "depreciation & amortisation", "depn and amort"],
    "earnings_before_interest_and_tax": ["operating profit"], "employee_benefits_expense": ["employee cost", "personnel expense", "staff costs"],
    "finance_costs": ["interest cost", "borrowing costs"], "inventories_at_year_end": ["inventory at year end"],
    "cash_and_cash_equivalents": ["cash equivalents", "cash & cash equivalents", "cce"], "shipments_delivered": ["consignments delivered"],
    "permanent_employees_on_roll": ["employees on roll", "permanent headcount"], "capital_expenditure": ["capital spend"],
    "consumer_price_inflation": ["cpi"], "gross_domestic_product_growth": ["gdp"], "long_term_borrowings": ["long-term debt"],
    "short_term_borrowings": ["short-term debt"], "community_programme_spend": ["csr expenditure"],
    "research_and_development_spend": ["research & development spend", "r & d spend", "r & d outlay"],
}
#: Common short forms of words in captions.
SHORT_WORDS = {
    "avg": "average", "whse": "warehouse", "devt": "development", "agmt": "agreement", "depn": "depreciation", "amort": "amortisation",
    "ops": "operations", "exp": "expense", "govt": "government", "mgmt": "management", "misc": "other", "lt": "long term", "st": "short term",
    "r&d": "research and development", "&": "and",
}


def bare(form: Column) -> Column:
    """A unified wording without case, foot-note marks, qualifiers and list prefixes; "X, Y" reads "Y X"."""
    c = F.lower(form)
    c = F.regexp_replace(c, r"[*^#¹²³†‡]|\[[^\]]*\]?", " ")
    c = F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"\((?:[a-z](?:\s*\+\s*[a-z])*|note\b[^)]*|net|consolidated|standalone|group)\)", " ")
    c = F.regexp_replace(c, r"\((?:note|ne|net|cons|stand)\w*\W*$", " ")
    c = squash(F.regexp_replace(squash(c), r"(?:\s+(?:for the y\w*|for th?e?|-\s*(?:group|standalone))\W*)+$", ""))
    head = r"(?:total|reported|of which|which)\s"
    c = F.regexp_replace(F.regexp_replace(c, "^" + head, ""), r",\s*(?:of|of which|total|reported)$", "")
    c = F.regexp_replace(c, r"^(.+?),\s*(.+)$", "$2 $1")
    c = F.regexp_replace(squash(c), "^" + head, "")
    return squash(F.regexp_replace(c, r"[^\p{L}\p{N}&.…]+", " "))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}&]+", " "), " "), lambda w: w != "")


def _stems(entries: DataFrame) -> DataFrame:
    """(stem, whole): beginnings of the entries' words of six letters and more, and the word; the shortest where several fit.

    For words that a wording cuts short ("exp.", "oper…")."""
    words = entries.select(F.explode(_words(F.lower("label"))).alias("w")).distinct().filter(F.length("w") > 5)
    cuts = words.select("w", F.explode(F.sequence(F.lit(2), F.length("w") - 1)).alias("n"))
    return cuts.groupBy(F.substring("w", F.lit(1), F.col("n")).alias("stem")).agg(F.min(F.struct(F.length("w"), "w"))["w"].alias("whole"))


def spelt_out(c: Column) -> Column:
    """The words of a wording, common short words spelt out; a word that is cut short keeps one full stop."""
    words = F.create_map(*[F.lit(x) for kv in SHORT_WORDS.items() for x in kv])
    c = F.array_join(F.transform(F.split(c, r"\s+"), lambda w: F.coalesce(words[F.regexp_replace(w, r"\.+$", "")], w)), " ")
    return F.split(F.regexp_replace(c, r"(\.{2,}|…)", ". "), r"\s+")


def completed(forms: DataFrame, stems: DataFrame) -> DataFrame:
    """(b, c) of the distinct ``forms(b)``: the wording with its cut-short words completed from the stems."""
    each = forms.select("b", F.posexplode(spelt_out(F.col("b"))).alias("i", "w"))
    each = each.withColumn("stem", F.when(F.col("w").endswith("."), F.regexp_replace("w", r"\.+$", "")))
    j = each.join(stems, "stem", "left").select("b", F.struct("i", F.coalesce("whole", "w").alias("w")).alias("x"))
    return j.groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), " ").alias("c"))


def tokens(c: Column) -> Column:
    """The set of trigrams of the padded words."""
    padded = F.transform(_words(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    return F.array_distinct(grams)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where a list of so many rows may be."""
    return F.broadcast(df) if rows <= BROADCAST_ENTRIES else df


def _ranked(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """(k, t: trigrams from rare to common, n) of sets(k, t)."""
    e = sets.select("k", F.explode("t").alias("g")).join(rarity, "g")
    return e.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "g"))), lambda x: x["g"]).alias("t")).withColumn("n", F.size("t"))


def _prefixes(ranked: DataFrame, t: float) -> DataFrame:
    keep = F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9).cast("int") + 1
    return ranked.select("*", F.posexplode(F.slice("t", F.lit(1), keep)).alias("p", "g"))


def closest(forms: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(form, entry, similarity): for each of ``forms(form)`` the most similar of ``entries(entry, label)``.

    An entry may have several labels. Forms below the threshold give no row; equal similarities: the
    smaller entry id. Null and blank forms give no row. ``forms`` must be distinct.
    """
    size = entries.limit(BROADCAST_ENTRIES + 1).count()
    entry_rows = entries.filter("label is not null").select("entry", unify("label").alias("u")).select("entry", bare(F.col("u")).alias("b")).distinct()
    entry_sets = entry_rows.select(F.struct("entry", "b").alias("k"), tokens(F.array_join(spelt_out(F.col("b")), " ")).alias("t"))
    cleaned = forms.filter("form is not null").select("form", unify("form").alias("u")).select("form", bare(F.col("u")).alias("b")).filter("b <> ''")
    cleaned = cut(cleaned)
    form_sets = cut(completed(cleaned.select("b").distinct(), _small(_stems(entries), size)).select(F.col("b").alias("k"), tokens(F.col("c")).alias("t")))
    counts = form_sets.select(F.explode("t").alias("g")).groupBy("g").agg(F.count("*").alias("f"))
    listed = entry_sets.select(F.explode("t").alias("g")).groupBy("g").agg(F.count("*").alias("f2"))
    rarity = counts.join(listed, "g", "full").select("g", (F.coalesce("f", F.lit(0)) + F.coalesce("f2", F.lit(0))).alias("f"))
    x = _prefixes(_ranked(form_sets, rarity), threshold)
    y = _prefixes(_ranked(entry_sets, rarity), threshold).select(F.col("k").alias("yk"), F.col("t").alias("yt"), F.col("n").alias("yn"), F.col("p").alias("yp"), "g")
    y = _small(y, size)
    small, large = F.least("n", "yn"), F.greatest("n", "yn")
    # what both can still share from the shared trigram on, and before it
    room = F.least(F.col("p"), F.col("yp")) + F.least(F.col("n") - F.col("p"), F.col("yn") - F.col("yp"))
    pairs = x.join(y, "g").filter(small >= F.lit(threshold) * large).filter(room * (1 + threshold) >= F.lit(threshold) * (F.col("n") + F.col("yn")))
    shared = F.size(F.array_intersect("t", "yt"))
    scored = pairs.dropDuplicates(["k", "yk"]).select("k", F.col("yk.entry").alias("entry"), (shared / (F.col("n") + F.col("yn") - shared)).alias("s")).filter(F.col("s") >= threshold)
    best = scored.groupBy("k").agg(F.min(F.struct((-F.col("s")).alias("s"), "entry")).alias("m"))
    return cleaned.join(best, cleaned["b"] == best["k"]).select("form", F.col("m.entry").alias("entry"), (-F.col("m.s")).alias("similarity"))


def entries_of(measure_list: DataFrame) -> DataFrame:
    """(entry, label): labels, listed other names and the common names of the list's entries."""
    rows = [(k, v) for k, vs in COMMON_NAMES.items() for v in vs]
    common = measure_list.sparkSession.createDataFrame(rows, "entry string, label string").join(measure_list.select(F.col("measure_id").alias("entry")), "entry", "left_semi")
    own = measure_list.select(F.col("measure_id").alias("entry"), F.explode(F.array_union(F.array("label"), F.coalesce("also_known_as", F.array().cast("array<string>")))).alias("label"))
    return own.unionByName(common)


def map_measures(facts: DataFrame, measure_list: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, form, measure_id, similarity) for ``facts(id, measure_surface_form)``; ``none`` where no entry is
    close enough. A form that is character by character a label has similarity 1. Repeated facts give
    repeated rows; a null form gives ``none``."""
    f = facts.select("id", F.col("measure_surface_form").alias("form"))
    forms = f.groupBy("form").agg(F.count("*").alias("n")).select("form")
    exact = measure_list.select(F.col("label").alias("form"), F.col("measure_id").alias("entry"), F.lit(1.0).alias("similarity")).dropDuplicates(["form"])
    forms = cut(forms)
    rest = closest(forms.join(exact, "form", "left_anti"), entries_of(measure_list), threshold)
    table = cut(exact.unionByName(rest))
    out = salted_join(f, table, "form", "left", spread="id")
    return out.select("id", "form", F.coalesce("entry", F.lit("none")).alias("measure_id"), "similarity")


def free_wordings(facts: DataFrame, measure_list: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, measure_id): facts whose wording is no label of the list, each id once."""
    labels = _small(measure_list.select(F.col("label").alias("measure_surface_form")).distinct(), measure_list.limit(BROADCAST_ENTRIES + 1).count())
    free = facts.join(labels, "measure_surface_form", "left_anti").filter("id is not null and measure_surface_form is not null")
    return map_measures(free, measure_list, threshold).select("id", "measure_id").distinct()
