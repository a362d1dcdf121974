"""Variant spellings of people and organisations: canonical rewritings and an equi-join on them.

Every distinct spelling is parsed once: look-alikes, case, titles, "Last, First" order, run-together
words, nicknames, shortened trade words and legal forms are undone by rule. The result is its full
rewriting (words in alphabetical order for people, brand and line of business for organisations).
Full rewritings generate every shorter rewriting that people type: initials for any of a person's
words but one, first and last name alone, and the brand without its line of business. Spellings that are themselves short meet
the full ones in an equi-join on the rewriting, scored by its rarity: one entity behind it scores 1,
two score 1/2, and only a score above 1/2 links. Single typos are a rewriting too: with one letter left
out, exploded and equi-joined, then checked by edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash
from ..operators.skew import salted_join
from ..session import cut
from .unify import unify

#: Common English and Indian short names and the full name.
NICKNAMES = {
    "alexander": "alex sandy sasha xander", "christopher": "chris kit topher", "deborah": "deb debbie debby", "elizabeth": "beth betty eliza liz lizzie",
    "francesca": "fran frankie francie", "gregory": "greg", "harold": "harry hal", "isabella": "bella izzy isa", "jennifer": "jen jenny", "joseph": "joe joey jo",
    "katherine": "kate kathy katie kat kit", "lawrence": "larry laurie", "margaret": "maggie meg peggy marge", "nicholas": "nick nicky nico",
    "oliver": "ollie olly", "patricia": "pat patty trish tricia", "robert": "bob bobby rob robbie", "samuel": "sam sammy", "theodore": "ted teddy theo",
    "umashankar": "uma", "victoria": "vicky vicki tori", "william": "bill billy will willy", "yogesh": "yogi", "zachary": "zach zack zac",
    "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck", "daniel": "dan danny", "david": "dave davy",
    "edward": "ed eddie ned", "james": "jim jimmy jamie", "john": "jack johnny", "jonathan": "jon", "matthew": "matt", "michael": "mike mick mickey",
    "peter": "pete", "richard": "dick rich rick", "stephen": "steve", "susan": "sue susie", "thomas": "tom tommy", "timothy": "tim", "rajesh": "raj",
    "venkatesh": "venky", "krishnan": "krish", "subramanian": "subbu", "rebecca": "becky", "barbara": "barb", "dorothy": "dot dolly", "catherine": "cathy",
}
#: Trade words. How they are shortened is read off the data (see ``_shortened``).
TRADES = (
    "chemicals manufacturing industries engineering foods technologies transport services pharmaceuticals international holdings infrastructure logistics freightways enterprises "
    "finance securities textiles systems solutions trading traders consultants consulting energy power steel cement motors exports imports electronics construction constructions "
    "laboratories insurance bank shipping airlines retail media group brothers associates"
).split()
#: Titles and legal forms.
TITLES = "m/s messrs dr prof adv mr mrs ms shri smt sri sir er ca".split()
LEGAL = "private pvt limited ltd llp inc plc corp co lp gmbh".split()
SELF = {"company"}
#: A trade word is shortened to so many letters at least.
SHORTENED = 2
#: Brands that must use a shortened trade word beside the full one before it is read so everywhere, and how many such
#: words are read at most.
LEAST_BRANDS, LEARNT = 2, 10_000
#: Words from this length on may be a trade word or legal form with a typo; shorter ones are too often another word.
TYPO_WORD = 5
#: Rewritings from this length on (letters and separators) may be each other's typo; shorter ones differ by a letter too easily.
TYPO_KEY = 9
#: Names up to so many words have all their initial forms as rewritings (2 to that power); longer ones are met by
#: all their initials and checked word by word, which for so many letters is as rare.
SPELT_OUT = 5
_FULL = {n: full for full, ns in NICKNAMES.items() for n in ns.split()}
_TRADE = {t: t for t in TRADES}


def within_one(a: str, b: str) -> bool:
    """Equal but for one letter more, less or other, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


_by_trade_letter: dict[str, list[str]] = {}
for _t in TRADES:
    if len(_t) >= TYPO_WORD:
        _by_trade_letter.setdefault(_t[0], []).append(_t)


def _trade(word: str, learnt: dict[str, str]) -> str | None:
    full = _TRADE.get(word) or learnt.get(word)
    if full is None and len(word) >= TYPO_WORD:
        near = _by_trade_letter.get(word[0], [])
        full = next((t for t in near if within_one(t, word)), None) or next((t for ts in _by_trade_letter.values() for t in ts if within_one(t, word)), None)
    return full


def _is_legal(word: str) -> bool:
    return word in LEGAL or len(word) >= TYPO_WORD and (within_one(word, "limited") or within_one(word, "private"))


def shortens(short: str, full: str) -> bool:
    """Whether ``short`` is left of ``full`` when letters after the first are left out: "tpt" of "transport"."""
    if short == full:
        return True
    if not SHORTENED <= len(short) < len(full) or short[0] != full[0]:
        return False
    rest = iter(full)
    return all(c in rest for c in short)


def rewrite(form: str, kind: str | None = None, learnt: dict[str, str] | None = None) -> tuple[str, str, list[str], list[str]] | None:
    """(kind, full rewriting, short rewritings, splits) of one spelling; None where it names nobody.

    ``form`` has its look-alikes and hidden characters undone. ``kind`` is person or organisation where
    known; otherwise a trade word or legal form makes an organisation. A short spelling (initials, a
    brand alone) has kind ``person?`` or ``organisation?``. The splits of an organisation are its words as a brand
    and a rest that may be shortened trade words, as ``brand|rest``. ``learnt`` gives shortened trade words.
    """
    learnt = learnt or {}
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", form)
    s = re.sub(r"\bl\.\s?l\.\s?p\b\.?", "llp", s.lower())
    s = re.sub(r"\(p\)", " pvt ", s).replace("int'l", "intl")
    if s.count(",") == 1:
        last, first = s.split(",")
        s = f"{first} {last}"
    words = [w for w in re.split(r"[^\w/']+", s.replace("_", " ")) if w]
    while len(words) > 1 and words[0].rstrip(".") in TITLES:
        words = words[1:]
    body = [w for w in words if not _is_legal(w)] or words
    legal = len(body) < len(words) and (len(words) - len(body) > 1 or any(_is_legal(w) and len(w) > 1 for w in words))
    trades = [t for t in (_trade(w, learnt) for w in body) if t]
    if len(words) >= 1 and words[-1] in SELF and words[0] in ("the", "your", "our", "company"):
        return None
    known_first = any(w in NICKNAMES or w in _FULL for w in body)
    if kind == "organisation" or kind is None and (legal or trades or len(body) > 1 and not known_first and all(len(w) > 1 for w in body)):
        brand = [w for w in body if not _trade(w, learnt)]
        if not brand:
            brand, trades = body, []
        name, trade = "".join(brand), " ".join(trades)
        splits = [f"{''.join(body[:i])}|{' '.join(body[i:])}" for i in range(1, len(body)) if not all(_trade(w, learnt) for w in body[i:])]
        if not trade:
            return "organisation?", f"o|{name}|", [], splits
        return "organisation", f"o|{name}|{trade}", [f"o|{name}|"], splits
    people = [_FULL.get(w, w) for w in body]
    if len(people) > 1 and any(len(w) == 1 for w in people):
        return "person?", "p|" + " ".join(sorted(people)), [], []
    short: set[str] = set()
    k = len(people)
    if 1 < k <= SPELT_OUT:
        for mask in range(1, 2**k - 1):
            short.add("p|" + " ".join(sorted(w[0] if mask >> i & 1 else w for i, w in enumerate(people))))
    if k > 2:  # first and last name alone
        short |= {"p|" + " ".join(sorted(x)) for x in ((people[0], people[-1]), (people[0][0], people[-1]))}
    return "person", "p|" + " ".join(sorted(people)), sorted(short), []


def _parse(learnt: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for form, clean, kind, n in zip(pdf["form"], pdf["clean"], pdf["kind"], pdf["n"]):
                r = rewrite(clean, kind if isinstance(kind, str) else None, learnt) if isinstance(clean, str) and clean else None
                if r:
                    rows.append((form, n, *r))
            yield pd.DataFrame(rows, columns=["form", "n", "kind", "key", "short", "splits"])

    return run


def parse_forms(facts: DataFrame) -> DataFrame:
    """(form, n facts, kind, key, short rewritings, splits) of each distinct spelling of ``facts(subject_surface_form,
    subject_type)``: parsed once to see how trade words are shortened, and again knowing that."""
    f = facts.filter("subject_surface_form is not null").groupBy(F.col("subject_surface_form").alias("form")).agg(F.count("*").alias("n"), F.max("subject_type").alias("kind"))
    f = cut(f.select("form", "n", "kind", squash(unify("form")).alias("clean")))
    schema = "form string, n long, kind string, key string, short array<string>, splits array<string>"
    pairs = _spelt_out(f.mapInPandas(_parse({}), schema))
    words = pairs.select("brand", F.explode(F.arrays_zip(F.split("rest", " ").alias("w"), F.split("trades", " ").alias("t"))).alias("x")).filter("x.w <> x.t")
    votes = words.groupBy("x.w", "x.t").agg(F.count_distinct("brand").alias("n")).filter(F.col("n") >= LEAST_BRANDS)
    best = votes.groupBy("w").agg(F.max_by("t", F.struct("n", "t")).alias("t"), F.max("n").alias("n"))
    # the most used ones; whatever else is shortened still meets its own brand's full name in ``_shortened``
    learnt = {r["w"]: r["t"] for r in best.orderBy(F.desc("n"), "w").limit(LEARNT).collect()}
    return f.mapInPandas(_parse(learnt), schema)


def _less_one(key: str):
    """The rewriting without separators and with each of its letters left out once, and itself."""
    c = F.regexp_replace(F.col(key), r"[ |']", "")
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_union(F.array(c), cut)


def _near(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, other): keys of ``a(key)`` and ``b(other)`` one typo apart. A bucket holds the spellings that
    differ in one place, so it is as small as the alphabet."""
    x = a.filter(F.length("key") >= TYPO_KEY).select("key", F.explode(_less_one("key")).alias("v"))
    y = b.filter(F.length("other") >= TYPO_KEY).select("other", F.explode(_less_one("other")).alias("v"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = str.maketrans("", "", " |'")
        for pdf in batches:
            ok = [a[:2] == b[:2] and within_one(a.translate(squeeze), b.translate(squeeze)) for a, b in zip(pdf["key"], pdf["other"])]
            yield pdf[pd.Series(ok, index=pdf.index, dtype=bool)]

    pairs = x.join(y, "v").filter("key <> other").select("key", "other").distinct()
    return pairs.mapInPandas(check, "key string, other string")


def abbreviates(short: list[str], full: list[str]) -> bool:
    """Whether every word of ``short`` is a word of ``full`` or the first letter of one, each word used once."""
    left = list(full)
    for w in sorted(short, key=len, reverse=True):  # whole words first: an initial may take any that is left
        hit = w if w in left else next((x for x in left if len(w) == 1 and x[0] == w), None)
        if hit is None:
            return False
        left.remove(hit)
    return not left


def _long_names(short: DataFrame, root: DataFrame) -> DataFrame:
    """(key, root): names of more than SPELT_OUT words with initials, and the one subject they can stand for."""
    words = F.split(F.substring("key", 3, 1 << 30), " ")
    many = lambda df: df.filter(F.col("key").startswith("p|") & (F.size(words) > SPELT_OUT)).withColumn("i", F.array_join(F.array_sort(F.transform(words, lambda w: F.substring(w, 1, 1))), ""))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [abbreviates(a[2:].split(" "), b[2:].split(" ")) for a, b in zip(pdf["key"], pdf["full"])]
            yield pdf.loc[pd.Series(ok, index=pdf.index, dtype=bool), ["key", "root"]]

    full = many(root.select("key", "root")).select("i", F.col("key").alias("full"), "root")
    hits = many(short.select("key")).join(full, "i").filter("key <> full").select("key", "full", "root").mapInPandas(check, "key string, root string")
    return hits.groupBy("key").agg(F.min("root").alias("root"), F.count_distinct("root").alias("k")).filter("k = 1").select("key", "root")


def _spelt_out(forms: DataFrame) -> DataFrame:
    """(key, full, brand, rest, trades): organisations of ``forms(key, splits)`` whose last words may be shortened trade
    words of another with the same brand. An equi-join on the brand and the words' first letters, which shortening keeps,
    so a brand of very many names makes no pairs of all of them; then a check word by word."""
    brand = lambda c, p: F.split(F.col(c), r"\|")[p]
    letters = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)), "")
    own = forms.filter("key like 'o|%'").select("key", "splits")
    full = own.select(F.col("key").alias("full"), brand("key", 1).alias("brand"), brand("key", 2).alias("trades")).filter("trades <> ''").distinct().withColumn("i", letters("trades"))
    split = own.select("key", F.explode("splits").alias("s")).distinct().select("key", brand("s", 0).alias("brand"), brand("s", 1).alias("rest")).withColumn("i", letters("rest"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(a.split(" "), b.split(" ")) for a, b in zip(pdf["rest"], pdf["trades"])]
            yield pdf[pd.Series([len(a) == len(b) and all(map(shortens, a, b)) for a, b in pairs], index=pdf.index, dtype=bool)]

    hits = split.join(full, ["brand", "i"]).filter("key <> full").select("key", "full", "brand", "rest", "trades")
    return hits.mapInPandas(check, "key string, full string, brand string, rest string, trades string")


def _shortened(keys: DataFrame, root: DataFrame) -> DataFrame:
    """(key, root): organisations whose last words are shortened trade words of one subject of the same brand."""
    hits = _spelt_out(keys).join(root.select(F.col("key").alias("full"), "root"), "full")
    return hits.groupBy("key").agg(F.min("root").alias("root"), F.count_distinct("root").alias("k")).filter("k = 1").select("key", "root")


def entities(facts: DataFrame) -> DataFrame:
    """(form, entity): each spelling of ``facts(subject_surface_form, subject_type)`` with its subject's full rewriting.

    Spellings that only say "the/your/our company", and null or blank ones, are left out. A short
    spelling behind which there are two subjects, or none, keeps an entity of its own rewriting.
    """
    forms = cut(parse_forms(facts))  # parsed spellings
    keys = forms.groupBy("key", "kind").agg(F.sum("n").alias("n"), F.first("short").alias("short"), F.array_distinct(F.flatten(F.collect_set("splits"))).alias("splits"))
    keys = cut(keys)
    full = cut(keys.filter("kind in ('person', 'organisation')").groupBy("key").agg(F.sum("n").alias("n"), F.first("short").alias("short")))
    rank = lambda p: F.struct(F.col(f"{p}n"), F.col(f"{p}key"))
    # a typo belongs to the most frequent rewriting one typo away, if that is more frequent than itself
    near = _near(full.select("key"), full.select(F.col("key").alias("other")))
    sized = near.join(full.select("key", "n"), "key").join(full.select(F.col("key").alias("other"), F.col("n").alias("on")), "other")
    better = sized.filter((F.col("on") > F.col("n")) | ((F.col("on") == F.col("n")) & (F.col("other") < F.col("key"))))
    parent = cut(better.groupBy("key").agg(F.max_by("other", F.struct("on", "other")).alias("up")))
    root = full.join(parent, "key", "left").select("key", "n", "short", F.coalesce("up", "key").alias("root"))
    # every hop leads to a more frequent rewriting, so the chains end
    hop = parent.select(F.col("key").alias("root"), F.col("up").alias("above"))
    while True:
        step = cut(root.join(hop, "root", "left").select("key", "n", "short", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        root = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    # rewritings that may stand for a subject; rarity = subjects behind the rewriting
    rewritings = root.select("root", F.explode("short").alias("r")).distinct()
    rarity = cut(rewritings.groupBy("r").agg(F.count("*").alias("subjects"), F.min("root").alias("root")))
    # besides the short spellings, a two-word name may be a longer one without its middle
    two = keys.filter("kind = 'person'").filter(F.size(F.split("key", " ")) == 2)
    short = keys.filter("kind in ('person?', 'organisation?')").select("key").unionByName(two.select("key")).distinct()
    hits = cut(short.join(rarity, short["key"] == rarity["r"], "left").select("key", "root", (F.lit(1.0) / F.col("subjects")).alias("score")))
    missed = hits.filter("score is null").select("key").join(root.select("key"), "key", "left_anti")
    typo = _near(missed, rarity.filter("subjects = 1").select(F.col("r").alias("other"))).join(rarity.select(F.col("r").alias("other"), "root"), "other")
    typo = typo.groupBy("key").agg(F.min("root").alias("root"), F.count_distinct("root").alias("k")).filter("k = 1")
    linked = hits.filter("score > 0.5").select("key", "root").unionByName(typo.select("key", "root")).unionByName(_long_names(missed, root))
    # what a shortened trade word spells out goes before what the brand with that word as a part of it may be
    spelt = cut(_shortened(keys, root))
    linked = linked.join(spelt, "key", "left_anti").unionByName(spelt)
    linked = linked.groupBy("key").agg(F.min("root").alias("root"))
    linked = cut(linked.select("key", F.col("root").alias("longer")))
    table = root.select("key", "root").join(linked, "key", "full").select("key", F.coalesce("longer", "root").alias("root"))
    # typos of a two-word name follow it to the longer name
    table = table.join(linked.select(F.col("key").alias("root"), "longer"), "root", "left").select("key", F.coalesce("longer", "root").alias("root"))
    return forms.join(table, "key", "left").select("form", F.coalesce("root", "key").alias("entity"))


def spelling_pairs(facts: DataFrame) -> DataFrame:
    """(form_a, form_b): every two different spellings of one subject, the smaller first. The result is
    one row per pair by definition; it grows with the spellings of a subject, not with its facts."""
    e = cut(entities(facts))
    a, b = e.select("entity", F.col("form").alias("form_a")), e.select("entity", F.col("form").alias("form_b"))
    return salted_join(a, b, "entity", spread="form_a").filter("form_a < form_b").select("form_a", "form_b").distinct()
