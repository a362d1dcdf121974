"""Quantities recorded in different units, brought to common units through a graph of sources.

The sources are the spellings in which quantities are written: the wording around the number in a
value's text, and the wordings in the fact's unit, currency and scale fields. Two sources are linked by
the entities that both state: a fact that gives its number in its text and again in its fields, and
claims (subject, measure, period) that several filings state. Per pair of sources the scale is the
median ratio of the two numbers, snapped to a known conversion, and the offset the median residual,
snapped to none (no unit of the list has an offset); pairs that do not snap, or whose facts mostly
disagree with it, are no edges. Meanings start at the listed codes and flow along the edges, converted by
each edge's scale and by majority of facts, until nothing changes. A standard spelling counts as one
fact, so data outvote it. Wordings that no edge reaches are put together from two solved spellings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain, squash
from ..session import cut, written
from .skew import salted_join

#: Standard spellings (lower case, without dots) of the codes in unit lists.
SPELLINGS = {
    "INR": "₹|rs|inr|rupee|rupees", "USD": "$|us$|usd|dollar|dollars|us dollars", "EUR": "€|eur|euro|euros",
    "GBP": "£|gbp|pound sterling|pounds sterling",
    "g": "g|gm|gms|gram|grams", "kg": "kg|kgs|kilogram|kilograms", "quintal": "quintal|quintals|qtl|qtls",
    "tonne": "t|mt|tonne|tonnes|metric ton|metric tons|metric tonnes", "lb": "lb|lbs|pound|pounds",
    "m": "m|mtr|mtrs|metre|metres|meter|meters", "km": "km|kms|kilometre|kilometres|kilometer|kilometers", "mile": "mi|mile|miles",
    "sq_m": "sq_m|sq m|sq mtr|sq mtrs|m²|sqm|square metre|square metres|square meters", "sq_ft": "sq_ft|sq ft|sft|sqft|ft²|square foot|square feet",
    "acre": "ac|acre|acres", "hectare": "ha|hectare|hectares",
    "kwh": "kwh|kilowatt hour|kilowatt hours|units (kwh)", "mwh": "mwh|megawatt hour|megawatt hours", "gwh": "gwh|gigawatt hour|gigawatt hours",
    "minute": "min|mins|minute|minutes", "hour": "h|hr|hrs|hour|hours", "day": "d|day|days",
    "bps": "bp|bps|basis point|basis points", "percent": "%|percent|per cent|pct", "ratio": "ratio|as a fraction of one",
    "thousand": "thousand|thousands|k|'000", "lakh": "lakh|lakhs|lac|lacs", "million": "million|millions|mn|mio",
    "crore": "crore|crores|cr", "billion": "billion|billions|bn",
}
#: A ratio, or a residual against the number, is taken for a known one within this share.
CLOSE = 1e-3
#: Least share of an edge's facts that must state the snapped conversion.
AGREEMENT = 0.5
#: Facts that claims of different filings must link two wordings by, as their numbers may differ for other reasons.
LEAST_CLAIMS = 3
#: Rows up to which the table of wordings is broadcast; a longer one is joined by shuffle with salts.
BROADCAST_ROWS = 200_000
MAX_ROUNDS = 64
SLOTS = ("unit", "currency", "scale")
_NUMBER = r"\(?\s*[-−+]?\s*\(?\s*\d[\d,]*(?:\.\d+)?\s*\)?"


def wording(text: Column) -> Column:
    """A spelling for comparison: folded, lower case, no dots, single spaces; nothing left gives null."""
    return F.nullif(squash(F.lower(F.replace(plain(text), F.lit("."), F.lit("")))), F.lit(""))


def _number(token: Column) -> Column:
    """The signed number of a token; brackets or a leading minus mean minus."""
    value = F.regexp_replace(token, r"[^\d.]", "").try_cast("decimal(24,6)")
    return F.when(token.rlike("[-−]") | (token.contains("(") & token.contains(")")), -value).otherwise(value)


_STATED = (
    r"(?i)\ball figures in\s+(.+?)\s+-(?:\s|[.!?]|$)"
    r"|\(in\s+((?:[^()]|\([^()]*\))+)\)"
    r"|\[\s*([^\]\[]*[^\]\[\d\s][^\]\[]*)\]"
)


def stated(sentence: Column) -> Column:
    """The unit wording that a sentence names apart from its number: ``(in X)``, ``[X]`` or
    ``all figures in X``; brackets that hold only a number (foot notes) name none."""
    return wording(F.regexp_replace(F.regexp_extract(plain(sentence), _STATED, 0), r"(?i)^all figures in\s+|^\(in\s+|^\[|\s+-[\s.!?]*$|[\])]$", ""))


def _claims(facts: DataFrame) -> DataFrame:
    """(id, block_id, char_start, char_end, doc, claim, given, number, w_raw, w_unit, w_currency, w_scale,
    w_quote): numeric facts by id. Wordings are read before repeats are dropped, so that no text is shuffled.
    Each step of the parse is a projection of its own, so no part of it is worked out twice."""
    # what links filings is only compared for equality
    own = [F.xxhash64(c).alias(a) if c in facts.columns else F.lit(None).cast("long").alias(a) for c, a in (("doc_id", "doc"), ("claim_key", "claim"))]
    own[1] = F.when(F.col("claim_key").isNotNull(), own[1]).alias("claim") if "claim_key" in facts.columns else own[1]
    f = facts.filter("fact_type = 'numeric' and id is not null").select(
        "id", "block_id", "quote", "char_start", "char_end", *own, F.col("value_number").alias("given"),
        squash(plain(F.col("value_raw"))).alias("raw"),
        *[wording(F.col(f"value_{s}")).alias(f"w_{s}") for s in SLOTS],
    )
    f = f.withColumn("token", F.nullif(F.regexp_extract("raw", _NUMBER, 0), F.lit("")))
    at = F.instr("raw", F.col("token"))
    around = F.concat(F.expr("substring(raw, 1, instr(raw, token) - 1)"), F.lit(" "), F.expr("substring(raw, instr(raw, token) + length(token))"))
    f = f.withColumns(
        {
            "number": F.coalesce(_number(F.col("token")), F.col("given").try_cast("decimal(24,6)")),
            "w_raw": wording(F.when(F.col("token").isNull(), F.col("raw")).when(at > 0, around)),
        }
    )
    f = f.filter("number is not null").withColumn("w_quote", F.when(_bare(), stated(F.col("quote"))))
    return f.drop("raw", "token", "quote").dropDuplicates(["id"])


def _bare() -> Column:
    """No unit or currency in the text and the fields; a scale word alone names none."""
    scales = [w for c in ("thousand", "lakh", "million", "crore", "billion") for w in SPELLINGS[c].split("|")]
    return F.coalesce("w_unit", "w_currency").isNull() & (F.col("w_raw").isNull() | F.col("w_raw").isin(scales))


def _codes(units: DataFrame) -> DataFrame:
    """(code, slot, kind, factor): the listed codes; codes of one kind convert into each other."""
    slot = F.when(F.col("dimension") == "scale", "scale").when(F.col("dimension") == "money", "currency").otherwise("unit")
    return units.filter("unit is not null").select(
        F.col("unit").alias("code"), slot.alias("slot"), F.coalesce("common_unit", "dimension").alias("kind"), F.coalesce("factor", F.lit(1.0)).alias("factor")
    ).dropDuplicates(["code"])


def _anchors(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, slot, code) of the listed codes, and of their standard spellings."""
    codes = _codes(units)
    known = units.sparkSession.createDataFrame([(s, code) for code, ss in SPELLINGS.items() for s in ss.split("|")], "w string, code string")
    listed = codes.select(F.lower("code").alias("w"), "slot", "code").dropDuplicates(["w", "slot"])
    standard = known.join(F.broadcast(codes), "code").select("w", "slot", "code").distinct()
    return listed, standard.join(listed, ["w", "slot"], "left_anti")


def _conversions(codes: DataFrame) -> list[tuple[str, float, str]]:
    """(code, factor, to): every pair of codes of one kind, ``to`` being ``factor`` times as large. The list of units is a
    fixed table of a few rows; a scale may also stand beside no scale, whose code is empty."""
    rows = [(r["code"], r["kind"], r["factor"]) for r in codes.collect()] + [("", "scale", 1.0)]
    return sorted((x, float(f"{g / f:.12g}"), y) for x, k, f in rows for y, j, g in rows if k == j)


def _snapped_edges(seen: DataFrame, keys: list[str], ratios: list[float]) -> DataFrame:
    """(keys, n, factor) of ``seen(keys, x, y)``: robust scale of y against x, and offset, both snapped."""
    seen = seen.filter("x <> 0 and y <> 0").withColumn("ratio", F.col("y") / F.col("x"))
    e = seen.groupBy(*keys).agg(F.percentile_approx("ratio", 0.5, 1000).alias("ratio"))
    near = F.filter(F.array(*map(F.lit, ratios)), lambda f: F.abs(F.col("ratio") / f - 1) < CLOSE)
    e = e.select(*keys, F.try_element_at(near, F.lit(1)).alias("factor")).filter("factor is not null")
    off = (F.col("y") - F.col("factor") * F.col("x")) / F.abs("y")
    fit = seen.join(e, keys).groupBy(*keys, "factor").agg(F.percentile_approx(off, 0.5, 1000).alias("offset"), F.count_if(F.abs(off) < CLOSE).alias("agreed"), F.count("*").alias("n"))
    return fit.filter((F.abs("offset") < CLOSE) & (F.col("agreed") >= AGREEMENT * F.col("n"))).select(*keys, F.col("agreed").alias("n"), "factor")


#: The slot of an edge between two wordings of one claim.
CLAIM = "claim"


def source_edges(claims: DataFrame, ratios: list[float]) -> DataFrame:
    """(w_raw, slot, w, scaled, n, factor): two sources that state one quantity, the number beside ``w_raw`` being ``factor``
    times the number beside ``w``.

    Within a fact, ``w`` is the spelling in the field of the slot (``scaled``: the fields name a scale). A unit beside
    a scale must agree as it is, as nobody could tell whose factor it is; a currency converts into none, so its
    factor is the scale's, also where the fields name no scale (``w`` is then empty). Across filings (slot
    CLAIM), ``w`` is the wording of the same claim in another filing: every fact of a claim is linked with the
    claim's first, so a claim with very many facts makes no pairs among them."""
    entry = lambda slot, w: F.struct(F.lit(slot).alias("slot"), w.alias("w"))
    none = F.when(F.col("w_currency").isNotNull() & F.col("w_scale").isNull(), F.lit(""))
    named = F.filter(F.array(*[entry(s, F.col(f"w_{s}")) for s in SLOTS], entry("scale", none)), lambda x: x["w"].isNotNull())
    y = F.col("number").cast("double").alias("y")
    fields = claims.filter("w_raw is not null and given is not null").select("w_raw", F.explode(named).alias("p"), F.col("w_scale").isNotNull().alias("scaled"), F.col("given").alias("x"), y)
    fields = fields.select("w_raw", "p.slot", "p.w", "scaled", "x", "y")
    c = claims.filter("claim is not null and doc is not null and w_raw is not null").select("id", "claim", "doc", "w_raw", y)
    first = c.groupBy("claim").agg(F.min_by(F.struct(F.col("doc").alias("d"), F.col("w_raw").alias("w"), F.col("y").alias("x")), F.struct("doc", "id")).alias("o"))
    other = c.join(first, "claim").filter("doc <> o.d and w_raw <> o.w").select("w_raw", "o.w", "o.x", "y")  # a hot claim is split by AQE
    both = F.inline(F.array(F.struct("w_raw", F.lit(CLAIM).alias("slot"), "w", F.lit(False).alias("scaled"), "x", "y"), F.struct(F.col("w").alias("w_raw"), F.lit(CLAIM).alias("slot"), F.col("w_raw").alias("w"), F.lit(False).alias("scaled"), F.col("y").alias("x"), F.col("x").alias("y"))))
    e = _snapped_edges(fields.unionByName(other.select(both)), ["w_raw", "slot", "w", "scaled"], ratios)
    slot, factor = F.col("slot"), F.col("factor")
    e = e.filter(~((slot == "unit") & F.col("scaled") & (factor != 1)) & ~((F.col("w") == "") & (factor == 1)) & ((slot != CLAIM) | (F.col("n") >= LEAST_CLAIMS)))
    return e.withColumn("factor", F.when(slot == "currency", 1.0).otherwise(factor))


def _carried(votes: DataFrame, conversions: DataFrame, by: Column) -> DataFrame:
    """``votes(code, ...)`` with the code that is ``by`` times as large; none such: no vote."""
    v = votes.withColumn("_by", by)
    close = F.abs(F.col("_by") / F.col("_f") - 1) < CLOSE
    return v.join(F.broadcast(conversions), (v["code"] == F.col("_c")) & close).withColumn("code", F.col("_t")).drop("_c", "_f", "_t", "_by")


def _majority(votes: DataFrame, *keys: str) -> DataFrame:
    """(keys, code, n, facts): the code with most votes per key; equal counts: the smaller code."""
    v = votes.groupBy(*keys, "code").agg(F.sum("n").alias("n"), F.sum("facts").alias("facts"))
    return v.groupBy(*keys).agg(F.min_by(F.struct("code", "n", "facts"), F.struct(-F.col("n"), "code")).alias("b")).select(*keys, "b.code", "b.n", "b.facts")


def solve_spellings(edges: DataFrame, units: DataFrame, conversions: list[tuple[str, float, str]]) -> DataFrame:
    """(side, w, slot, code, n, facts): meanings of the fields' spellings (side ``field``) and of whole texts' wordings
    (side ``text``), carried along ``source_edges`` until a round changes none of them. A claim's edge that converts
    carries to wordings of one slot only.

    ``facts`` counts the facts behind the code; it is 0 where only the standard spelling names it."""
    spark = units.sparkSession
    table = spark.createDataFrame(conversions, "_c string, _f double, _t string")
    listed, standard = _anchors(units)
    one = lambda df, facts: df.withColumns({"n": F.lit(1).cast("long"), "facts": F.lit(facts).cast("long")})
    # the code of "no scale", so that a text's scale can be told from plain numbers in the fields
    fixed = one(listed.unionByName(spark.createDataFrame([("", "scale", "")], "w string, slot string, code string")), 1)
    prior = one(standard, 0)
    side = lambda df, s: df.select(F.lit(s).alias("side"), "w", "slot", "code", "n", "facts")
    with written(spark) as keep:
        fixed, prior = keep(fixed), keep(prior)
        fields, claims = edges.filter(F.col("slot") != CLAIM), edges.filter(F.col("slot") == CLAIM).drop("slot", "scaled")
        across = not claims.isEmpty()
        known, whole, before = fixed.unionByName(prior), None, None
        for _ in range(MAX_ROUNDS):
            votes = _carried(fields.join(known.select("w", "slot", "code"), ["w", "slot"]), table, 1 / F.col("factor")).select("w_raw", "slot", "code", "n")
            if across and whole is not None:
                alone = whole.groupBy("w").agg((F.count_if(F.col("slot") != "currency") == 1).alias("alone"))
                near = claims.join(whole.select("w", "slot", "code"), "w").join(alone, "w").filter("factor = 1 or alone")
                by = F.when(F.col("slot") == "currency", 1.0).otherwise(1 / F.col("factor"))
                votes = votes.unionByName(_carried(near, table, by).select("w_raw", "slot", "code", "n"))
            texts = keep(_majority(votes.withColumn("facts", F.col("n")), "w_raw", "slot"))
            # a field that stands for a scale as well, as the text has one and no field does, is no single spelling
            held = texts.groupBy("w_raw").agg(F.bool_or((F.col("slot") == "scale") & (F.col("code") != "")).alias("held"))
            single = fields.filter("w <> ''").join(held, "w_raw").filter("scaled or not held")
            learnt = _carried(single.join(texts.select("w_raw", "slot", "code"), ["w_raw", "slot"]), table, F.col("factor")).select("w", "slot", "code", "n", F.col("n").alias("facts"))
            learnt = _majority(learnt.unionByName(prior.select("w", "slot", "code", "n", "facts")), "w", "slot").join(fixed, ["w", "slot"], "left_anti")
            whole = texts.withColumnRenamed("w_raw", "w")
            known = keep(side(fixed, "field").unionByName(side(learnt, "field"))).drop("side")
            sides = [known, whole] if across else [known]  # texts follow from the fields, and where claims link them from texts
            now = [tuple(x.agg(F.count("*"), F.sum(F.xxhash64("w", "slot", "code").cast("decimal(38,0)"))).first()) for x in sides]
            if now == before:
                return cut(side(whole, "text").unionByName(side(known, "field")))
            before = now
    raise RuntimeError(f"meanings still changed after {MAX_ROUNDS} rounds")


#: What may stand between two spellings.
_EDGE_LEFT, _EDGE_RIGHT = r"^[\s/,;:\-)\]]+", r"[\s/,;:\-(\[]+$"


def _put_together(wordings: DataFrame, atoms: DataFrame) -> DataFrame:
    """(w, codes per slot, n, facts) of wordings that are two spellings of different slots, by an equi-join on
    both parts of every split. Wordings longer than two spellings and a separator cannot be any."""
    longest = atoms.agg(F.coalesce(F.max(F.length("w")), F.lit(0))).first()[0]
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, _EDGE_LEFT, ""), _EDGE_RIGHT, "")
    w = F.col("w")
    cuts = F.sequence(F.lit(1), F.length("w") - 1)
    s = wordings.filter((F.length("w") > 1) & (F.length("w") <= 2 * longest + 8)).select("w", F.explode(cuts).alias("i"))
    s = s.select("w", F.substring(w, F.lit(1), F.col("i")).alias("a"), F.substring(w, F.col("i") + 1, F.length("w")).alias("b"))
    s = s.filter(~(F.col("a").rlike(r"\p{L}$") & F.col("b").rlike(r"^\p{L}"))).select("w", trim(F.col("a")).alias("a"), trim(F.col("b")).alias("b")).distinct()
    side = lambda p: atoms.select(F.col("w").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("slot", "code", "n", "facts")])
    j = s.join(side("a"), "a").join(side("b"), "b").filter("a_slot <> b_slot and (a_slot = 'scale' or b_slot = 'scale')")
    code = lambda slot: F.when(F.col("a_slot") == slot, F.col("a_code")).when(F.col("b_slot") == slot, F.col("b_code")).alias(slot)
    return j.select("w", *map(code, SLOTS), F.least("a_n", "b_n").alias("n"), F.least("a_facts", "b_facts").alias("facts"))


def meanings(claims: DataFrame, wordings: DataFrame, units: DataFrame) -> DataFrame:
    """(w, unit, currency, scale, solved_by): the codes of each distinct wording of ``wordings(w)``: a solved spelling
    of its own, else two of them put together, else what the facts that use the whole wording say.
    ``solved_by`` is ``graph`` where facts are behind every code, ``standard`` where a standard spelling stands alone."""
    conversions = _conversions(_codes(units))
    edges = cut(source_edges(claims, sorted({f for _, f, _ in conversions} | {1.0})))
    solved = solve_spellings(edges, units, conversions)
    atoms = solved.filter("side = 'field' and w <> ''")
    single = lambda slot: F.when(F.col("slot") == slot, F.col("code")).alias(slot)
    own = wordings.join(atoms, "w").select("w", F.lit(1).alias("way"), *map(single, SLOTS), "n", "facts")
    two = _put_together(wordings, atoms).select("w", F.lit(2).alias("way"), *SLOTS, "n", "facts")
    # of a unit and a currency that facts name beside one wording, the one of more facts
    of = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    w = solved.filter("side = 'text'").groupBy("w").agg(*[of(s, "code").alias(s) for s in SLOTS], of("unit", "n").alias("un"), of("currency", "n").alias("cn"), F.min("n").alias("n"), F.min("facts").alias("facts"))
    unit = F.col("currency").isNull() | (F.col("un") >= F.col("cn"))
    whole = w.select("w", F.lit(3).alias("way"), F.when(unit, F.col("unit")).alias("unit"), F.when(~unit | F.col("unit").isNull(), F.col("currency")).alias("currency"), F.nullif("scale", F.lit("")).alias("scale"), "n", "facts")
    every = own.unionByName(two).unionByName(whole.join(wordings, "w", "left_semi"))
    best = every.groupBy("w").agg(F.min_by(F.struct(*SLOTS, "facts"), F.struct("way", -F.col("n"), *[F.coalesce(s, F.lit("~")) for s in SLOTS])).alias("b"))
    return best.select("w", *[f"b.{s}" for s in SLOTS], F.when(F.col("b.facts") > 0, "graph").otherwise("standard").alias("solved_by"))


def to_common_units(facts: DataFrame, blocks: DataFrame, units: DataFrame) -> DataFrame:
    """(id, common_unit, common_value DECIMAL, named_in, solved_by): each numeric fact whose unit or currency is named.

    Each of unit, currency and scale is taken from the value's own text, else from the fact's fields,
    else from the quote, else from the quoted part of the block; a bare number for which none of them
    names a unit or currency gives no row. Of facts that repeat an id and blocks that repeat a key one
    counts. Null ids and numbers, empty tables and unknown wordings give no row. The sign is the text's:
    brackets or a minus. ``doc_id`` and ``claim_key`` of the facts link filings, where given.
    """
    names = ("w_raw", "w_unit", "w_currency", "w_scale")
    c = cut(_claims(facts))
    # only facts that still name nothing read their block
    needy = c.filter(_bare() & F.col("w_quote").isNull() & F.col("block_id").isNotNull()).select("id", "block_id", "char_start", "char_end")
    text = blocks.select(F.concat("doc_id", F.lit(":p"), "page_no", F.lit(":b"), "block_no").alias("block_id"), "text")
    quoted = stated(F.expr("substring(text, char_start + 1, char_end - char_start + 1)"))
    # a block that very many facts cite is split by AQE
    cited = needy.join(text, "block_id").select("id", quoted.alias("w_block")).filter("w_block is not null").dropDuplicates(["id"])
    c = cut(c.drop("block_id", "char_start", "char_end").join(cited, "id", "left"))
    every = [*names, "w_quote", "w_block"]
    each = cut(c.select(F.explode(F.array(*every)).alias("w")).filter("w is not null").distinct())
    table = cut(meanings(c, each, units))
    long = c.select("id", "number", F.posexplode(F.array(*every)).alias("source", "w")).filter("w is not null")
    m = long.join(F.broadcast(table), "w") if table.count() <= BROADCAST_ROWS else salted_join(long, table, "w", spread="id")
    ranked = m.groupBy("id", "number").agg(*[F.min(F.when(F.col(s).isNotNull(), F.struct("source", s, "solved_by"))).alias(s) for s in SLOTS])
    # a currency or unit in the value's text goes with the scale there or, where there is none, in the fields
    by_unit = F.col("unit.source") <= F.coalesce(F.col("currency.source"), F.lit(9))
    sources = F.array(*map(F.lit, ["text", "fields", "fields", "fields", "quote", "block"]))
    ranked = ranked.select(
        "id", "number", F.coalesce(F.when(by_unit, F.col("unit.unit")), F.col("currency.currency")).alias("code"), F.col("scale.scale").alias("scale_code"),
        F.element_at(sources, F.least(F.col("unit.source"), F.col("currency.source")) + 1).alias("named_in"),
        F.coalesce(F.when(by_unit, F.col("unit.solved_by")), F.col("currency.solved_by")).alias("solved_by"),
    ).filter("code is not null")
    listed = units.select("unit", "common_unit", "factor")
    u, s = F.broadcast(listed), F.broadcast(listed.select(F.col("unit").alias("scale_code"), F.col("factor").alias("scale_factor")))
    out = ranked.join(u, ranked["code"] == listed["unit"]).join(s, "scale_code", "left")
    factor = (F.col("factor").cast("decimal(22,8)") * F.coalesce(F.col("scale_factor"), F.lit(1.0)).cast("decimal(14,0)")).cast("decimal(22,8)")
    return out.select("id", "common_unit", (F.col("number") * factor).alias("common_value"), "named_in", "solved_by")
