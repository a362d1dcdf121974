import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import mixing, topics


def test_capped_poisson():
    for cap in (1, 2, 4):
        for mean in (0.1, 0.5 * cap, 0.9 * cap):
            lam = mixing.rate_for(mean, cap)
            assert abs(mixing.capped_mean(lam, cap) - mean) < 1e-9
            draws = np.minimum(np.random.default_rng(1).poisson(lam, 200_000), cap)
            assert abs(draws.mean() - mean) < 0.02


def test_whole_texts_are_counted(spark):
    """A text's tokens do not depend on where it could be cut: joined texts count as the tokenizer counts the whole."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["ab" * 40_000, "x" + " " * 70_000 + "y", "word " * 30_000, "", None, "a<|endoftext|>b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", mixing.count_tokens("t").alias("n")).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_the_plan_adds_up_what_the_mix_holds(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice("ab"), "word " * rng.randrange(1, 40)) for i in range(800)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 5)], "source string, target_share double, max_repeats int")
    chosen, _ = mixing.plan(df, targets)
    assert {x["source"]: x["tokens"] for x in chosen} == {r.source: r.tokens for r in mixing.shares(df, targets).collect()}


def test_mix_meets_its_shares(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small"]), "word " * rng.randrange(1, 60)) for i in range(3000)] + [(9001, None, "x"), (9002, "other", "x"), (9003, "big", None), (9004, "big", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 2), ("mid", 0.4, 2), ("small", 0.2, 4), ("absent", 0.5, 3)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.shares(df, targets).collect()}
    assert set(rows) == {"big", "mid", "small"}
    for s, want in (("big", 0.4), ("mid", 0.4), ("small", 0.2)):
        assert abs(rows[s].actual_share - want) < 0.01 and rows[s].most_repeats <= {"small": 4}.get(s, 2)
    m = mixing.mix(df, targets).collect()
    assert sum(r.copies for r in rows.values()) == len(m) and len({(r.doc_id, r.copy_no) for r in m}) == len(m)
    assert [tuple(r)[:3] for r in mixing.mix(df.repartition(5), targets).orderBy("doc_id", "copy_no").collect()] == sorted((r.doc_id, r.source, r.copy_no) for r in m)
    assert mixing.mix(df.limit(0), targets).count() == 0


AREAS = {"sport": "match goal team coach league striker referee stadium", "law": "court judge appeal statute counsel verdict tribunal plaintiff", "food": "wheat harvest bakery flour orchard dairy farmer barley"}


def make(rng, mixture, n):
    out = []
    for _ in range(n):
        words = AREAS[rng.choice(mixture)].split()
        out.append(f"The {rng.choice(words)} and the {rng.choice(words)} were noted by the {rng.choice(words)} in {rng.randrange(1990, 2024)}.")
    return out


def test_subjects(spark):
    rng = random.Random(9)
    docs, truth, labels = [], {}, []
    for i in range(360):
        areas = rng.sample(sorted(AREAS), rng.choice([1, 1, 2]))
        text = [s for a in areas for s in make(rng, [a], 5)] + ["This page has been left blank on purpose."] * 2
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        truth[i] = set(areas)
        if i % 3 == 0:
            labels.append((i, areas[0]))
    docs += [(900, None), (901, ""), (902, "This page has been left blank on purpose."), (None, "match goal")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(1, "nonsense"), (2, None)], "doc_id long, area string")
    al = spark.createDataFrame([(a, "") for a in AREAS], "area string, description string")
    got = {}
    for r in topics.subjects(df, lab, al).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    assert not {900, 901, 902} & set(got)
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.9 * len(truth)


def test_copies_make_no_boilerplate(spark):
    rng = random.Random(10)
    docs, truth, labels = [], {}, []
    for i in range(240):
        area = rng.choice(sorted(AREAS))
        docs.append((i, " ".join(make(rng, [area], 8) + ["This page has been left blank on purpose."])))
        truth[i] = {area}
        labels.append((i, area))
    text = [f"{s[:-1]} under rule {'ivxlcdm'[k % 7] * (k + 1)}." for k, s in enumerate(make(rng, ["law"], 12))] + ["This page has been left blank on purpose."]
    for i in range(300, 420):
        # half are exact copies, half have one sentence changed
        near = [f"{s[:-1]} anew{i}." if i % 2 and k == i % 12 else s for k, s in enumerate(text)]
        docs.append((i, " ".join(near)))
        truth[i] = {"law"}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    al = spark.createDataFrame([(a, "") for a in AREAS], "area string, description string")
    got = {}
    for r in topics.subjects(df, spark.createDataFrame(labels, "doc_id long, area string"), al).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    assert all(got.get(i) == {"law"} for i in range(300, 420))
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.9 * len(truth)
    bags = df.mapInArrow(topics._bags(np.zeros(0, np.uint64)), topics._BAG)
    copy, page = (np.concatenate([r["keys"] for r in bags.filter(f"doc_id = {i}").collect()]) for i in (300, 0))
    boiler = topics.boilerplate(bags)
    assert page[-1] in boiler and copy[-1] == page[-1] and not set(copy[:-1]) & set(boiler)


def test_subjects_read_all_labels_and_documents(spark, monkeypatch):
    """The few documents and labels of one area come last by the hash of their ids, where a bounded number of either would end."""
    rng, n = random.Random(12), 20_400
    ids = [r.id for r in spark.range(n).orderBy(F.xxhash64("id")).collect()]
    truth = {i: "law" if k >= n - 60 else ("food", "sport")[k % 2] for k, i in enumerate(ids)}
    df = spark.createDataFrame([(i, " ".join(make(rng, [a], 2))) for i, a in truth.items()], "doc_id long, text string")
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, area string")
    fitted, fit = [], topics.fit
    monkeypatch.setattr(topics, "fit", lambda *a: fitted.append(fit(*a)) or fitted[0])
    got = {}
    for r in topics.subjects(df, labels, spark.createDataFrame([(a, "") for a in AREAS], "area string, description string")).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    for area in AREAS:
        of = [i for i, a in truth.items() if a == area]
        assert sum(got.get(i) == {area} for i in of) >= 0.9 * len(of)
    words = 2 * 11 * n  # of two sentences of eleven words, numbers left out
    assert abs((fitted[0] - topics.ETA).sum() / words - 1) < 1e-3


def test_terms_of_a_document_count_by_their_uses():
    """Distinct terms with their uses give the expected counts that single words give."""
    rng = np.random.default_rng(4)
    doc, term = np.sort(rng.integers(0, 70, 3000)), rng.integers(0, 40, 3000)
    beta = topics._log_mean(rng.gamma(1, 1, (5, topics.TERMS)) + topics.ETA)
    d, t, uses = topics._distinct(doc, term)
    gamma, phi = topics.infer(d, t, uses, 71, beta)
    one, each = topics.infer(doc, term, np.ones(3000), 71, beta)
    assert uses.sum() == 3000 and len(d) == len(set(zip(doc, term))) and np.allclose(gamma, one, rtol=1e-3)
    assert np.allclose([np.bincount(t, phi[:, k] * uses, 40) for k in range(5)], [np.bincount(term, each[:, k], 40) for k in range(5)], rtol=1e-3)
    assert np.all(gamma[70] == np.float32(topics.ALPHA))
