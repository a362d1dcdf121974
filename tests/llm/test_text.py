import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import evidence, leaks, packing, words
from factloom.llm.unify import TOP, _expand, unify, unify_array


def brute(s):
    s = "".join(chr(y) for ch in s for y in (_expand(ord(ch)) if ord(ch) < TOP else ([] if 0xE0000 <= ord(ch) < 0xE1000 else [ord(ch)])))
    return re.sub(" +", " ", unicodedata.normalize("NFC", s))


def test_unify_against_string_calls():
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x20, 0x250), *list(range(0x300, 0x36F)) * 3, *range(0xAC00, 0xAC20), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3),
            0x200B, 0xFEFF, 0xA0, 0x2009, 0xFF21, 0xFB01, 0x1F600, 0xE0020, 0x430, 0x3B1]]
    rows = [None, "", "abc", "́x", "  a  b"] + ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(3000)]
    got = unify_array(pa.array(rows)).to_pylist()
    assert got == [None if r is None else brute(r) for r in rows]
    sliced = unify_array(pa.array(rows).slice(3, 50)).to_pylist()
    assert sliced == got[3:53]


def test_unify_is_idempotent_and_splits_long_rows():
    long = "ﬁ​ｅ é " * 400_000
    out = unify_array(pa.array([long, None, "Ｘ"]))
    assert out[0].as_py() == brute(long) and out[1].as_py() is None and out[2].as_py() == "X"
    assert unify_array(out).equals(out)


def test_disguised_quotes(spark):
    block = "In FY24, Café Ltd booked Ｒevenue of 5 m²."
    rows = [("same", "booked Ｒevenue"), ("wide", "booked Revenue"), ("hidden", "In FY​24,"), ("mark", "Café Ltd"), ("accent", "Cafe Ltd"), ("case", "booked revenue"),
            ("digit", "5 m2."), ("null", None), ("invisible", "​"), ("greek", "bοοked Revenue"), ("greek", "bοοked Revenue"), (None, "booked Revenue")]
    facts = spark.createDataFrame([(i, "d:p1:b0", q) for i, q in rows] + [("lost", "zz", "x")], "id string, block_id string, quote string")
    blocks = spark.createDataFrame([("d", 1, 0, block), ("d", 1, 0, block)], "doc_id string, page_no int, block_no int, text string")
    assert sorted(r.id for r in evidence.disguised_quotes(facts, blocks).collect()) == ["greek", "hidden", "mark", "wide"]
    assert evidence.disguised_quotes(facts.limit(0), blocks).count() == 0
    assert spark.range(1).select(unify(F.lit(None).cast("string")).alias("u")).first().u is None


def test_word_hashes():
    rows = ["The Cat, the CAT!", None, "", "ｃａｔ​ sat", "cat"]
    h, ends = words.word_hashes(pa.array(rows))
    assert list(ends) == [4, 4, 4, 6, 7] and h[0] == h[2] and h[1] == h[3] == h[4] == h[6] and len(set(h.tolist())) == 3


ITEM = "when the toll keeper compared one hundred kilns with two hundred kilns the granite tally differed by nine and the pilot agent explained"


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 30)))) for i in range(12)] + [(50, None), (51, ITEM)]
    docs = []
    for d in range(60):
        t = rng.choices(vocab, k=rng.randrange(0, 40))
        if d % 3 == 0:
            w = items[d % 12][1].split()
            k = rng.randrange(0, max(1, len(w) - 12))
            t += w[k : k + rng.randrange(11, 16)]
        docs.append((d, " ".join(t)))
    docs += [(100, ITEM.upper().replace(" ", "  ,\n")), (101, "x " + ITEM.replace("o", "о")), (102, None), (None, ITEM), (103, "")]
    runs = lambda t: {tuple(w[i : i + 13]) for w in [re.findall(r"[^\W_]+", (t or "").lower().replace("о", "o"))] for i in range(len(w) - 12)}
    want = {(d, i) for d, t in docs if d is not None for i, u in items if runs(t) & runs(u)}
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = leaks.leaks(dd, ii)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and (100, 51) in want and (101, 51) in want
    assert {(r.doc_id, r.item_id) for r in leaks.shared_runs(dd, ii).collect()} == want
    assert leaks.leaks(dd, ii.limit(0)).count() == 0 and leaks.leaks(dd.limit(0), ii).count() == 0


def test_near_leaks_reach_their_recall(spark):
    """Whole items with words replaced, inserted and left out, against the edit distance of every window."""
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([8, 20, 40])))) for i in range(60)]
    docs = []
    for d in range(300):
        w = items[d % 60][1].split()
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["typo"], ["typo", w[i]]])
        docs.append((d, " ".join(rng.choices(vocab, k=20) + w + rng.choices(vocab, k=20))))
    want = {}
    for d, t in docs:
        for i, u in items:
            x, y = t.split(), u.split()
            e = leaks.allowed(0.1, len(y))
            code = {w: k for k, w in enumerate({*x, *y})}
            windows = np.array([[code[w] for w in x[k : k + len(y)]] for k in range(len(x) - len(y) + 1)])
            least = leaks.edit_distances(windows, np.tile([code[w] for w in y], (len(windows), 1))).min() if len(windows) else 99
            if least <= e:
                want[d, i] = least
    hits = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), None, 0.1).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in hits}
    assert all(want.get(k, 99) <= e for k, e in got.items()) and sum(e > 0 for e in want.values()) > 60
    assert len(got) >= 0.9 * len(want) and {k for k, e in want.items() if e == 0} <= set(got)


def test_edit_distances():
    x = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]])
    y = np.array([[1, 2, 3, 4], [2, 3, 4, 5], [9, 9, 9, 9]])
    assert leaks.edit_distances(x, y).tolist() == [0, 2, 4]
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 4, (200, 9)), rng.integers(0, 4, (200, 7))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    assert leaks.edit_distances(x, y).tolist() == [plain(a, b) for a, b in zip(x, y)]


def test_hilbert_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = np.argsort(packing.hilbert(cells, 3))
    assert sorted(packing.hilbert(cells, 3)) == list(range(side**3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all(), "neighbours on the curve are neighbours in space"


def test_batches_hold_everything_once(spark):
    rng = random.Random(6)
    blocks = [(rng.choice(["d1", "d1", "d2"]), p, b, "x y " * rng.randrange(0, 90)) for p in range(6) for b in range(20)]
    blocks += [blocks[0], ("d3", 1, 0, None), ("d3", 1, 1, ""), ("big", 1, 0, "z" * 2500), (None, 1, 1, "x")]
    limits = spark.createDataFrame([("small", 300), ("wide", 1000), ("none", None), ("zero", 0)], "profile string, capacity_chars int")
    df = spark.createDataFrame(blocks, "doc_id string, page_no int, block_no int, text string")
    rows = packing.batches(df, limits).collect()
    sizes = {(d, p, b): len(t or "") for d, p, b, t in blocks if d}
    for profile, cap in (("small", 300), ("wide", 1000)):
        mine = [r for r in rows if r.profile == profile]
        load, spans = {}, {}
        for r in mine:
            load[r.batch_id] = load.get(r.batch_id, 0) + r.char_end - r.char_start
            spans.setdefault((r.doc_id, r.page_no, r.block_no), []).append((r.char_start, r.char_end))
        assert max(load.values()) <= cap
        for k, n in sizes.items():
            pieces = sorted(spans[k])
            assert pieces[0][0] == 0 and pieces[-1][1] == n and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
            assert n > cap or len(pieces) == 1
        assert len({(r.batch_id, r.doc_id) for r in mine}) == len(load)
    assert {r.profile for r in rows} == {"small", "wide"}
    for r in packing.room_report(packing.batches(df, limits), limits).collect():
        assert r.batches >= r.least_batches and r.fill > 0.6
    assert packing.batches(df.limit(0), limits).count() == 0
