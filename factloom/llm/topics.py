"""Subject areas of documents by a distributed latent Dirichlet topic model.

Variational Bayes with a symmetric prior on all documents: every pass computes, in the tasks, the
documents' topic proportions and adds up the expected term counts of each topic; only those sums (topics x
terms, fixed by the parameters) come back. Topics start from the term counts of labelled
documents, as topics of a start without them stay mixed where a language is rare; a few more start from
the corpus and take up what belongs to no area. The fitted topics are mapped to areas by inspecting their
top terms against the areas' characteristic terms. Then every document's posterior topic proportions are
inferred, and its proportion of an area is taken over sentences: a sentence is about the area whose topics
hold most of its words' posterior mass. Sentences that are boilerplate, headers or quoted test items are
not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .unify import slices
from .words import mix, word_hashes, word_spans

TERMS = 1 << 13
FREE_TOPICS = 4
PASSES = 5
INNER = 6
ALPHA, ETA = 0.1, 0.05
TOP_TERMS = 60
#: A term starts an area's topic if this share of its labelled use, areas weighing alike, is in the area.
CONCENTRATED = 0.4
SURE = 0.28
#: Weight of the labelled use of all other terms at the start.
SMOOTH = 0.3
#: Documents that are worked on at once, and of those, by length, that are one batch of matrix products.
CHUNK, TOGETHER = 500, 32
SHARE = 0.25
#: A sentence is boilerplate if it stands, but for numbers, in this share of the documents, copies counted once, and in
#: more than OFTEN of them (the share of fewer than 750 documents is no sign yet).
BOILERPLATE, OFTEN = 0.004, 3
#: A sentence is quoted test material if it holds so many consecutive words of an item.
QUOTED = 6
#: Words before a full stop that end no sentence.
ABBREVIATIONS = "dr prof adv mr mrs ms m/s shri smt ltd pvt no rs cr inc co st l p".split()
LINE = "\u00b6"


def _sentences(arr: pa.Array, quoted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(term of each word, sentence of each word, row, hash and "is quoted" of each sentence).

    A sentence ends at ``.``, ``!`` or ``?`` before a space, unless the word before is an abbreviation,
    and at a line break. Numbers do not enter the hash.
    """
    lines = pa.compute.replace_substring(arr, "\n", f" {LINE} ")
    hashes, word_ends, start, end, cps, ends = word_spans(lines)
    stop = np.isin(cps, [0x2E, 0x21, 0x3F])
    stop[:-1] &= cps[1:] == 0x20
    short, _ = word_hashes(pa.array(ABBREVIATIONS))
    held = end[np.isin(hashes, short)]
    stop[held[held < len(cps)]] = False
    stop |= cps == ord(LINE)
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    cuts = np.unique(np.concatenate([np.flatnonzero(stop) + 1, firsts]))
    raw = np.searchsorted(cuts, start, side="right")
    sentence = np.cumsum(np.diff(raw, prepend=-1) != 0) - 1
    heads = np.flatnonzero(np.diff(sentence, prepend=-1))
    row = np.searchsorted(word_ends, heads, side="right")
    digit = (cps[start] >= 0x30) & (cps[start] <= 0x39) if len(start) else np.zeros(0, bool)
    place = np.arange(len(hashes)) - heads[sentence] if len(heads) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        part = np.where(digit, np.uint64(0), mix(hashes + mix(place.astype(np.uint64))))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
    stops = np.concatenate([heads[1:], [len(hashes)]]) if len(heads) else heads
    key = (sums[stops] - sums[heads]).view(np.int64)
    is_quoted = np.zeros(len(heads), bool)
    runs = _runs(hashes)
    if len(runs) and len(quoted):
        at = np.minimum(np.searchsorted(quoted, runs), len(quoted) - 1)
        hit = np.flatnonzero(quoted[at] == runs)
        hit = hit[np.searchsorted(word_ends, hit, side="right") == np.searchsorted(word_ends, hit + QUOTED - 1, side="right")]
        for k in range(QUOTED):
            is_quoted[sentence[hit + k]] = True
    terms = np.where(digit, -1, (mix(hashes) % np.uint64(TERMS)).astype(np.int64))
    return terms, sentence, row, key, is_quoted


def _runs(hashes: np.ndarray) -> np.ndarray:
    """One hash for each run of QUOTED words."""
    n = max(len(hashes) - QUOTED + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(QUOTED):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + n])
    return out


_BAG = "doc_id long, terms array<short>, lengths array<int>, keys array<long>"


def _bags(quoted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(c, CHUNK) for b in batches for c in range(0, len(b), CHUNK)):
            done = 0
            for part in slices(b.column("text")):
                ids = b.column("doc_id").slice(done, len(part))
                done += len(part)
                terms, sentence, row, key, is_quoted = _sentences(part, quoted)
                keep = ~is_quoted[sentence] & (terms >= 0) if len(terms) else np.zeros(0, bool)
                live = ~is_quoted
                n = np.bincount(sentence[keep], minlength=len(row)) if len(row) else np.zeros(0, np.int64)
                row_words = np.bincount(row, weights=n, minlength=len(part)).astype(np.int64) if len(row) else np.zeros(len(part), np.int64)
                row_sents = np.bincount(row[live], minlength=len(part)) if len(row) else np.zeros(len(part), np.int64)
                offs = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()),
                        pa.ListArray.from_arrays(offs(row_words), pa.array(terms[keep].astype(np.int16))),
                        pa.ListArray.from_arrays(offs(row_sents), pa.array(n[live].astype(np.int32))),
                        pa.ListArray.from_arrays(offs(row_sents), pa.array(key[live])),
                    ],
                    names=["doc_id", "terms", "lengths", "keys"],
                )

    return run


def _flat(bags: pa.RecordBatch, boiler: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence, term) of each word that counts, for a batch of bags."""
    flat = lambda c: bags.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    terms, lengths, keys = flat("terms"), flat("lengths"), flat("keys")
    doc = np.repeat(np.arange(len(bags)), pa.compute.list_value_length(bags.column("lengths")).to_numpy(zero_copy_only=False))
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    ok = ~np.isin(keys, boiler)[sentence]
    return doc[sentence][ok], sentence[ok], terms[ok]


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, uses) of the distinct terms of each document, in order."""
    pairs, uses = np.unique(doc * TERMS + term, return_counts=True)
    return pairs // TERMS, pairs % TERMS, uses


def boilerplate(bags: DataFrame) -> np.ndarray:
    """Sorted keys of the sentences that stand in more than BOILERPLATE of the otherwise different documents.

    Documents with the same sentences count once. Of the rest, a document most of whose sentences are
    frequent may be a near copy: such documents count once for each smallest frequent key among theirs,
    which near copies share but for the few in which just that sentence was changed.
    """
    texts = cut(bags.select(F.array_sort(F.array_distinct("keys")).alias("keys")).filter(F.size("keys") > 0).distinct())
    total = texts.count()
    # half the share, as near copies lower the number of documents; fewer than 2 * sentences-per-document / BOILERPLATE at any size
    often = texts.select(F.explode("keys").alias("key")).groupBy("key").count().filter(F.col("count") > max(OFTEN, BOILERPLATE * total / 2)).select("key")
    held = texts.select(F.xxhash64("keys").alias("id"), F.size("keys").alias("n"), F.explode("keys").alias("key")).join(F.broadcast(often), "key")
    held = held.groupBy("id", "n").agg(F.collect_list("key").alias("held"))
    held = cut(held.select("held", F.when(F.size("held") * 2 > F.col("n"), F.array_min("held")).alias("copy")))
    copies, kinds = held.agg(F.count("copy"), F.count_distinct("copy")).first()
    counts = held.select(F.explode("held").alias("key"), "copy").groupBy("key").agg((F.count_if(F.col("copy").isNull()) + F.count_distinct("copy")).alias("n"))
    return np.array(sorted(r[0] for r in counts.filter(F.col("n") > max(OFTEN, BOILERPLATE * (total - copies + kinds))).collect()), np.int64)


def _add_up(parts: DataFrame, rows: int) -> np.ndarray:
    """Sums of the tasks' (k, vector) rows: one vector per topic comes back, of fixed length."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in zip(pdf["k"], pdf["v"]):
                sums[k] = sums[k] + np.frombuffer(v) if k in sums else np.frombuffer(v).copy()
        yield pd.DataFrame({"k": list(sums), "v": [x.tobytes() for x in sums.values()]})

    out = np.zeros((rows, TERMS))
    for r in parts.repartition(min(rows, 12), "k").mapInPandas(total, "k int, v binary").collect():
        out[r["k"]] = np.frombuffer(bytes(r["v"]))
    return out


def _vectors(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array(range(len(sums)), pa.int32()), "v": [x.tobytes() for x in sums]})


def _term_counts(bags: DataFrame, labels: DataFrame, areas: list[str], boiler: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labelled documents with each term by area, uses of each term in the corpus), over all documents and labels."""
    index = F.create_map(*[F.lit(x) for i, a in enumerate(areas) for x in (a, i)])
    by_doc = labels.groupBy("doc_id").agg(F.collect_set(index[F.col("area")]).alias("areas"))

    def corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1, TERMS))
        for b in batches:
            for _, _, _, term in _chunks(b, boiler):
                sums[0] += np.bincount(term, minlength=TERMS)
        yield _vectors(sums)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, doc, _, term in _chunks(b, boiler):
                doc, term, _ = _distinct(doc, term)
                ends = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int16()))], names=["doc_id", "terms"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(areas), TERMS))
        for b in batches:
            for mine, terms in zip(b.column("areas").to_pylist(), b.column("terms")):
                sums[np.array(mine)[:, None], terms.values.to_numpy(zero_copy_only=False)] += 1
        yield _vectors(sums)

    # the labels may be as many as the documents: the planner sees to the join, in which a document is its distinct terms
    labelled = bags.mapInArrow(distinct, "doc_id long, terms array<short>").join(by_doc, "doc_id")
    inside = _add_up(labelled.select("areas", "terms").mapInArrow(marked, "k int, v binary"), len(areas))
    return inside, _add_up(bags.mapInArrow(corpus, "k int, v binary"), 1)[0]


def _digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma, by recurrence from six above and the asymptotic series there."""
    y = x + 6.0
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - sum(1 / (x + i) for i in range(6))


def _log_mean(lam: np.ndarray) -> np.ndarray:
    """exp E[log topic-term], terms x topics."""
    return np.ascontiguousarray(np.exp(_digamma(lam) - _digamma(lam.sum(1))[:, None]).T.astype(np.float32))


def infer(doc: np.ndarray, term: np.ndarray, uses: np.ndarray, docs: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gamma, phi): the variational topic counts of each document, and the topic weights of a use of each of its terms.

    ``doc``, ascending, and ``term`` are distinct pairs; ``beta`` is exp E[log topic-term], terms x topics."""
    k = beta.shape[1]
    edge = np.searchsorted(doc, np.arange(docs + 1))
    n = np.diff(edge)
    gamma, phi = np.full((docs, k), ALPHA, np.float32), np.empty((len(term), k), np.float32)
    theta = np.full((docs, k), 1 / k, np.float32)
    by_length = np.argsort(n, kind="stable")
    by_length = by_length[n[by_length] > 0]
    groups = []
    for c in range(0, len(by_length), TOGETHER):
        g = by_length[c : c + TOGETHER]
        at = edge[g][:, None] + np.arange(n[g[-1]])
        live = at < edge[g + 1][:, None]
        held = np.minimum(at, len(term) - 1)
        groups.append((g, at[live], live, beta[term[held]], (uses[held] * live).astype(np.float32)))
    for i in range(INNER):
        if i:
            theta = np.exp(_digamma(gamma) - _digamma(gamma.sum(1))[:, None]).astype(np.float32)
        for g, at, live, b, m in groups:
            weight = 1 / np.maximum(np.matmul(b, theta[g][:, :, None])[..., 0], 1e-30)
            gamma[g] = ALPHA + theta[g] * np.matmul((m * weight)[:, None, :], b)[:, 0]
            if i == INNER - 1:
                phi[at] = (theta[g][:, None, :] * b * weight[..., None])[live]
    return gamma, phi


def _chunks(bags: pa.RecordBatch, boiler: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for c in range(0, len(bags), CHUNK):
        part = bags.slice(c, CHUNK)
        doc, sentence, term = _flat(part, boiler)
        if len(doc):
            yield part, doc, sentence, term


def fit(bags: DataFrame, start: np.ndarray, boiler: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Topic-term weights (lambda) after ``passes`` of variational Bayes over all documents, under a symmetric
    Dirichlet prior of each topic's terms."""
    lam = start
    for _ in range(passes):
        beta = _log_mean(lam)

        def step(batches: Iterator[pa.RecordBatch], beta: np.ndarray = beta) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(beta.T.shape)
            for b in batches:
                for part, doc, _, term in _chunks(b, boiler):
                    doc, term, uses = _distinct(doc, term)
                    _, phi = infer(doc, term, uses, len(part), beta)
                    for k in range(len(sums)):
                        sums[k] += np.bincount(term, weights=phi[:, k] * uses, minlength=TERMS)
            yield _vectors(sums)

        lam = ETA + _add_up(bags.mapInArrow(step, "k int, v binary"), len(lam))
    return lam


def inspect(lam: np.ndarray, labelled: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Area of each topic (-1: none): the area whose characteristic terms its top terms are.

    Terms are ranked by their weight times the logarithm of their lift over the corpus; the areas'
    characteristic terms likewise from the labelled documents.
    """
    base = (corpus + 1) / (corpus + 1).sum()

    def ranked(w: np.ndarray) -> np.ndarray:
        p = (w + 1e-9) / (w + 1e-9).sum(1, keepdims=True)
        return p * np.maximum(np.log(p / base), 0)

    topics, areas = ranked(lam), ranked(labelled)
    top = np.zeros_like(topics)
    for i, row in enumerate(topics):
        best = np.argsort(-row)[:TOP_TERMS]
        top[i, best] = row[best]
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    likeness = norm(top) @ norm(areas).T
    best = likeness.argmax(1)
    return np.where(likeness[np.arange(len(best)), best] > 0.3, best, -1)


def _assign(lam: np.ndarray, topic_area: np.ndarray, areas: list[str], boiler: np.ndarray, share: float):
    beta = _log_mean(lam)
    of_area = np.zeros((len(lam), len(areas)), np.float32)
    for k in np.flatnonzero(topic_area >= 0):
        of_area[k, topic_area[k]] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, doc, sentence, term in _chunks(b, boiler):
                pair_doc, pair_term, uses = _distinct(doc, term)
                _, phi = infer(pair_doc, pair_term, uses, len(part), beta)
                at = np.zeros((len(part), TERMS), np.int32)
                at[pair_doc, pair_term] = np.arange(len(phi))
                first = np.flatnonzero(np.diff(sentence, prepend=-1))
                mass = np.add.reduceat(phi[at[doc, term]], first, axis=0) @ of_area
                owner, about = doc[first], mass.argmax(1)
                said = mass.max(1) >= 0.5  # half a word at least
                counted = np.bincount(owner[said], minlength=len(part))
                got = np.zeros((len(part), len(areas)))
                np.add.at(got, (owner[said], about[said]), 1.0)
                d, a = np.nonzero((got >= share * counted[:, None]) & (got > 0))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(np.array(areas, dtype=object)[a], pa.string()), pa.array(got[d, a] / counted[d])], names=["doc_id", "area", "share"])

    return run


def subjects(docs: DataFrame, labels: DataFrame, area_list: DataFrame, items: DataFrame | None = None, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(doc_id, area, share): the areas that at least ``share`` of a document's sentences are about.

    Boilerplate, headers and quoted test items are not counted, nor sentences whose words the areas' topics do
    not hold; a document without other sentences gets no area. Copies and near copies of one text, however
    many, do not make its sentences boilerplate (see ``boilerplate``). Null texts and ids are left out.
    The topics are fitted on all documents, from all ``labels(doc_id, area)``; unknown areas among them are
    ignored. The items are a stated set, of which only the hashes of their runs of QUOTED words are kept.
    """
    areas = sorted(r[0] for r in area_list.select("area").filter("area is not null").distinct().collect())
    runs = [np.zeros(0, np.uint64)]
    if items is not None:
        runs += [_runs(word_hashes(pa.array([r[0]]))[0]) for r in items.filter("text is not null").select("text").distinct().toLocalIterator()]
    d = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bags = cut(d.mapInArrow(_bags(np.unique(np.concatenate(runs))), _BAG))
    boiler = boilerplate(bags)
    labelled = labels.filter(F.col("area").isin(areas)).select(F.col("doc_id").cast("long").alias("doc_id"), "area").distinct()
    inside, corpus = _term_counts(bags, labelled, areas, boiler)
    lam = fit(bags, seeded(inside, corpus), boiler, passes)
    return bags.mapInArrow(_assign(lam, inspect(lam, inside, corpus), areas, boiler, share), "doc_id long, area string, share double")


def seeded(labelled: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Start of the topics, which weighs as much as one pass: one for each area from its labelled terms, and
    FREE_TOPICS of the rest of the corpus."""
    base = (corpus + 1) / (corpus + 1).sum()
    inside = (labelled + base * 50) / (labelled + base * 50).sum(1, keepdims=True)
    weight = max(corpus.sum(), 1.0) / (len(labelled) + FREE_TOPICS)
    # documents of the area among those with the term, less one standard error, so rare terms need more
    sure = (labelled - np.sqrt(labelled)) / np.maximum(labelled.sum(0), 1)
    own = (inside / inside.sum(0) >= CONCENTRATED) & (sure >= SURE)
    rest = ~own.any(0)
    noise = np.random.default_rng(11).gamma(20, 1 / 20, (FREE_TOPICS, TERMS))
    # a free topic must not take up the areas' own terms, as one of a whole language otherwise would
    return np.concatenate([weight * inside * (own + SMOOTH * rest), weight * base * noise * rest]) + ETA
