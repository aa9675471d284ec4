"""Clustering, hard negatives and toxicity against brute force and held-out accuracy."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import centroids, negatives, toxicity

VECTORS = "vec_id long, embedding array<float>, label int"


def usable(v, size=None):
    return v is not None and len(v) > 0 and (size is None or len(v) == size) and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    mids = r.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in mids[i % 6] + r.normal(size=8) * 0.4], i % 4 if i % 31 else None) for i in range(400)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(120)] + [(2000 + i, [0.0] * 8, i % 3) for i in range(9)]
    bad = [None, [], [1.0] * 7, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] + [0.0] * 7]
    rows += [(3000 + i * 50, v, 1) for i, v in enumerate(bad)]
    rows += [rows[50], rows[100], (None, rows[7][1], 2), (None, rows[7][1], 1), (-50, rows[9][1], 1)]
    return spark.createDataFrame(rows, VECTORS).withColumns({"cluster": F.lit("x"), "rank": F.lit(1), "anchor": F.lit(2)}).repartition(5), rows


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (3, 5), (1, 1), (700, 1)])
def test_ball_kmeans(spark, vectors, k, rounds):
    df, rows = vectors
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if usable(v, 8)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    mids = [x for _, x in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(mids)) for _, x in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, x), (_, j) in zip(kept, assign(), strict=True):
            members[j].append(x)
        mids = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if members[j] else mids[j] for j in range(len(mids))]
    last = assign()
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    want = Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, mids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))
    assert Counter(map(tuple, centroids.ball_kmeans(spark, df, k=k, rounds=rounds, size=8).collect())) == want


def test_ball_step_compares_neighbours_only():
    r = np.random.default_rng(1)
    mids = r.integers(-4000, 4000, (40, 16))
    x = np.concatenate([m + r.integers(-300, 300, (50, 16)) for m in mids])
    start, _ = centroids.nearest(x, mids)
    moved = mids + r.integers(-40, 40, mids.shape)
    where, best, compared = centroids.ball_step(x, start, moved)
    assert (where == centroids.nearest(x, moved)[0]).all() and (best == centroids.nearest(x, moved)[1]).all()
    assert compared < len(x)  # of 39 for each row
    everything = centroids.ball_step(x, np.zeros(len(x), np.int64), moved)
    assert (everything[0] == where).all()


def brute_negatives(rows, step, positives=5, keep=3):
    kept = [(n, i, label, [math.floor(256 * x) for x in v]) for n, (i, v, label) in enumerate(rows) if label is not None and usable(v, 8)]
    out = Counter()
    place = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for n, i, label, x in kept:
        if i is None or i % step:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=True)), j, other) for m, j, other, y in kept if m != n]
        for ps, pid, _ in sorted((s for s in scored if s[2] == label), key=place)[:positives]:
            hard = sorted((s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=place)[:keep]
            for rank, (s, j, _) in enumerate(hard):
                out[i, pid, rank + 1, j, ps, s] += 1
    return out


@pytest.mark.parametrize(("per", "group", "slice_rows"), [(256, 2048, 8192), (4, 3, 40), (1, 1, 7)])
def test_hard_negatives(spark, vectors, per, group, slice_rows):
    df, rows = vectors
    got = negatives.hard_negatives(spark, df, F.col("vec_id") % 10 == 0, per_pivot=per, group=group, slice_rows=slice_rows)
    want = brute_negatives(rows, 10)
    assert sum(want.values()) > 100
    assert Counter(map(tuple, got.collect())) == want


def test_bounds_prune(spark, monkeypatch):
    """Far clusters are not sent to a group that they can't serve: far fewer rows meet than with bounds that hold nothing back."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (np.eye(8)[i % 8] * 20 + r.normal(size=8) * 0.01)], i % 2) for i in range(800)]
    df = spark.createDataFrame(rows, VECTORS)
    whole, counts = negatives.met, []

    def counted(work):
        sent = counts[-1]

        def told(a, c):
            sent.add(len(c["rid"]))
            return work(a, c)

        return whole(told)

    monkeypatch.setattr(negatives, "met", counted)
    for margin in (negatives.MARGIN, 1e6):
        monkeypatch.setattr(negatives, "MARGIN", margin)
        counts.append(spark.sparkContext.accumulator(0))
        got = negatives.hard_negatives(spark, df, F.col("vec_id") % 10 == 0, per_pivot=4, slice_rows=64)
        assert Counter(map(tuple, got.collect())) == brute_negatives(rows, 10)
    assert 0 < counts[0].value < counts[1].value / 2


def test_products_beyond_doubles():
    a = np.array([[1 << 26, (1 << 26) - 1]], np.int64)
    assert negatives.products(a, a)[0, 0] == (1 << 52) + ((1 << 26) - 1) ** 2
    score = np.array([[(1 << 60) + 1, 1 << 60, (1 << 60) + 1, 5]], np.int64)
    rows, cols = negatives.best(score, np.array([2, 1, 0, 3]), 2, np.array([[True, True, True, True]]))
    assert cols.tolist() == [2, 0] or sorted(cols.tolist()) == [0, 2]


def test_empty_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    nulls = spark.createDataFrame([(1, None, None), (None, None, 1)], VECTORS)
    for df in (none, nulls):
        assert centroids.ball_kmeans(spark, df).count() == 0
        assert negatives.hard_negatives(spark, df, F.col("vec_id") % 50 == 0).count() == 0
    unnamed = spark.createDataFrame([(None, [1.0] * 64, 1)] * 3, VECTORS)
    assert centroids.ball_kmeans(spark, unnamed).count() == 3


DOCS = "doc_id long, text string, score string, row string"


@pytest.fixture(scope="module")
def marked(spark):
    r = np.random.default_rng(12)
    plain = [f"{a}{b}" for a in "bcdfg" for b in ("ala", "oro", "ete", "ubu", "isi", "ana")]
    rude = [f"zork{x}" for x in ("en", "ig", "t", "s", "ing")]
    rows, labels, places = [], [], {}
    for i in range(900):
        sentences = [" ".join(r.choice(plain, r.integers(3, 9))) for _ in range(r.integers(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            at = int(r.integers(len(sentences)))
            words = sentences[at].split()
            words.insert(int(r.integers(len(words))), str(r.choice(rude)).upper() if i % 4 else str(r.choice(rude)))
            sentences[at], places[i] = " ".join(words), at
        rows.append((i, ". ".join(sentences) + (".\n" if i % 2 else ""), None, None))
        labels.append((i, int(toxic)))
    rows += [(2000, None, None, None), (2001, "", None, None), (2002, " .. !\n", None, None), (None, rows[0][1], None, None), rows[3], (2003, "bala " * 60_000, None, None), (2004, "bala " * 30_000 + "zorken", None, None)]
    labels += [(5000, 1), (None, 1), (4, None), (5, 7), (2001, 0), (2000, 0), (8, 0)]
    return spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int"), rows, places


def test_toxicity_is_located(spark, marked):
    docs, labels, rows, places = marked
    words, weights = toxicity.learn(spark, docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(spark, docs, words, weights).select("row.doc_id", "row.text", "score", "n_sentences", "offending").collect()}
    assert len(out) == len({r[0] for r in rows})
    for i in range(900):
        assert (out[i]["score"] >= 0.5) == (i in places), i
        for span in out[i]["offending"]:
            assert out[i]["text"].encode()[span["start"] : span["end"]].decode() == span["text"] and "zork" in span["text"].lower()
        assert len(out[i]["offending"]) == (i in places)
    assert [out[i]["score"] for i in (2000, 2001, 2002)] == [0, 0, 0] and [out[i]["n_sentences"] for i in (2000, 2001, 2002)] == [0, 0, 0]
    assert out[2003]["score"] < 0.5 <= out[2004]["score"] and out[None]["score"] == out[0]["score"]


def test_noisy_or(spark, marked):
    """Scores against the definition, word by word."""
    docs, labels, rows, _ = marked
    words, weights = toxicity.learn(spark, docs, labels, most=100, steps=5)
    known = dict(zip(words.tolist(), weights, strict=False))
    for r in toxicity.score(spark, docs.where("doc_id < 40"), words, weights).select("row.text", "score", "n_sentences").collect():
        clean, n = 1.0, 0
        for part in __import__("re").split(r"[.!?\n]", r["text"].lower()):
            if not part.split():
                continue
            data = " ".join(part.split()).encode()
            split = toxicity.split(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            marks = {int(h) for _, hashes in toxicity.marks(split) for h in hashes}
            clean *= 1 - 1 / (1 + math.exp(-(weights[-1] + sum(known.get(h, 0.0) for h in marks))))
            n += 1
        assert r["n_sentences"] == n and abs(r["score"] - (1 - clean)) < 1e-9


def test_gradient(spark):
    """The gradient of the documents' likelihood against differences."""
    texts = spark.createDataFrame([(1, "bad day. good one"), (0, "good day"), (1, "bad. bad night"), (0, "")], "y int, text string")
    data = " ".join(["bad", "good", "day", "night"]).encode()
    split = toxicity.split(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    words = np.unique(split.hashes())
    rows = texts.coalesce(1).mapInArrow(toxicity.features(words), "y binary, doc binary, known binary").cache()

    def at(w):
        held = spark.sparkContext.broadcast(w)
        r = rows.mapInArrow(toxicity.gradient(held, {0: 1.0, 1: 2.0}), "likelihood double, gradient binary").collect()
        return sum(x["likelihood"] for x in r), np.sum([np.frombuffer(x["gradient"]) for x in r], axis=0)

    w = np.array([0.3, -0.2, 0.1, 0.5, -1.0])
    _, g = at(w)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-5
        assert abs((at(w + e)[0] - at(w - e)[0]) / 2e-5 - g[i]) < 1e-5


def test_unlearnable(spark):
    docs = spark.createDataFrame([(1, "some words."), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)):
        learned = toxicity.learn(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = {r[0]: r[1] for r in toxicity.score(spark, docs, *learned).select("row.doc_id", "score").collect()}
        assert got == {1: want, 2: 0.0}
    assert toxicity.score(spark, docs.limit(0), *learned).count() == 0


def test_held_out_predictions(spark):
    out = toxicity.query(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    got = out.join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    bad, clean = [r[0] for r in got if r[1]], [r[0] for r in got if not r[1]]
    assert np.mean([[(a > b) + (a == b) / 2 for b in clean] for a in bad]) > 0.95
    assert sum(x >= 0.5 for x in clean) <= 1
