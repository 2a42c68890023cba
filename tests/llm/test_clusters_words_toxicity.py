"""Centroid clustering, source divergence and toxicity against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arcloom.llm import centroids, divergence
from arcloom.llm import toxicity as tox
from arcloom.llm.common import reachable

VECTORS = "vec_id long, embedding array<float>, cluster string, note string"


@pytest.fixture(autouse=True)
def _imports(spark):
    reachable(spark)


def plain_lloyd(rows, k, rounds, dim, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    c = [list(q) for _, q in order[:k]]
    far = lambda q, m: sum((a - b) ** 2 for a, b in zip(q, m, strict=True))
    near = lambda q: min(range(len(c)), key=lambda j: (far(q, c[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q), []).append(q)
        for j, qs in groups.items():
            c[j] = [sum(col) // len(qs) for col in zip(*qs, strict=True)]
    placed = [(i, near(q), far(q, c[near(q)])) for i, q in kept]
    inertia = Counter()
    for _, j, d in placed:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in placed), key=repr)


@pytest.mark.parametrize("hot", [0, 3000])
def test_centroids(spark, hot):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5)) + rng.randrange(-3, 4) / 64 for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(hot)]  # a vector that most rows share
    rows += [(7, rows[3][1]), (7, rows[4][1]), (7, rows[3][1]), (None, rows[5][1])]
    rows += [(901, None), (902, []), (903, [1.0] * 3), (904, [1.0] * 5), (905, [1.0, None, 1.0, 1.0]), (906, [float("nan"), 0.0, 0.0, 0.0]), (907, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "old", "x") for i, v in rows], VECTORS)
    found = centroids.cluster_vectors(df, k=5, rounds=3, dim=4)
    assert found.columns == ["vec_id", "note", *centroids.RESULT]
    got = sorted((tuple(r) for r in found.drop("note").collect()), key=repr)
    assert got == plain_lloyd([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 3, 4, 64)


def test_centroids_few_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert centroids.cluster_vectors(empty, dim=4).count() == 0
    two = spark.createDataFrame([(1, [0.5, 0.5], "", ""), (2, [0.25, 0.5], "", "")], VECTORS)
    assert sorted(r.cluster for r in centroids.cluster_vectors(two, k=16, dim=2).collect()) == [0, 1]
    wild = spark.createDataFrame([(1, [3e9, 0.5], "", "")], VECTORS)
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster_vectors(wild, dim=2).count()


def test_nearest_in_doubles_and_integers():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-(1 << 25), 1 << 25, (50, 64)), rng.integers(-(1 << 25), 1 << 25, (7, 64))
    far = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    cluster, distance = centroids.nearest(x, c)
    assert cluster.tolist() == [min(range(7), key=lambda j: (r[j], j)) for r in far] and distance.tolist() == far.min(axis=1).tolist()


def plain_divergence(rows, least, top):
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, la, so in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = [w for w in df if df[w] >= least]
        count = {s: Counter(w for d in own if d[1] == s for w in d[2] if w in set(kept)) for s in {d[1] for d in own}}
        whole = sum(count.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        share, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in count:
            pairs = sorted(((sum(abs(share[s][w] - share[o][w]) for w in kept), o) for o in count if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((share[s][w] - q[w], w) for w in kept if count[s][w] and share[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)] + [(lang, s, "term", w, v, i + 1) for i, (v, w) in enumerate(terms[:top])]
    return sorted(out)


@pytest.mark.parametrize("slice_", [200_000, 3])
def test_divergence(spark, monkeypatch, slice_):
    monkeypatch.setattr(divergence, "SLICE", slice_)
    rng = random.Random(9)
    words = ["Alpha", "beta", "gamma", "Ünder", "naïve", "x", "日本", "a b", "rare"]
    rows = [(rng.choice([" ", "-", "\n", "_1_"]).join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3", "é"])) for _ in range(150)]
    rows += [(None, "en", "s1"), ("beta", None, "s1"), ("beta", "en", None), ("", "fr", "s1"), ("only once", "fr", "s2"), ("beta beta " * 20_000, "en", "s2"), rows[0], rows[0]]
    df = spark.createDataFrame([(t, la, so, 1) for t, la, so in rows], "text string, lang string, source string, n long")
    got = divergence.source_divergence(df, least_docs=8, top=3)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, 8, 3)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def corpus(n=900):
    rng = random.Random(4)
    clean = ["".join(rng.choices("aeioulmnrst", k=rng.randrange(3, 9))) for _ in range(400)]
    bad = ["vexwort", "grimble", "zorkish"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(clean, k=rng.randrange(20, 60)), i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
            if i % 12 == 0:
                words[:2] = ["qux" + rng.choice(clean) for _ in range(2)]
        docs.append((i, " ".join(words).capitalize() + ".", "en", "s"))
        if i % 5 < 3:
            labels.append((i, 1, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, toxic string", "doc_id long, quality int, toxic int"


def test_toxicity_of_held_out_rows(spark):
    docs, labels = corpus()
    more = [(5000, None, None, None), (5001, "", "en", "x"), (None, docs[0][1], "en", "x"), (5002, docs[0][1], "en", "x"), (5003, docs[1][1] + " padding" * 50_000, "en", "x")]
    frame = spark.createDataFrame(docs + more, DOCS)
    got = {r.doc_id: r for r in tox.toxicity(frame, spark.createDataFrame([*labels, (77, 1, None), (0, 1, 0)], LABELS)).collect()}
    assert len(got) == len(docs) + len(more)
    for i in got:
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.7)
    out = [i for i, *_ in docs if got[i].held_out]
    assert sum(got[i].predicted == (i % 6 == 0) for i in out) >= 0.98 * len(out)
    assert got[None].score == got[0].score == got[5002].score and got[5000].score == got[5001].score < 0.5 and got[5003].predicted == 0


def test_toxicity_learns_nothing_from_held_out_rows(spark):
    docs, labels = corpus(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    frame = spark.createDataFrame(docs, DOCS)
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in tox.toxicity(frame, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned)]
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(*scores, strict=True))


def test_toxicity_without_labels(spark):
    docs, _ = corpus(20)
    frame, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in tox.toxicity(frame, none).collect()} == {(0.0, 0)}
    assert tox.toxicity(frame.limit(0), none).count() == 0
    one_kind = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    assert {r.predicted for r in tox.toxicity(frame, one_kind).collect()} == {1}


def test_label_model_against_plain_sums(spark):
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(6), rng.randrange(0, 4))), rng.choice([0, 1, None])) for _ in range(300)]
    texts = spark.createDataFrame(rows, "signs array<int>, label int").repartition(3)
    n = 5  # four voters and their silence; signs 4 and 5 don't vote
    votes = np.array([[float(v in s) for v in range(4)] + [float(not any(v in s for v in range(4)))] for s, _ in rows])
    label = np.array([-1 if y is None else y for _, y in rows])
    total = tox.moments(texts, n, None, pairs=True)
    for y in (0, 1):
        own = np.hstack([votes[label == y], np.ones(((label == y).sum(), 1))])
        assert np.allclose(total[y], own.T @ own)
    model = tox.fit_label_model(texts, n, rounds=2)
    lists = pa.array([s for s, _ in rows], pa.list_(pa.int32()))
    assert np.array_equal(tox.votes_of(lists, n), votes)
    odds = [math.log(model.share / (1 - model.share)) + sum(model.voice[v] * math.log(model.rates[1][v] / model.rates[0][v]) for v in range(n) if x[v]) for x in votes]
    assert np.allclose(model.posterior(votes), [1 / (1 + math.exp(-o)) for o in odds])
    twice = np.column_stack([votes[:, 0], votes[:, 0]])
    doubled = spark.createDataFrame([([0, 1] if a else [], i % 2) for i, (a, _) in enumerate(twice)], "signs array<int>, label int")
    assert tox.fit_label_model(doubled, 3, rounds=0).voice[:2] == pytest.approx([0.5, 0.5], abs=0.05)


def test_linear_fit_reaches_the_minimum():
    rng = np.random.default_rng(1)
    x = (rng.random((200, 6)) < 0.3).astype(float)
    y = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 0, 1, 0, 0]) - 1)))
    rows, columns = np.nonzero(x)
    w, b = tox.fit_linear(rows, columns, y, 6, ridge=1e-3)
    miss = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ miss / 200 + 1e-3 * w).max() < 1e-5 and abs(miss.mean()) < 1e-5
