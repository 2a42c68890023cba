"""Neighbours in dense groups, in many cells and blocks, and bounds on a block: all against brute force."""

import numpy as np

from arcloom.llm.neighbours import AdditiveQuantizer, Block, best_in_block, nearest


def brute(x, queries, k=10):
    out = {}
    for q in queries:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += (x[q, j] - x[:, j]) ** 2
        d = np.sqrt(d)
        near = np.argpartition(d, 4 * k)[: 4 * k] if len(d) > 4 * k else np.arange(len(d))
        near = near[np.lexsort((near, d[near]))]
        out[q] = [j for j in near.tolist() if j != q][:k]
    return out


def found(spark, x, **more):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {}
    for r in nearest(rows, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_dense_group(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 32))
    x[1000:3000] = x[1000] + 1e-3 * rng.standard_normal((2000, 32))
    assert found(spark, x, n_books=4, n_codes=32, rerank=32, row_block=512, query_block=16) == brute(x, range(0, 4000, 100))


def test_many_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, 50_000)] + 0.3 * rng.standard_normal((50_000, 16))
    assert found(spark, x, n_books=4, n_codes=64, every=500) == brute(x, range(0, 50_000, 500))


def test_queries_of_one_vector(spark):
    """More queries share a vector than rows of it are kept to be found: each still has its own answer."""
    x = np.random.default_rng(6).standard_normal((600, 8))
    x[::3] = x[0]
    ids, want = np.arange(600), {}
    for q in range(0, 600, 2):
        order = np.lexsort((ids, np.sqrt(((x[q] - x) ** 2).sum(axis=1))))
        want[q] = order[order != q][:10].tolist()
    assert found(spark, x, n_books=2, n_codes=8, every=2) == want


def test_block_bounds():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 8)) * np.exp(rng.standard_normal((700, 1)) * 3)
    quantizer = AdditiveQuantizer.fit(x, 3, 8, 2, 1, 7)
    codes, norms = quantizer.encode(x)
    errors, masses = quantizer.errors(x, codes)
    ids = np.arange(700)
    want = brute(x, range(50))
    for rerank in (1, 10, 700, 5000):
        got = {}
        for at, near, _ in best_in_block(quantizer, Block(ids, x, codes, norms, errors, masses), ids[:50], x[:50], np.full(50, np.inf), 10, rerank):
            for q, j in zip(at.tolist(), near.tolist()):
                got.setdefault(q, []).append(j)
        assert got == want
