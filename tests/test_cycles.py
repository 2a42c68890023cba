"""Components, closures, contraction and distances on random graphs with cycles, against numpy and plain searches."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcloom.functions.semiring import BOOLEAN, LOG, PROBABILITY, RINGS, TROPICAL
from arcloom.operators import components as comp
from arcloom.operators.contract import contracted
from arcloom.operators.distance import all_pairs, all_path_distances, by_all_pairs, by_residuals, cost, single_source
from arcloom.operators.reach import accessible_states, is_cyclic
from arcloom.sources.automaton import Automaton


def graph(spark, ring, arcs, start, end, ids=("a",)):
    """The same arcs (src, dst, weight) for each id, with states as structs."""
    value = lambda w: {"boolean": w > 0, "log": math.log(w) if w else -math.inf, "tropical": -math.log(w) if w else math.inf}.get(ring.name, w)
    named = "auto_id string, state struct<n: long>, weight " + ring.type
    rows = [(i, (s,), (d,), "x", "x", value(w)) for i in ids for s, d, w in arcs]
    frame = spark.createDataFrame(rows, f"auto_id string, src struct<n: long>, dst struct<n: long>, ilabel string, olabel string, weight {ring.type}")
    ends = [spark.createDataFrame([(i, (s,), value(w)) for i in ids for s, w in x.items()], named) for x in (start, end)]
    return Automaton(frame, *ends, ring)


def tangled(seed, n=24, m=40):
    rng = random.Random(seed)
    arcs = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 20) / 100) for _ in range(m)]
    arcs += [(100 + k, 101 + k, 0.9) for k in range(12)] + [(0, 100, 0.5), (112, 3, 0.25)]  # a unary chain
    arcs += [(200 + k, 200 + (k + 1) % 5, 0.5) for k in range(5)]  # a ring that nothing leads to
    return arcs


def closure_of(arcs, ring):
    states = sorted({x for s, d, _ in arcs for x in (s, d)})
    a = np.zeros((len(states),) * 2)
    for s, d, w in arcs:
        i, j = states.index(s), states.index(d)
        a[i, j] = max(a[i, j], w) if ring is TROPICAL else a[i, j] + w
    if ring is TROPICAL:
        best = np.maximum(a, np.eye(len(a)))
        for k in range(len(a)):
            best = np.maximum(best, best[:, [k]] * best[[k], :])
        return states, best
    return states, np.linalg.inv(np.eye(len(a)) - a)


def plain(ring, w):
    return {"log": math.exp(w), "tropical": math.exp(-w), "boolean": float(w)}.get(ring.name, w)


@pytest.mark.parametrize("ring", [PROBABILITY, LOG, TROPICAL], ids=lambda r: r.name)
def test_distances_with_cycles(spark, ring):
    arcs = tangled(1)
    states, want = closure_of(arcs, ring)
    auto = graph(spark, ring, arcs, {0: 1.0, 5: 0.5}, {3: 1.0}, ids=("a", "b"))
    plus = max if ring is TROPICAL else (lambda x, y: x + y)
    expect = {s: plus(want[states.index(0), j], 0.5 * want[states.index(5), j]) for j, s in enumerate(states)}
    expect = {s: v for s, v in expect.items() if v > 1e-12}
    for how in {"log": (all_path_distances,), "tropical": (by_all_pairs, by_residuals)}.get(ring.name, (all_path_distances, by_all_pairs)):
        found = {(r.auto_id, r.state.n): plain(ring, r.weight) for r in how(auto).collect()}
        assert set(found) == {(i, s) for i in "ab" for s in expect}
        exact = {"rel": 1e-5} if how is by_residuals else {"rel": 1e-9}  # residuals stop at the ring's tolerance
        assert all(v == pytest.approx(expect[s], **exact) for (_, s), v in found.items())
    if ring is LOG:
        return
    pairs = {(r.src.n, r.dst.n): plain(ring, r.weight) for r in all_pairs(auto).filter("auto_id = 'a'").collect()}
    assert len(pairs) == (want > 1e-15).sum() and all(v == pytest.approx(want[states.index(s), states.index(d)], rel=1e-7) for (s, d), v in pairs.items())


@pytest.mark.parametrize(("name", "block"), [*[(name, 4) for name in RINGS], ("log", 256)])
def test_closures_by_blocks(spark, name, block):
    ring, arcs = RINGS[name], [(s, d, w) for s, d, w in tangled(7, 11, 33) if s < 100 and d < 100 and s != d]
    auto = graph(spark, ring, arcs, {}, {})
    links = ring.sum(auto.arcs, ["auto_id", "src", "dst"])
    members = comp.components(links)
    found = comp.closures(spark, ring, links, members, block=block)
    own = {r.state.n: r.root.n for r in members.collect()}
    inside = [(s, d, w) for s, d, w in arcs if s in own and own.get(s) == own.get(d)]
    states, want = closure_of(inside, ring)
    got = {(r.src.n, r.dst.n): plain(ring, r.weight) for r in found.collect()}
    assert max(list(own.values()).count(r) for r in own.values()) > 4
    assert set(got) == {(s, d) for s in own for d in own if own[s] == own[d]}
    if ring is not BOOLEAN:
        assert all(v == pytest.approx(want[states.index(s), states.index(d)], rel=1e-8) for (s, d), v in got.items())


@pytest.mark.parametrize("seed", [1])
def test_components(spark, seed):
    arcs = tangled(seed)
    nodes = {x for s, d, _ in arcs for x in (s, d)}
    reach = {x: {x} for x in nodes}
    for _ in nodes:
        for s, d, _ in arcs:
            for x in nodes:
                if s in reach[x]:
                    reach[x].add(d)
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in nodes if any(x in reach[y] for y in reach[x] if y != x)}
    auto = graph(spark, PROBABILITY, arcs, {0: 1.0}, {})
    assert {r.state.n: r.root.n for r in comp.components(auto.arcs).collect()} == want
    assert {r.state.n for r in accessible_states(auto).collect()} == reach[0]
    assert is_cyclic(auto).first().cyclic == any(x in want for x in reach[0])


def test_no_components(spark):
    assert comp.components(graph(spark, PROBABILITY, [(0, 1, 0.5), (1, 2, 0.5), (0, 2, 0.5), (1, 1, 0.5)], {0: 1.0}, {2: 1.0}).arcs) is None


def test_strong_loop_is_exact(spark):
    """A closure, where doubling or residuals would take millions of steps."""
    auto = graph(spark, PROBABILITY, [(0, 0, 0.999999), (0, 1, 0.5), (1, 2, 0.999999), (2, 1, 1.0)], {0: 1.0}, {1: 1.0})
    want = 0.5 / (1 - 0.999999) ** 2
    assert cost(auto).first().weight == pytest.approx(want, rel=1e-9)
    assert cost(auto, distances=by_all_pairs).first().weight == pytest.approx(want, rel=1e-9)


def test_no_pairs_outside_components(spark):
    """Of a long way with one small cycle, only the cycle's pairs are made."""
    arcs = [(k, k + 1, 0.99) for k in range(40)] + [(k, k + 50, 0.5) for k in range(40)] + [(k + 50, k + 1, 0.1) for k in range(40)] + [(20, 19, 0.25)]
    auto = graph(spark, PROBABILITY, arcs, {0: 1.0}, {40: 1.0})
    links = PROBABILITY.sum(auto.arcs, ["auto_id", "src", "dst"])
    closed = comp.closures(spark, PROBABILITY, links, comp.components(links))
    assert closed.count() == 9  # 19, 20 and the detour 69
    states, want = closure_of(arcs, PROBABILITY)
    assert cost(auto).first().weight == pytest.approx(want[states.index(0), states.index(40)])


def test_contraction(spark):
    arcs = [(k, k + 1, 0.5) for k in range(9)] + [(9, 20, 0.5), (9, 21, 0.25), (20, 22, 1.0), (21, 22, 1.0), (30, 31, 1.0), (31, 30, 1.0)]
    auto = graph(spark, PROBABILITY, arcs, {4: 1.0}, {})
    short = contracted(auto.arcs.select("auto_id", "src", "dst", "weight"), auto.initial, PROBABILITY)
    assert sorted((r.src.n, r.dst.n, r.weight) for r in short.links.collect()) == [(0, 4, 0.5**4), (4, 9, 0.5**5), (9, 22, 0.75)]
    assert {(r.state.n, r.at.n): r.weight for r in short.inner.collect()}[(7, 4)] == 0.5**3
    assert sorted(r.state.n for r in short.rings.collect()) == [30, 31]


@pytest.mark.parametrize("n", [2000])
def test_long_chain(spark, n):
    arcs = spark.range(n).select(F.lit("a").alias("auto_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("x").alias("ilabel"), F.lit("x").alias("olabel"), F.lit(0.999).alias("weight"))
    ends = [spark.createDataFrame([("a", s, 1.0)], "auto_id string, state long, weight double") for s in (0, n)]
    auto = Automaton(arcs, *ends, PROBABILITY)
    assert auto.states().count() == n + 1
    assert not is_cyclic(auto).first().cyclic
    assert cost(auto).first().weight == pytest.approx(0.999**n)
    assert single_source(auto).filter(F.col("state") == 1234).first().weight == pytest.approx(0.999**1234)
    round_ = auto.with_arcs(auto.arcs.unionByName(auto.arcs.filter("src = 7").withColumn("src", F.lit(n).cast("long")).withColumn("dst", F.lit(0).cast("long"))))
    assert is_cyclic(round_).first().cyclic


def test_residuals_have_a_limit(spark):
    auto = graph(spark, PROBABILITY, [(0, 1, 1.0), (1, 0, 1.0)], {0: 1.0}, {1: 1.0})
    with pytest.raises(RuntimeError, match="took more than 5"):
        by_residuals(auto, max_steps=5)
    assert cost(auto).first().weight == math.inf
