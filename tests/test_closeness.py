"""Classes of close weights, and the worklist of split blocks, against plain refinement."""

from __future__ import annotations

import random

import pytest

from arcloom.functions.semiring import BOOLEAN, PROBABILITY
from arcloom.operators.minimize import Closeness, close_classes
from arcloom.sources.constructors import arc, automaton


def test_classes(spark):
    rows = [("a", x) for x in (0.0149, 0.0151, 0.0152, 0.5, 0.7, 0.7, float("inf"))] + [("b", 0.01 * k) for k in range(100)] + [("b", 2.0), ("b", float("-inf"))]
    got = {(r.auto_id, r.weight): r.least for r in close_classes(spark.createDataFrame(rows, "auto_id string, weight double"), 0.0101).collect()}
    want = {("a", 0.0149): 0.0149, ("a", 0.0151): 0.0149, ("a", 0.0152): 0.0149, ("a", 0.5): 0.5, ("a", 0.7): 0.7, ("a", float("inf")): float("inf")}
    assert got == want | {("b", 0.01 * k): 0.0 for k in range(100)} | {("b", 2.0): 2.0, ("b", float("-inf")): float("-inf")}


def test_close_states_merge(spark):
    arcs = [arc(0, 1, "a", 0.5), arc(0, 2, "b", 0.5), arc(0, 3, "c", 0.5), arc(1, 4, "x", 0.0149), arc(2, 4, "x", 0.0151), arc(3, 4, "x", 0.03)]
    small = automaton(spark, PROBABILITY, {0: 1.0}, {4: 1.0}, arcs).minimize(partitioner=Closeness(1e-3))
    assert small.arc_states().count() == 4 and small.cost().first().weight == pytest.approx(0.5 * (0.0149 + 0.0149 + 0.03))


@pytest.mark.parametrize("seed", [0, 1])
def test_worklist_against_plain_refinement(spark, seed):
    rng = random.Random(seed)
    arcs = list({(s, rng.randrange(30), rng.choice("ab")) for s in range(30) for _ in range(2)})
    final = {s for s in range(30) if rng.random() < 0.3}
    reach, front = {0}, {0}
    while front:
        front = {d for s, d, _ in arcs if s in front} - reach
        reach |= front
    block = {s: int(s in final) for s in reach}
    while True:
        named = {s: (block[s], frozenset((x, block[d]) for a, d, x in arcs if a == s)) for s in reach}
        names = {v: i for i, v in enumerate(set(named.values()))}
        if len(names) == len(set(block.values())):
            break
        block = {s: names[v] for s, v in named.items()}
    small = automaton(spark, BOOLEAN, {0: True}, {s: True for s in final}, [arc(*a, True) for a in arcs]).minimize()
    assert small.arc_states().count() == len(set(block.values()))
    assert small.arcs.count() == len({(block[s], block[d], x) for s, d, x in arcs if s in reach})
