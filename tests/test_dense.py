"""Products of blocks against sums over paths made one by one."""

from __future__ import annotations

import random

import pytest

from arcloom.functions.semiring import BOOLEAN, PROBABILITY, TROPICAL
from arcloom.operators.dense import block_distances, dense_blocks
from arcloom.sources import constructors as make

N = 9


def layered(spark, ring, weight):
    rng = random.Random(3)
    arcs = [(i, j, weight(rng)) for i in range(N) for j in range(i + 1, N) if rng.random() < 0.5] + [(0, N - 1, weight(rng))] * 2  # parallel
    rows = [make.arc(i, j, str(k), w) for k, (i, j, w) in enumerate(arcs)]
    return make.automaton(spark, ring, {0: ring.one, 99: ring.one}, {N - 1: ring.one}, rows), arcs


def sums(ring, arcs):
    found = {(s, s): ring.one for s in [*range(N), 99]}
    for s in range(N):
        for d in range(s + 1, N):
            ways = [ring.times_(found[s, i], w) for i, j, w in arcs if j == d and (s, i) in found]
            if ways:
                found[s, d] = ring.total_(ways)
    return found


@pytest.mark.parametrize("ring", [PROBABILITY, TROPICAL, BOOLEAN])
def test_blocks_against_paths(spark, ring):
    auto, arcs = layered(spark, ring, lambda r: True if ring.name == "boolean" else r.random())
    got, want = {(r.src, r.dst): r.weight for r in block_distances(dense_blocks(auto, 4)).collect()}, sums(ring, arcs)
    assert got.keys() == want.keys() and len(want) > 25
    assert all(ring.close_(got[k], want[k]) for k in got)


def test_cycles_raise_and_nothing_is_nothing(spark):
    loop = make.automaton(spark, PROBABILITY, {0: 1.0}, {0: 1.0}, [make.arc(0, 0, "a", 0.5)])
    with pytest.raises(RuntimeError):
        block_distances(dense_blocks(loop), max_doublings=2)
    empty = loop.with_arcs(loop.arcs.filter("src > 5"))
    assert [(r.src, r.dst, r.weight) for r in block_distances(dense_blocks(empty)).collect()] == [(0, 0, 1.0)]
