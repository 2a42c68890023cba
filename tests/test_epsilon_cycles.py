"""Epsilon cycles that no other arc leaves need no pairs of states."""

import pytest

from arcloom.functions.semiring import PROBABILITY
from arcloom.operators import epsilon
from arcloom.sources import constructors as make


def test_no_pairs_where_only_final_weights_follow(spark, monkeypatch):
    def none(*args, **kwargs):
        raise AssertionError("pairs of states were made")

    monkeypatch.setattr(epsilon, "all_pairs", none)
    arcs = [make.arc(0, 1, "a", 0.5)] + [x for i in range(2, 6) for x in (make.arc(1, i, "", 0.1), make.arc(i, 1, "", 0.5))]
    auto = make.transducer(spark, PROBABILITY, {0: 1.0}, {i: 1.0 for i in range(2, 6)}, arcs).remove_epsilons()
    assert [(r.src, r.dst, r.weight) for r in auto.arcs.collect()] == [(0, 1, 0.5)]
    final = {r.state: r.weight for r in auto.final.collect()}
    assert final[1] == pytest.approx(0.4 / 0.8) and final[2] == pytest.approx(1 + 0.5 * 0.4 / 0.8)
