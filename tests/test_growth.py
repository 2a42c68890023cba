"""What loops do no more often than they must."""

import pytest

from arcloom.functions.semiring import LOG, PROBABILITY
from arcloom.operators import distance, minimize, output, reach
from arcloom.sources import constructors as make


def ring_of(spark, n):
    arcs = [make.arc(0, 1, "a", 0.5)] + [x for i in range(2, n) for x in (make.arc(1, i, "a", 0.1), make.arc(i, 1, "b", 0.5))]
    return make.transducer(spark, PROBABILITY, {0: 1.0}, {1: 1.0}, arcs)


def test_supersteps_end_once_states_are_come_back_to(spark, monkeypatch):
    moves, moved = [], distance._moved
    monkeypatch.setattr(distance, "_moved", lambda *a: moves.append(1) or moved(*a))
    auto = ring_of(spark, 6)
    links, start = distance._started(auto)
    found, front, before = distance._tried(PROBABILITY, links, start, 10)
    assert found is None and before is None and front.count() == 1 and len(moves) < 8
    sums = {r.state: r.weight for r in distance.all_path_distances(auto).collect()}
    assert sums[1] == pytest.approx(0.5 / 0.8) and sums[2] == pytest.approx(0.05 / 0.8)


def test_log_sums_list_nothing(spark):
    rows = [("a", w) for w in (-1e5, -1e5 + 1, -513.0, -511.0, -1024.5)] + [("b", float("-inf"))] + [("c", -2000.0), ("c", -2000.0)]
    total = LOG.sum(spark.createDataFrame(rows, "k string, weight double"), ["k"])
    assert "collect_list" not in total._jdf.queryExecution().toString()
    got = {r.k: r.weight for r in total.collect()}
    assert got["a"] == pytest.approx(-511 + 0.126928011, abs=1e-8) and got["b"] == float("-inf") and got["c"] == pytest.approx(-2000 + 0.693147181)


def test_classes_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(minimize, "Replaced", None)
    values = spark.range(2000).selectExpr("'a' AS auto_id", "id * 1e-3D + (id DIV 500) AS weight").unionByName(spark.sql("SELECT 'b' AS auto_id, 7D AS weight"))
    got = minimize.close_classes(values, 2e-3).groupBy("auto_id", "least").count().collect()
    assert {(r.auto_id, round(r.least, 6), r["count"]) for r in got} == {("a", 0.0, 500), ("a", 1.5, 500), ("a", 3.0, 500), ("a", 4.5, 500), ("b", 7.0, 1)}


def test_equality_finds_arcs_once(spark, monkeypatch):
    calls, found = [], reach.accessible_states
    monkeypatch.setattr(reach, "accessible_states", lambda *a: calls.append(1) or found(*a))
    a = ring_of(spark, 4).swap_labels()
    assert output.equal(a, a) and len(calls) <= 1


def test_accessible_states_are_looked_for_only_where_there_are_cycles(spark, monkeypatch):
    def none(*args):
        raise AssertionError("accessible states were looked for")

    tree = make.transducer(spark, PROBABILITY, {0: 1.0}, {2: 1.0}, [make.arc(0, 1, "a"), make.arc(1, 2, "a")])
    off = make.transducer(spark, PROBABILITY, {0: 1.0}, {2: 1.0}, [make.arc(0, 1, "a"), make.arc(2, 3, "a"), make.arc(3, 2, "a")])
    assert [r.cyclic for r in reach.is_cyclic(off).collect()] == [False]
    monkeypatch.setattr(reach, "accessible_states", none)
    assert [r.cyclic for r in reach.is_cyclic(tree).collect()] == [False]
