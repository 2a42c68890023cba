"""Best-first search: long chains, going on, ties, cycles, and random graphs against all paths listed."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from arcloom.functions.semiring import LOG, PROBABILITY, TROPICAL
from arcloom.operators.kbest import BestPaths, a_star, best_way, k_best, uniform
from arcloom.sources.automaton import Automaton
from arcloom.sources.constructors import arc, automaton


def listed(arcs, start, end, longest):
    """All paths of at most longest arcs: (labels, weight product)."""
    out, front = [], [(s, (), w, 0) for s, w in start.items()]
    while front:
        out += [(labels, w * end[s]) for s, labels, w, _ in front if s in end]
        front = [(d, labels + ((x,) if x else ()), w * v, n + 1) for s, labels, w, n in front if n < longest for a, d, x, v in arcs if a == s]
    return out


@pytest.mark.parametrize("heuristic", [best_way, a_star, uniform])
@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_paths(spark, seed, heuristic):
    rng = random.Random(seed)
    arcs = [(s, rng.randrange(s + 1, 9), rng.choice(["a", "b", ""]), rng.choice([0.5, 0.25, 0.125])) for s in range(8) for _ in range(3)]
    start, end = {0: 1.0, 2: 0.5}, {8: 1.0, 6: 0.5}
    auto = automaton(spark, PROBABILITY, start, end, [arc(s, d, x, w) for s, d, x, w in arcs])
    want = sorted(listed(arcs, start, end, 20), key=lambda x: (-x[1], x[0]))
    search = BestPaths(auto, heuristic)
    first, more = search.next(3).orderBy("rank").collect(), search.next(9).orderBy("rank").collect()
    got = [(tuple(r.labels), r.weight) for r in first + more]
    assert [r.rank for r in first + more] == list(range(1, 13)) and got == want[:12]


def test_goes_on_to_the_end(spark):
    auto = automaton(spark, PROBABILITY, {0: 1.0}, {2: 1.0}, [arc(0, 1, "a", 0.5), arc(0, 1, "b", 0.5), arc(1, 2, "c", 0.5)])
    search = BestPaths(auto)
    assert [[r.text for r in search.next(1).collect()] for _ in range(3)] == [["ac"], ["bc"], []]


def test_long_chain_and_going_on(spark):
    n = 2000
    arcs = spark.range(n).select(F.lit("a").alias("auto_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.col("id") % 10).cast("string").alias("ilabel"), (F.col("id") % 10).cast("string").alias("olabel"), F.lit(0.999).alias("weight"))
    detour = spark.createDataFrame([("a", 700, 702, "x", "x", 0.1)], arcs.schema)
    ends = [spark.createDataFrame([("a", s, 1.0)], "auto_id string, state long, weight double") for s in (0, n)]
    search = BestPaths(Automaton(arcs.unionByName(detour), *ends, PROBABILITY))
    best, other = search.next(1).first(), search.next(5).collect()
    text = "".join(str(i % 10) for i in range(n))
    assert best.text == text and best.weight == pytest.approx(0.999**n)
    assert [(r.rank, r.text) for r in other] == [(2, text[:700] + "x" + text[702:])] and other[0].weight == pytest.approx(0.1 * 0.999 ** (n - 2))


@pytest.mark.parametrize("ring", [LOG, TROPICAL], ids=lambda r: r.name)
def test_cycles(spark, ring):
    sign = -1.0 if ring is LOG else 1.0
    auto = automaton(spark, ring, {0: 0.0}, {1: 0.0}, [arc(0, 0, "a", sign), arc(0, 1, "b", 2 * sign), arc(1, 0, "c", 2 * sign)])
    got = [(r.text, r.weight) for r in k_best(auto, 5).orderBy("rank").collect()]
    assert got == [("b", 2 * sign), ("ab", 3 * sign), ("aab", 4 * sign), ("aaab", 5 * sign), ("aaaab", 6 * sign)]
    assert [r.text for r in k_best(auto, 5, max_len=3).orderBy("rank").collect()] == ["b", "ab", "aab", "bcb"]


def test_many_ties(spark):
    """2 ** 12 paths of one weight: the first by labels, without listing them all."""
    auto = automaton(spark, PROBABILITY, {0: 1.0}, {12: 1.0}, [arc(s, s + 1, x, 0.5) for s in range(12) for x in "ba"])
    got = [r.text for r in k_best(auto, 6).orderBy("rank").collect()]
    assert got == ["".join(x) for x in itertools.islice(itertools.product("ab", repeat=12), 6)]


def test_several_automata_and_limits(spark):
    arcs = spark.createDataFrame([("p", 0, 1, "a", "a", 0.5), ("q", 0, 1, "b", "b", 0.5), ("q", 0, 1, "c", "c", 0.25)], "auto_id string, src long, dst long, ilabel string, olabel string, weight double")
    ends = [spark.createDataFrame([(i, s, 1.0) for i in "pqr"], "auto_id string, state long, weight double") for s in (0, 1)]
    auto = Automaton(arcs, *ends, PROBABILITY)
    assert sorted((r.auto_id, r["rank"], r.text) for r in k_best(auto, 2).collect()) == [("p", 1, "a"), ("q", 1, "b"), ("q", 2, "c")]
    again = Automaton(arcs.unionByName(spark.createDataFrame([("p", 1, 0, "d", "d", 0.5)], arcs.schema)), *ends, PROBABILITY)
    with pytest.raises(RuntimeError, match="more than 2 steps"):
        BestPaths(again, uniform, max_steps=2).next(200)
