"""Small hand-checked automata for every operator."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from arcloom.functions.semiring import BOOLEAN, LOG, PROBABILITY, TROPICAL
from arcloom.operators.compose import compose
from arcloom.operators.counts import chain_counts, expected_counts
from arcloom.operators.distance import all_pairs, all_path_distances
from arcloom.operators.kbest import k_best, uniform
from arcloom.operators.minimize import approximate
from arcloom.operators.output import dot_lines, equal, fingerprint, write_dot
from arcloom.sources.constructors import arc, automaton, bigram_template, chains, constant, decay, edit_distance, int_automaton, poisson, positional_template, spelled, transducer, unigram_template

P_ARCS = [("0", "1", "a", 0), ("0", "1", "b", 1), ("0", "1", "c", 5), ("0", "2", "d", 0), ("0", "2", "e", 1), ("1", "3", "e", 0), ("1", "3", "f", 1), ("2", "3", "e", 4), ("2", "3", "f", 5)]


def p_automaton(spark, ring, one):
    return automaton(spark, ring, {0: one}, {3: one}, [arc(int(s), int(d), x, float(w)) for s, d, x, w in P_ARCS])


def arcs(auto):
    return {(r.src, r.dst, r.ilabel): round(r.weight, 9) for r in auto.arcs.collect()}


def ends(frame):
    return {r.state: r.weight for r in frame.collect()}


def total(auto):
    return auto.cost().first().weight


def test_one_arc_and_self_loop(spark):
    assert total(automaton(spark, LOG, {0: 0.0}, {1: 0.0}, [arc(0, 1, "a", 0.0)])) == 0
    assert abs(total(automaton(spark, LOG, {0: 0.0}, {0: 0.0}, [arc(0, 0, "", -1.0)])) + math.log(1 - math.exp(-1))) < 1e-9


def test_reverse(spark):
    a = automaton(spark, LOG, {0: 0.0}, {2: 0.0}, [arc(0, 1, "", -1.0), arc(1, 0, "", -2.0), arc(1, 2, "3", -3.0), arc(2, 0, "4", -5.0)]).reverse()
    assert arcs(a) == {(1, 0, ""): -1, (0, 1, ""): -2, (2, 1, "3"): -3, (0, 2, "4"): -5}
    assert ends(a.initial) == {2: 0} and ends(a.final) == {0: 0}
    lone = automaton(spark, LOG, {0: 0.0}, {0: 0.0}, []).reverse()
    assert ends(lone.initial) == {0: 0} and ends(lone.final) == {0: 0}


def test_push_tropical(spark):
    a = p_automaton(spark, TROPICAL, 0.0).push_weights()
    assert ends(a.initial) == {0: 0} and ends(a.final) == {3: 0}
    assert arcs(a) == {(0, 1, "a"): 0, (0, 1, "b"): 1, (0, 1, "c"): 5, (0, 2, "d"): 4, (0, 2, "e"): 5, (1, 3, "e"): 0, (1, 3, "f"): 1, (2, 3, "e"): 0, (2, 3, "f"): 1}


def test_push_probability(spark):
    a = p_automaton(spark, PROBABILITY, 1.0).push_weights()
    assert ends(a.initial) == {0: 15} and ends(a.final) == {3: 1}
    want = {(0, 1, "a"): 0, (0, 1, "b"): 1 / 15, (0, 1, "c"): 5 / 15, (0, 2, "d"): 0, (0, 2, "e"): 9 / 15, (1, 3, "e"): 0, (1, 3, "f"): 1, (2, 3, "e"): 4 / 9, (2, 3, "f"): 5 / 9}
    assert arcs(a) == {k: round(v, 9) for k, v in want.items()}


def test_relabel_keeps_cost(spark):
    a = (constant(spark, "aa", 0.0, LOG) >> edit_distance(spark, -3.0, -3.0, "ab")).push_weights()
    b = a.relabel()
    assert abs(total(a) - total(b)) < 1e-6
    numbers = sorted(r.state for r in b.arc_states().collect())
    assert numbers == list(range(len(numbers)))


def test_lengths(spark):
    assert abs(total(decay(spark, 4.0, "bcd"))) < 1e-10
    assert abs(math.exp(total(poisson(spark, 4.0, 5, "ab"))) - 0.975760) < 1e-5
    assert abs(total(poisson(spark, 4.0, 5, "ab", normalized=True))) < 1e-9


def test_determinize_boolean(spark):
    listed = [(1, 2, 0), (1, 2, 1), (1, 4, 1), (1, 4, 0), (2, 2, 1), (2, 4, 1), (3, 2, 1), (3, 4, 1), (3, 4, 0), (4, 2, 0)]
    a = automaton(spark, BOOLEAN, {1: True}, {3: True, 4: True}, [arc(s, d, x, True) for s, d, x in listed]).determinize()
    assert {(tuple(r.src), tuple(r.dst), r.ilabel) for r in a.arcs.collect()} == {((1,), (2, 4), 1), ((1,), (2, 4), 0), ((2, 4), (2, 4), 1), ((2, 4), (2,), 0), ((2,), (2, 4), 1)}


def test_determinize_weighted(spark):
    words = (constant(spark, "ab", 3.0, PROBABILITY) | constant(spark, "ac", 1.0, PROBABILITY)).relabel() | constant(spark, "b", 2.0, PROBABILITY)
    got = words.relabel().determinize()
    assert sorted((r.ilabel, round(r.weight, 9)) for r in got.arcs.collect()) == [("a", 4), ("b", 0.75), ("b", 2), ("c", 0.25)]


@pytest.mark.parametrize(("sub", "ins", "letters", "text", "zero"), [(-3.0, -4.0, "abc", "abc", True), (-math.inf, -math.inf, "abc", "abc", True), (-2.0, -math.inf, "abc", "abc", True), (-2.0, -3.0, "abc", "abc", True), (-3.0, -4.0, "ab", "a", True)])
def test_edit_distance_mass(spark, sub, ins, letters, text, zero):
    edits, own = edit_distance(spark, sub, ins, letters), constant(spark, text, 0.0, LOG)
    assert abs(total(edits >> own)) < 1e-6


def test_edit_distance_symmetric(spark):
    edits, own = edit_distance(spark, -3.0, -4.0, "abc"), constant(spark, "abc", 0.0, LOG)
    assert abs(total(edits >> own) - total(own >> edits)) < 1e-6


def test_remove_epsilons(spark):
    listed = [(0, 1, "a", "b", 0.1), (1, 2, "", "", 0.2), (1, 4, "b", "a", 0.2), (2, 0, "b", "a", 0.1), (2, 1, "a", "b", 0.4), (2, 4, "a", "b", 0.4), (2, 4, "", "", 0.25), (2, 3, "", "", 0.5), (3, 0, "", "", 0.4), (3, 4, "", "", 1.0)]
    a = transducer(spark, PROBABILITY, {0: 1.0}, {4: 0.2}, [arc(s, d, i, w, o) for s, d, i, o, w in listed])
    b = a.remove_epsilons().collapse_edges()
    got = {(r.src, r.dst, r.ilabel): round(r.weight, 9) for r in b.edges().collect()}
    assert got == {(0, 1, "a"): 0.1, (1, 0, "b"): 0.02, (1, 1, "a"): 0.084, (1, 4, "a"): 0.08, (1, 4, "b"): 0.2}
    final = {k: round(v, 9) for k, v in ends(b.final).items()}
    assert ends(b.initial) == {0: 1} and final[1] == 0.03 and final[4] == 0.2


def test_remove_epsilons_corrections(spark):
    plain = automaton(spark, PROBABILITY, {0: 1.0}, {1: 1.0}, [arc(0, 1, "a", 1.0)])
    assert arcs(plain.remove_epsilons()) == {(0, 1, "a"): 1}
    a = automaton(spark, PROBABILITY, {0: 1.0}, {2: 1.0, 3: 0.7}, [arc(0, 1, "", 0.5), arc(1, 2, "a", 0.4), arc(2, 3, "b", 0.3)]).remove_epsilons()
    assert arcs(a) == {(0, 2, "a"): 0.2, (1, 2, "a"): 0.4, (2, 3, "b"): 0.3} and ends(a.initial) == {0: 1} and ends(a.final) == {2: 1, 3: 0.7}


def test_k_best(spark):
    words = (constant(spark, "Hello", 1.0, PROBABILITY) | constant(spark, "HellX", 0.2, PROBABILITY)).relabel() | constant(spark, "GoodBye", 0.1, PROBABILITY)
    for how in ({}, {"heuristic": uniform}):
        got = k_best(words, 5, **how).orderBy("rank").collect()
        assert [(r.text, round(r.weight, 9)) for r in got] == [("Hello", 1), ("HellX", 0.2), ("GoodBye", 0.1)]
    three = automaton(spark, TROPICAL, {0: 0.0}, {1: 0.0}, [arc(0, 1, "a", 3.0), arc(0, 1, "b", 1.0), arc(0, 1, "c", 2.0)])
    assert [r.weight for r in k_best(three, 3).orderBy("rank").collect()] == [1, 2, 3]


@pytest.mark.parametrize("how", [{}, {"partitioner": approximate(6)}])
def test_minimize_pushed(spark, how):
    got = p_automaton(spark, TROPICAL, 0.0).push_weights().minimize(**how)
    by = {}
    for r in got.arcs.collect():
        by.setdefault((r.src, r.dst), set()).add((r.ilabel, r.weight))
    assert sorted(map(sorted, by.values())) == [[("a", 0), ("b", 1), ("c", 5), ("d", 4), ("e", 5)], [("e", 0), ("f", 1)]]
    assert got.arc_states().count() == 3


def test_minimize_union(spark):
    both = (constant(spark, "hello", 1.0, PROBABILITY) | constant(spark, "hello", 1.0, PROBABILITY)).minimize()
    assert both.arc_states().count() == 6 and abs(total(both) - 2) < 1e-9


def test_minimize_keeps_cost(spark):
    edits = lambda t: (edit_distance(spark, -3.0, -3.0, "cuko") >> constant(spark, t, 0.0, LOG)).input_projection().relabel()
    both = (edits("cu") & edits("ko")).relabel()
    assert abs(total(both) - total(both.minimize(partitioner=approximate(6)))) < 1e-2


def counts(frame):
    return {(r.src, r.dst, r.label): round(r.weight, 9) for r in frame.collect()}


def test_expected_counts(spark):
    own = constant(spark, "Hello", 0.0, LOG)
    two = round(math.log(2), 9)
    want = {
        "unigram": ({(1, 1, "H"): 0, (1, 1, "e"): 0, (1, 1, "l"): two, (1, 1, "o"): 0, (1, 0, ""): 0}, unigram_template(spark, "Helo", LOG), 10),
        "bigram": ({("#", "H", "H"): 0, ("H", "e", "e"): 0, ("e", "l", "l"): 0, ("l", "l", "l"): 0, ("l", "o", "o"): 0, ("o", "", ""): 0}, bigram_template(spark, "#", "Helo", LOG), 10),
        "positional": ({(0, 1, "H"): 0, (1, 2, "e"): 0, (2, 2, "l"): two, (2, 2, "o"): 0, (2, -1, ""): 0}, positional_template(spark, "Helo", 3, LOG), 3),
    }
    steps = spelled(spark.createDataFrame([("h", "Hello")], "i string, t string"), "i", "t")
    for name, (expected, template, longest) in want.items():
        assert counts(expected_counts(own, template)) == expected
        assert counts(chain_counts(steps, LOG, name, longest=longest)) == expected


def test_positional_long(spark):
    got = counts(expected_counts(constant(spark, "Hello", 0.0, LOG), positional_template(spark, "Helo", 10, LOG)))
    assert got == {(0, 1, "H"): 0, (1, 2, "e"): 0, (2, 3, "l"): 0, (3, 4, "l"): 0, (4, 5, "o"): 0, (5, -1, ""): 0}


def test_states_once_and_filters(spark):
    loop = automaton(spark, PROBABILITY, {0: 1.0}, {0: 0.5}, [arc(0, 0, "a", 0.5)])
    assert [r.state for r in loop.states().collect()] == [0]
    cut = constant(spark, "abc", 1.0, PROBABILITY).filter_arcs(F.col("ilabel") != "a")
    assert {r.ilabel for r in cut.edges().collect()} == {"b", "c"}


def test_output(spark, tmp_path):
    a = automaton(spark, PROBABILITY, {0: 1.0}, {1: 0.5}, [arc(0, 1, 'q"', 0.25)])
    assert {r.line for r in dot_lines(a).collect()} == {'"0"->"1"[label="q\\"/0.25"]', '"0"[label="0 0.0",style=bold]', '"1"[label="1 0.5"]'}
    write_dot(a, f"file://{tmp_path}/dot")
    assert equal(a, a) and not equal(a, constant(spark, "a", 1.0, PROBABILITY))
    assert fingerprint(a).count() == 1


def test_int_automaton_and_guard(spark):
    a = int_automaton(spark, PROBABILITY, [[(1, 7, 0.5)], []], [1.0, 0.0], [0.0, 1.0])
    assert ends(a.initial) == {0: 1} and abs(total(a) - 0.5) < 1e-12
    bad = automaton(spark, PROBABILITY, {0: 1.0, 1: 0.5}, {1: 1.0}, [arc(0, 0, "a", 1.0), arc(0, 1, "a", 1.0), arc(1, 1, "a", 2.0)])
    with pytest.raises(RuntimeError):
        bad.determinize(max_states=5)


def test_empty(spark):
    none = automaton(spark, PROBABILITY, {}, {}, [])
    assert none.cost().count() == 0 and none.states().count() == 0 and (none & none).arcs.count() == 0
    assert all_path_distances(none).count() == 0 and k_best(none, 2).count() == 0


def paths(listed, initial, final, longest):
    """Weight of every string of at most longest letters, by walking all paths."""
    out, open_ = {}, [(s, "", w) for s, w in initial.items()]
    for _ in range(longest + 1):
        grown = []
        for s, t, w in open_:
            if s in final:
                out[t] = out.get(t, 0) + w * final[s]
            grown += [(d, t + x, w * v) for a, d, x, v in listed if a == s]
        open_ = grown
    return {t: w for t, w in out.items() if w}


@pytest.mark.parametrize("seed", range(3))
def test_random_acyclic(spark, seed):
    rng = random.Random(seed)
    make = lambda: [(s, d, rng.choice("ab"), rng.choice([0.25, 0.5, 1.0])) for s, d in itertools.combinations(range(5), 2) if rng.random() < 0.6]
    one, two = make(), make()
    a, b = (automaton(spark, PROBABILITY, {0: 1.0}, {4: 1.0, 3: 0.5}, [arc(*x) for x in y]) for y in (one, two))
    final = {4: 1.0, 3: 0.5}
    pa, pb = paths(one, {0: 1.0}, final, 6), paths(two, {0: 1.0}, final, 6)
    assert abs(total(a) - sum(pa.values())) < 1e-9
    assert abs(total(a.reverse()) - total(a)) < 1e-9
    assert abs(total(a & b) - sum(w * pb.get(t, 0) for t, w in pa.items())) < 1e-9
    assert abs(total(a | b) - sum(pa.values()) - sum(pb.values())) < 1e-9
    for c in (a.push_weights(), a.determinize(), a.minimize()):
        got = {}
        for r in k_best(c, 1000, max_len=8).collect():
            got[r.text] = got.get(r.text, 0) + r.weight
        assert {t: round(w, 9) for t, w in got.items()} == {t: round(w, 9) for t, w in pa.items()}


def test_all_pairs_with_cycle(spark):
    a = automaton(spark, PROBABILITY, {0: 1.0}, {1: 1.0}, [arc(0, 1, "a", 0.5), arc(1, 0, "b", 0.5)])
    got = {(r.src, r.dst): round(r.weight, 9) for r in all_pairs(a).collect()}
    assert got == {(0, 0): round(4 / 3, 9), (1, 1): round(4 / 3, 9), (0, 1): round(2 / 3, 9), (1, 0): round(2 / 3, 9)}
    assert abs(total(a) - 2 / 3) < 1e-9


def test_compose_associates(spark):
    make = lambda x: transducer(spark, PROBABILITY, {0: 1.0}, {1: 1.0}, x)
    a, b, c = make([arc(0, 1, "a", 0.5, "b"), arc(0, 1, "a", 0.25, "")]), make([arc(0, 1, "b", 0.5, "c"), arc(0, 1, "", 2.0, "c")]), make([arc(0, 1, "c", 0.5, "d")])
    assert abs(total((a >> b) >> c) - total(a >> (b >> c))) < 1e-12
    assert abs(total(compose(a, b)) - (0.5 * 0.5 + 0.25 * 2.0)) < 1e-12


def test_chains_of_a_batch(spark):
    steps = spelled(spark.createDataFrame([("x", "ab"), ("y", "abc")], "i string, t string"), "i", "t")
    assert {r.auto_id: r.weight for r in chains(steps, PROBABILITY, 0.5).cost().collect()} == {"x": 0.5, "y": 0.5}


def test_k_best_limit(spark):
    """Paths have any length, unless the caller sets a limit."""
    auto = constant(spark, "Hello", 1.0, PROBABILITY)
    assert k_best(auto, 1, max_len=3, heuristic=uniform).count() == 0
    assert [r.text for r in k_best(auto, 1, max_len=5, heuristic=uniform).collect()] == ["Hello"]
    assert [r.text for r in k_best(auto, 1, heuristic=uniform).collect()] == ["Hello"]
