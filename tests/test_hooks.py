"""Strategies that callers choose, growing tables, and numbers dealt over partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arcloom.functions.semiring import PROBABILITY, TROPICAL
from arcloom.operators.compose import STRUCTS, compose, dense_composer
from arcloom.operators.distance import by_all_pairs, single_source
from arcloom.operators.project import numbered
from arcloom.operators.reach import accessible_states, is_cyclic
from arcloom.plans.iterate import Growing, counted
from arcloom.sources import constructors as make
from arcloom.sources.automaton import INTEGERS, TEXT, Alphabet


def test_dense_states_come_apart(spark):
    pack = dense_composer(5)
    rows = spark.range(60).select((F.col("id") % 5).alias("l"), (F.floor(F.col("id") / 15)).alias("r"), (F.floor(F.col("id") / 5) % 3).cast("byte").alias("e"))
    coded = rows.withColumn("s", pack.pack(F.col("l"), F.col("r"), F.col("e")))
    parts = pack.parts(F.col("s"))
    assert coded.filter((parts[0] != F.col("l")) | (parts[1] != F.col("r")) | (parts[2] != F.col("e"))).count() == 0
    assert coded.select("s").distinct().count() == 60


def test_composers_agree(spark):
    a = make.transducer(spark, PROBABILITY, {0: 1.0}, {2: 1.0}, [make.arc(0, 1, "a", 0.5, "x"), make.arc(1, 2, "b", 0.5, "")])
    b = make.transducer(spark, PROBABILITY, {0: 1.0}, {1: 1.0}, [make.arc(0, 1, "x", 0.25, "q"), make.arc(1, 1, "", 0.5, "z")])
    one, two = compose(a, b, composer=STRUCTS), compose(a, b, composer=dense_composer(3))
    number = lambda c: dense_composer(3).pack(*STRUCTS.parts(F.col(c)))
    x = {tuple(r) for r in one.arcs.select(number("src"), number("dst"), "ilabel", "olabel", "weight").collect()}
    assert x == {tuple(r) for r in two.arcs.select("src", "dst", "ilabel", "olabel", "weight").collect()} and x
    assert abs(one.cost().first().weight - two.cost().first().weight) < 1e-12


def test_distances_agree(spark):
    auto = make.automaton(spark, TROPICAL, {0: 0.0}, {3: 1.0}, [make.arc(0, 1, "a", 2.0), make.arc(0, 2, "b", 1.0), make.arc(1, 3, "c", 1.0), make.arc(2, 3, "d", 4.0)])
    costs = [auto.cost(distances=d).first().weight for d in (single_source, by_all_pairs)] + [auto.cost().first().weight]
    assert costs == [4.0] * 3
    pushed = [sorted(r.weight for r in auto.push_weights(distances=d).arcs.collect()) for d in (single_source, by_all_pairs)]
    assert pushed[0] == pushed[1]


def test_alphabets(spark):
    both = TEXT * INTEGERS
    row = spark.range(1).select(both.lit().alias("e")).first().e
    assert (row.left, row.right) == ("", -(1 << 31)) and Alphabet("") == TEXT


def test_growing_tables(spark):
    table = Growing(spark.range(0, 1))
    for k in range(1, 20):
        table.add(spark.range(k, k + 1))
    assert len(table.parts) <= Growing.MOST and sorted(r.id for r in table.all().collect()) == list(range(20))
    assert counted(spark.range(10).filter("id > 6"))[1] == 3 and counted(spark.range(0))[1] == 0
    assert counted(spark.range(10), F.col("id") > 7)[1] == 2 and counted(spark.createDataFrame([], "a int"), F.col("a") > 0)[1] == 0


def test_numbers_over_partitions(spark):
    states = spark.range(1000).select(F.when(F.col("id") < 900, "one").otherwise("two").alias("auto_id"), (F.col("id") * 7 % 1000).alias("state"))
    got = {}
    for r in numbered(states).collect():
        got.setdefault(r.auto_id, []).append((r.state, r.n))
    assert all([n for _, n in sorted(x)] == list(range(len(x))) for x in got.values()) and len(got["one"]) == 900


@pytest.mark.parametrize("back", [False, True])
def test_long_chains(spark, back):
    n = 24
    arcs = [make.arc(i, i + 1, "a", 1.0) for i in range(n)] + ([make.arc(n, n - 3, "b", 1.0)] if back else [])
    auto = make.automaton(spark, PROBABILITY, {0: 1.0}, {n: 1.0}, arcs)
    assert accessible_states(auto).count() == n + 1
    assert is_cyclic(auto).first().cyclic == back
