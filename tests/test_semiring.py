"""The axioms of each ring, on its scalars and on its columns."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arcloom.functions.semiring import BOOLEAN, LOG, PROBABILITY, RINGS, TROPICAL, log_diff

VALUES = {
    "boolean": st.booleans(),
    "probability": st.floats(0, 0.9),
    "log": st.one_of(st.just(-math.inf), st.floats(-20, -0.01)),
    "tropical": st.one_of(st.just(math.inf), st.floats(0, 100)),
}


@pytest.mark.parametrize("name", RINGS)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_axioms(name, data):
    r = RINGS[name]
    a, b, c = (data.draw(VALUES[name]) for _ in range(3))
    same = r.close_
    assert same(r.plus_(a, r.zero), a) and same(r.plus_(a, b), r.plus_(b, a))
    assert same(r.plus_(a, r.plus_(b, c)), r.plus_(r.plus_(a, b), c))
    assert same(r.times_(a, r.times_(b, c)), r.times_(r.times_(a, b), c))
    assert same(r.times_(a, r.one), a) and same(r.times_(a, r.zero), r.zero)
    assert same(r.times_(a, r.plus_(b, c)), r.plus_(r.times_(a, b), r.times_(a, c)))
    assert same(r.times_(r.plus_(a, b), c), r.plus_(r.times_(a, c), r.times_(b, c)))
    assert same(r.closure_(r.zero), r.one)


ROWS = {
    "boolean": [True, False, False, True],
    "probability": [0.25, 0.0, 0.5, 0.125],
    "log": [-800.0, -900.0, -math.inf, -0.5],
    "tropical": [3.0, math.inf, 0.0, 7.5],
}


@pytest.mark.parametrize("name", RINGS)
def test_columns_agree_with_scalars(spark, name):
    r, rows = RINGS[name], ROWS[name]
    df = spark.createDataFrame([("k", i, a, b) for i, a in enumerate(rows) for b in rows], f"k string, i int, a {r.type}, b {r.type}")
    for row in df.select("a", "b", r.times(F.col("a"), F.col("b")).alias("t")).collect():
        assert r.close_(row.t, r.times_(row.a, row.b))
    got = {x.i: x.a for x in r.sum(df.select("k", "i", "a"), ["k", "i"], "a").collect()}
    for i, a in enumerate(rows):
        assert r.close_(got[i], r.total_([a] * len(rows)))
    assert r.close_(r.sum(df, [], "b").first()[0], r.total_(rows * len(rows)))


def test_log_sums_of_very_small_weights(spark):
    df = spark.createDataFrame([("a", -5000.0), ("a", -5000.0), ("b", -math.inf), ("c", -1e4), ("c", -1.0)], "k string, weight double")
    got = {r.k: r.weight for r in LOG.sum(df, ["k"]).collect()}
    assert abs(got["a"] - (-5000 + math.log(2))) < 1e-9 and got["b"] == -math.inf and abs(got["c"] + 1) < 1e-9


def test_divide_and_closure(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(PROBABILITY.divide(F.lit(0.5), F.lit(0.25))) == 0.5
    assert value(TROPICAL.divide(F.lit(2.0), F.lit(5.0))) == 3.0
    assert value(BOOLEAN.divide(F.lit(True), F.lit(False))) is False
    assert abs(value(LOG.closure(F.lit(-1.0))) - 0.4586751453870819) < 1e-12
    assert abs(value(log_diff(F.lit(math.log(3.0)), F.lit(math.log(1.0)))) - math.log(2)) < 1e-12
