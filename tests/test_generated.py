"""Arcs made on demand give what the listed ones do."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from arcloom.functions.semiring import LOG, PROBABILITY, TROPICAL
from arcloom.operators.compose import compose
from arcloom.operators.distance import all_path_distances
from arcloom.operators.generated import Generated, arcs_on_demand, compose_generated
from arcloom.sources import constructors as make
from arcloom.sources.generators import any_lengths, edits_to


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 7))) for _ in range(10)]
    pairs = [(str(i), a, b) for i, a in enumerate(words) for b in [*words, ""]]
    targets = spark.createDataFrame([(i, b) for i, _, b in pairs] + [("0", None), ("0", words[1])], "auto_id string, word string")
    texts = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "auto_id string, t string")
    made = compose_generated(make.chains(make.spelled(texts, "auto_id", "t"), TROPICAL), edits_to(targets, 2))
    ends = all_path_distances(made).join(made.final.select("auto_id", "state"), ["auto_id", "state"])
    got = {(r.auto_id, r.word): r.d for r in ends.groupBy("auto_id", F.col("state.r.word").alias("word")).agg(F.min("weight").alias("d")).collect()}
    want = {(i, b): levenshtein(a, b) for i, a, b in pairs if levenshtein(a, b) <= 2}
    assert got == want and len(want) > 10


def listed_and_generated(spark):
    """A machine with silent arcs, listed over an alphabet of two, and as expressions."""
    arcs = [make.arc(s, d, i, w, o) for s, d, i, o, w in [(0, 0, "x", "q", 0.25), (0, 1, "x", "", 0.125), (0, 1, "", "z", 0.5), (0, 0, "y", "q", 0.25), (0, 1, "y", "", 0.125), (1, 1, "x", "r", 0.5), (1, 1, "y", "r", 0.5)]]
    listed = make.transducer(spark, PROBABILITY, {0: 1.0}, {1: 1.0}, arcs)
    arc = lambda d, o, w: F.struct(F.lit(d).cast("long").alias("dst"), F.lit(o).alias("olabel"), F.lit(w).alias("weight"))
    made = Generated(
        listed.initial,
        lambda s, c: F.when(s == 0, F.array(arc(0, "q", 0.25), arc(1, "", 0.125))).otherwise(F.array(arc(1, "r", 0.5))),
        lambda s: F.when(s == 0, F.array(arc(1, "z", 0.5))).otherwise(F.slice(F.array(arc(1, "z", 0.5)), 1, 0)),
        lambda s: F.when(s == 1, F.lit(1.0)).otherwise(F.lit(0.0)),
        PROBABILITY,
    )
    return listed, made


def test_same_as_listed_arcs(spark):
    listed, made = listed_and_generated(spark)
    left = make.transducer(spark, PROBABILITY, {0: 1.0}, {2: 1.0}, [make.arc(0, 1, "a", 0.5, "x"), make.arc(1, 2, "b", 0.5, ""), make.arc(1, 2, "c", 0.75, "y"), make.arc(0, 1, "d", 0.25, "")])
    one, two = compose(left, listed), compose_generated(left, made)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(one.arcs) == rows(two.arcs) and one.arcs.count() > 5
    assert rows(one.initial) == rows(two.initial) and rows(one.final) == rows(two.final)


def test_asked_arcs(spark):
    listed, made = listed_and_generated(spark)
    asked = spark.createDataFrame([("a", 0, "x"), ("a", 0, "never listed"), ("a", 1, ""), ("a", 0, ""), ("a", None, "x"), ("a", 0, None)], "auto_id string, state long, label string")
    got = sorted((r.src, r.ilabel, r.dst, r.olabel, r.weight) for r in arcs_on_demand(made, asked).collect())
    assert got == [(0, "", 1, "z", 0.5), (0, "never listed", 0, "q", 0.25), (0, "never listed", 1, "", 0.125), (0, "x", 0, "q", 0.25), (0, "x", 1, "", 0.125)]


def test_lengths_and_no_start(spark):
    chain = make.constant(spark, "héx", 0.0, LOG)
    listed = replace(make.decay(spark, 2.0, "héx0"), shared=True)
    generated = compose_generated(chain, any_lengths(spark, 2.0, 4)).cost().first().weight
    assert abs(generated - (chain & listed).cost().first().weight) < 1e-12
    none = compose_generated(make.constant(spark, "ab", 0.0, TROPICAL), edits_to(spark.createDataFrame([], "auto_id string, word string"), 2))
    assert none.arcs.count() == 0 and none.final.count() == 0 and none.cost().count() == 0
