"""Expected counts of long chains take a logarithm of their length in jobs, and are those of the form without a loop."""

import pytest

from arcloom.functions.semiring import PROBABILITY
from arcloom.operators.counts import chain_counts, expected_counts
from arcloom.plans import iterate
from arcloom.sources import constructors as make


@pytest.mark.parametrize("kind", ["bigram", "positional", "unigram"])
def test_long_chains(spark, monkeypatch, kind):
    texts = {"x": "abca" * 24 + "b", "y": "bb" * 9, "z": "c"}
    steps = spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "auto_id string, pos long, label string")
    template = {"bigram": lambda: make.bigram_template(spark, "#", "abc"), "positional": lambda: make.positional_template(spark, "abc", 3), "unigram": lambda: make.unigram_template(spark, "abc")}[kind]()
    writes, stored = [], iterate._stored

    def counting(df, test):
        writes.append(1)
        assert len(writes) <= 140, "as many jobs as the chain has arcs"
        return stored(df, test)

    monkeypatch.setattr(iterate, "_stored", counting)
    got = {(r.src, r.dst, r.label): round(r.weight, 6) for r in expected_counts(make.chains(steps, PROBABILITY), template).collect()}
    want = {(r.src, r.dst, r.label): round(r.weight, 6) for r in chain_counts(steps, PROBABILITY, kind, longest=3).collect()}
    print(len(writes))
    assert got == want
