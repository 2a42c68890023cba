"""The driver's entry points, and every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUICK = ["constant_chain", "layer_arcs", "edit_arcs", "filter_arcs", "match_input", "reverse", "relabel", "union", "collapse_edges_log", "collapse_edges_bool", "forward_trop", "forward_log", "all_pairs", "expected_bigram", "expected_positional", "push_weights", "remove_epsilons", "determinize_weighted", "minimize_trie", "kbest", "dot_lines"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple("~" if x is None or x != x else x for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())
