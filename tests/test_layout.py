"""Arcs lie in buckets: a superstep moves its frontier to them, never the arcs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from arcloom.functions.semiring import PROBABILITY
from arcloom.operators.distance import _moved
from arcloom.plans.iterate import Replaced, counted, laid_out


@pytest.mark.parametrize("state", ["id", "struct(id)", "array(id)"])
def test_superstep_leaves_arcs_in_place(spark, state):
    state = F.expr(state)
    arcs = spark.range(1000).select(F.lit("a").alias("auto_id"), state.alias("src"), state.alias("dst"), F.lit(0.5).alias("weight"))
    links = laid_out(arcs, "auto_id", "src")
    front, n = counted(arcs.select("auto_id", F.col("src").alias("state"), "weight"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        moved = _moved(PROBABILITY, front, links.filter("weight > 0"))
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert moved.count() == n == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan


def test_replaced_tables_go(spark):
    def files():
        return set(table.rows.inputFiles())

    table = Replaced(spark.range(5), F.col("id") > 2)
    assert table.n == 2 and table.rows.count() == 5
    before, path = files(), table.path
    table.put(table.rows.filter("id > 3"))
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert table.n == 1 and not (before & files())
    assert not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
