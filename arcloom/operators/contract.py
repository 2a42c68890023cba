"""Unary chains shortened to one arc, by pointer jumping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring
from arcloom.plans.iterate import Replaced, laid_out, settled

KEYS = ["auto_id", "state"]


@dataclass(frozen=True)
class Contracted:
    """links: (auto_id, src, dst, weight) between the states that are left. inner: (auto_id, state, at, weight), the states inside
    chains, with the state at which their chain begins and the product from there. rings: (auto_id, state) of cycles that
    no other state leads to."""

    links: DataFrame
    inner: DataFrame
    rings: DataFrame


def contracted(links: DataFrame, fixed: DataFrame, ring: Semiring) -> Contracted:
    """links (auto_id, src, dst, weight; a row for each pair, no loops) without the states that have one link in and one out, other
    than those in fixed (auto_id, state).

    Each inner state points to the state before it; a round lets every pointer jump to where its target points, twice for each
    table written, so a chain of n arcs takes log2(n) / 2 of them, and all chains of all automata advance together."""
    degree = lambda end: links.groupBy("auto_id", F.col(end).alias("state")).agg(F.count("*").alias("n")).filter("n = 1").select(*KEYS)
    inner = settled(degree("dst").join(degree("src"), KEYS).join(fixed.select(*KEYS), KEYS, "left_anti"))
    into = links.join(inner.withColumnRenamed("state", "dst"), ["auto_id", "dst"])
    into = into.join(inner.select("auto_id", F.col("state").alias("src"), F.lit(True).alias("open")), ["auto_id", "src"], "left")
    into = into.select("auto_id", F.col("dst").alias("state"), F.col("src").alias("at"), "weight", F.coalesce("open", F.lit(False)).alias("open"))

    def jumped(t: DataFrame) -> DataFrame:
        p, q = t.alias("p"), t.alias("q")
        both = p.join(q, (F.col("p.auto_id") == F.col("q.auto_id")) & (F.col("p.at") == F.col("q.state")), "left")
        on = F.col("p.open")
        return both.select("p.auto_id", "p.state", F.when(on, F.col("q.at")).otherwise(F.col("p.at")).alias("at"), F.when(on, ring.times(F.col("q.weight"), F.col("p.weight"))).otherwise(F.col("p.weight")).alias("weight"), F.when(on, F.col("q.open")).otherwise(F.lit(False)).alias("open"))

    table = Replaced(into, F.col("open"))
    while table.n:
        left = table.n
        if table.put(jumped(jumped(table.rows))) == left:  # a chain's pointers come to rest, a ring's never do
            break
    ended = table.rows.filter(~F.col("open")).drop("open")
    out = links.join(inner.withColumnRenamed("state", "dst"), ["auto_id", "dst"], "left_anti").join(ended.select("auto_id", F.col("state").alias("src"), "at", F.col("weight").alias("way")), ["auto_id", "src"], "left")
    out = out.select("auto_id", F.coalesce("at", "src").alias("src"), "dst", F.when(F.col("at").isNull(), F.col("weight")).otherwise(ring.times(F.col("way"), F.col("weight"))).alias("weight"))
    return Contracted(laid_out(ring.sum(out, ["auto_id", "src", "dst"]), "auto_id", "src"), ended, table.rows.filter("open").select(*KEYS))
