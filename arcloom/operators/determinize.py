"""Subset construction, plain and weighted."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from arcloom.plans.iterate import Growing, Steps, counted, laid_out, settled
from arcloom.sources.automaton import ARCS, STATES, Automaton

DIGITS = 10


def determinize(auto: Automaton, max_steps: int = 10_000, max_states: int = 10_000_000) -> Automaton:
    """At most one arc for each state and label. Epsilon is a label like others: remove it first.

    A state is an array of (state, residual), sorted; in the boolean ring of states only. Residuals are rounded to DIGITS digits
    in the state's name and kept whole in the computation. The initial subset weighs one and holds the initial weights as
    residuals. The ring must be commutative and divisible; without the twins property the weighted construction does not
    end, so more than max_states states raise an error.
    """
    ring, plain = auto.ring, auto.ring.name == "boolean"
    arcs = laid_out(auto.arcs.select("auto_id", F.col("src").alias("s"), "dst", "ilabel", "olabel", "weight").filter(~ring.is_zero(F.col("weight"))), "auto_id", "s")

    def named(df, group: list[str]):
        pair = F.struct(F.col("dst").alias("s"), F.col("rest").alias("w"))
        grouped = df.groupBy(*group).agg(F.array_sort(F.collect_list(pair)).alias("full"))
        return grouped.withColumn("name", F.transform("full", lambda x: x["s"]) if plain else F.transform("full", lambda x: F.struct(x["s"].alias("s"), ring.rounded(x["w"], DIGITS).alias("w"))))

    start = auto.initial.filter(~ring.is_zero(F.col("weight"))).select("auto_id", F.col("state").alias("dst"), F.col("weight").alias("rest"))
    first, total = counted(named(start, ["auto_id"]).select("auto_id", "name", "full"))
    front, fresh, seen, made, steps = first, total, Growing(first), None, Steps(max_steps, "a determinization")
    while fresh:
        steps.next()
        parts = front.select("auto_id", "name", F.explode("full").alias("x")).select("auto_id", "name", F.col("x.s").alias("s"), F.col("x.w").alias("v"))
        moved = parts.join(arcs, ["auto_id", "s"]).withColumn("weight", ring.times(F.col("v"), F.col("weight")))
        keys = ["auto_id", "name", "ilabel", "olabel"]
        parts = settled(ring.sum(moved, [*keys, "dst"]))
        whole = ring.sum(parts, keys).withColumnRenamed("weight", "total")
        rest = parts.join(whole, keys).withColumn("rest", ring.divide(F.col("total"), F.col("weight")))
        out = named(rest.withColumnRenamed("name", "src"), ["auto_id", "src", "ilabel", "olabel", "total"])
        out = settled(out.withColumnRenamed("name", "to"))
        arms = out.select("auto_id", "src", F.col("to").alias("dst"), "ilabel", "olabel", F.col("total").alias("weight"))
        if made is None:
            made = Growing(arms)
        else:
            made.add(arms)
        after = out.select("auto_id", F.col("to").alias("name"), "full").dropDuplicates(["auto_id", "name"])
        front, fresh = counted(after.join(seen.all().select("auto_id", "name"), ["auto_id", "name"], "left_anti"))
        total += fresh
        if total > max_states:
            raise RuntimeError(f"determinization made more than {max_states} states")
        seen.add(front)
    if made is None:  # no initial states: no arcs either
        labels = [F.lit(None).cast(auto.arcs.schema[c].dataType).alias(c) for c in ("ilabel", "olabel", "weight")]
        made = Growing(first.select("auto_id", F.col("name").alias("src"), F.col("name").alias("dst"), *labels))
    parts = seen.all().select("auto_id", F.col("name"), F.explode("full").alias("x")).select("auto_id", "name", F.col("x.s").alias("state"), F.col("x.w").alias("v"))
    final = parts.join(auto.final, ["auto_id", "state"])
    final = ring.sum(final.select("auto_id", F.col("name").alias("state"), ring.times(F.col("v"), F.col("weight")).alias("weight")), ["auto_id", "state"])
    initial = first.select("auto_id", F.col("name").alias("state"), ring.lit(ring.one).alias("weight"))
    return replace(auto, arcs=made.all().select(*ARCS), initial=initial, final=final.filter(~ring.is_zero(F.col("weight"))).select(*STATES), reachable_only=True)
