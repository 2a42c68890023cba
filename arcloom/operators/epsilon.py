"""Epsilon removal."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from arcloom.plans.iterate import settled
from arcloom.sources.automaton import ARCS, STATES, Automaton

from .distance import all_pairs, all_path_distances
from .reach import accessible_states


def remove_epsilons(auto: Automaton) -> Automaton:
    """No arc has two empty labels any more; every string keeps its weight.

    The closure over epsilon arcs is multiplied into arcs and final weights; initial weights stay. For final weights it is a distance
    along epsilon arcs turned around, which makes no pairs; for arcs, pairs are made only of states that lead over epsilon arcs to one
    with other arcs."""
    ring, eps = auto.ring, auto.eps
    empty = (F.col("ilabel") == eps) & (F.col("olabel") == eps)
    quiet, loud = settled(auto.arcs.filter(empty)), auto.arcs.filter(~empty)
    turned = quiet.select("auto_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "ilabel", "olabel", "weight")
    final = all_path_distances(replace(auto, arcs=turned, initial=auto.final, final=auto.initial))
    goals = settled(quiet.select("auto_id", F.col("dst").alias("state")).distinct().join(loud.select("auto_id", F.col("src").alias("state")), ["auto_id", "state"], "left_semi"))
    arcs = loud
    if not goals.isEmpty():
        useful = settled(accessible_states(replace(auto, arcs=turned, initial=goals.withColumn("weight", ring.lit(ring.one)))))
        ways = quiet.join(useful.withColumnRenamed("state", "dst"), ["auto_id", "dst"], "left_semi")
        near = all_pairs(replace(auto, arcs=ways.select(*ARCS)), states=useful).select("auto_id", F.col("src").alias("p"), F.col("dst").alias("src"), F.col("weight").alias("way"))
        near = near.join(goals.withColumnRenamed("state", "src"), ["auto_id", "src"], "left_semi")
        both = loud.join(settled(near), ["auto_id", "src"], "left")
        weight = F.when(F.col("way").isNull(), F.col("weight")).otherwise(ring.times(F.col("way"), F.col("weight")))
        arcs = both.select("auto_id", F.coalesce("p", "src").alias("src"), "dst", "ilabel", "olabel", weight.alias("weight"))
    arcs = ring.sum(arcs, ["auto_id", "src", "dst", "ilabel", "olabel"])
    live = ~ring.is_zero(F.col("weight"))
    return replace(auto, arcs=arcs.filter(live).select(*ARCS), final=final.filter(live).select(*STATES), reachable_only=True)
