"""Weight pushing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from arcloom.plans.iterate import settled
from arcloom.sources.automaton import ARCS, STATES, Automaton

from .distance import Distances, all_path_distances
from .project import reverse


def push_weights(auto: Automaton, distances: Distances = all_path_distances) -> Automaton:
    """Weights moved towards the start: what leaves a state, arcs and final weight together, sums to one. States that reach no
    final state go. The ring must be commutative and divisible."""
    ring = auto.ring
    rest = settled(distances(reverse(auto)).filter(~ring.is_zero(F.col("weight"))))
    at = lambda name: rest.select("auto_id", F.col("state").alias(name), F.col("weight").alias(f"{name}_rest"))
    arcs = auto.arcs.join(at("src"), ["auto_id", "src"]).join(at("dst"), ["auto_id", "dst"])
    arcs = arcs.withColumn("weight", ring.divide(F.col("src_rest"), ring.times(F.col("weight"), F.col("dst_rest"))))
    initial = auto.initial.join(at("state"), ["auto_id", "state"]).withColumn("weight", ring.times(F.col("weight"), F.col("state_rest")))
    final = auto.final.join(at("state"), ["auto_id", "state"]).withColumn("weight", ring.divide(F.col("state_rest"), F.col("weight")))
    return replace(auto, arcs=arcs.select(*ARCS), initial=initial.select(*STATES), final=final.select(*STATES))
