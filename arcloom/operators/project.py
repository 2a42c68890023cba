"""Projections, inversion, reversal and relabelling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.plans.iterate import settled
from arcloom.sources.automaton import ARCS, STATES, Automaton


def as_transducer(auto: Automaton) -> Automaton:
    return replace(auto, arcs=auto.arcs.withColumn("olabel", F.col("ilabel")), reachable_only=True)


def swap_labels(auto: Automaton) -> Automaton:
    arcs = auto.arcs.select("auto_id", "src", "dst", F.col("olabel").alias("ilabel"), F.col("ilabel").alias("olabel"), "weight")
    return replace(auto, arcs=arcs, reachable_only=True)


def input_projection(auto: Automaton) -> Automaton:
    return replace(auto, arcs=auto.arcs.withColumn("olabel", F.col("ilabel")), reachable_only=True)


def output_projection(auto: Automaton) -> Automaton:
    return replace(auto, arcs=auto.arcs.withColumn("ilabel", F.col("olabel")), reachable_only=True)


def reverse(auto: Automaton) -> Automaton:
    """Arcs turned around; every state of non-zero final weight becomes initial, with or without arcs into it."""
    arcs = auto.arcs.select("auto_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "ilabel", "olabel", "weight")
    initial = auto.final.filter(~auto.ring.is_zero(F.col("weight")))
    return replace(auto, arcs=arcs, initial=initial.select(*STATES), final=auto.initial.select(*STATES), reachable_only=True)


def numbered(states: DataFrame) -> DataFrame:
    """(auto_id, state, n): states numbered from 0 in each automaton, in their order. Sorted by ranges, so one automaton's states
    may be in many partitions; only the partitions' sizes are collected."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = states.repartitionByRange("auto_id", "state").sortWithinPartitions("auto_id", "state")
    ranged = settled(ranged.select("auto_id", "state", F.spark_partition_id().alias("part"), within.alias("k")))
    before, total = [], 0
    for part, size in sorted(ranged.groupBy("part").count().collect()):
        before.append((part, total))
        total += size
    offsets = states.sparkSession.createDataFrame(before, "part int, before long")
    placed = ranged.join(F.broadcast(offsets), "part").select("auto_id", "state", (F.col("before") + F.col("k")).alias("at"))  # a row for each partition
    first = placed.groupBy("auto_id").agg(F.min("at").alias("first"))
    return placed.join(first, "auto_id").select("auto_id", "state", (F.col("at") - F.col("first")).alias("n"))


def relabel(auto: Automaton) -> Automaton:
    """States as numbers from 0 in each automaton, in the order of the old states; all states get one, with or without arcs."""
    numbers = numbered(auto.arc_states())
    at = lambda name: numbers.select("auto_id", F.col("state").alias(name), F.col("n").alias(f"{name}_n"))
    arcs = auto.arcs.join(at("src"), ["auto_id", "src"]).join(at("dst"), ["auto_id", "dst"])
    arcs = arcs.select("auto_id", F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), "ilabel", "olabel", "weight")
    ends = [x.join(numbers, ["auto_id", "state"]).select("auto_id", F.col("n").alias("state"), "weight") for x in (auto.initial, auto.final)]
    return replace(auto, arcs=arcs.select(*ARCS), initial=ends[0], final=ends[1])
