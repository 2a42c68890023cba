"""Union: a disjoint sum whose states tell which side they come from."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcloom.sources.automaton import ARCS, STATES, Automaton


def union(left: Automaton, right: Automaton) -> Automaton:
    """Strings that both accept weigh the sum. States are structs (side, s); states of different types are compared as text."""
    same = left.arcs.schema["src"].dataType == right.arcs.schema["src"].dataType

    def tagged(auto: Automaton, side: int) -> Automaton:
        def tag(name: str) -> Column:
            own = F.col(name) if same else F.to_json(F.struct(F.col(name).alias("s")))
            return F.struct(F.lit(side).cast("byte").alias("side"), own.alias("s")).alias(name)

        arcs = auto.arcs.select("auto_id", tag("src"), tag("dst"), "ilabel", "olabel", "weight")
        ends = [x.select("auto_id", tag("state"), "weight") for x in (auto.initial, auto.final)]
        return replace(auto, arcs=arcs, initial=ends[0], final=ends[1])

    a, b = tagged(left, 0), tagged(right, 1)
    return replace(left, arcs=a.arcs.unionByName(b.arcs).select(*ARCS), initial=a.initial.unionByName(b.initial).select(*STATES), final=a.final.unionByName(b.final).select(*STATES), reachable_only=True)


def batch_union(auto: Automaton, auto_id: str = "union") -> Automaton:
    """One automaton for the union of all automata of a batch: auto_id becomes a part of the state."""

    def tag(name: str) -> Column:
        return F.struct(F.col("auto_id").alias("of"), F.col(name).alias("s")).alias(name)

    own = F.lit(auto_id).alias("auto_id")
    ends = [x.select(own, tag("state"), "weight") for x in (auto.initial, auto.final)]
    return replace(auto, arcs=auto.arcs.select(own, tag("src"), tag("dst"), "ilabel", "olabel", "weight"), initial=ends[0], final=ends[1])
