"""Arc filters and label matchers: predicates that reach the scan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.sources.automaton import ARCS, Automaton


def filter_arcs(auto: Automaton, keep: Column) -> Automaton:
    """Arcs that satisfy keep. Arcs and states that become unreachable still belong to the result."""
    return replace(auto, arcs=auto.arcs.filter(keep).select(*ARCS), reachable_only=False)


def sigma(state: object) -> Column:
    """Any arc of a state."""
    return F.col("src") == F.lit(state)


def label(state: object, value: object) -> Column:
    return sigma(state) & (F.col("ilabel") == F.lit(value)) & (F.col("olabel") == F.lit(value))


def pair(state: object, i: object, o: object) -> Column:
    return sigma(state) & (F.col("ilabel") == F.lit(i)) & (F.col("olabel") == F.lit(o))


def input_label(state: object, value: object) -> Column:
    """The input label given, any output."""
    return sigma(state) & (F.col("ilabel") == F.lit(value))


def output_label(state: object, value: object) -> Column:
    """Any input, the output label given."""
    return sigma(state) & (F.col("olabel") == F.lit(value))


def edges_matching(auto: Automaton, match: Column) -> DataFrame:
    return auto.arcs.filter(match)


def nonzero(auto: Automaton, near: bool = False) -> Automaton:
    """Without arcs of zero weight; near takes weights close to zero for zero."""
    ring, w = auto.ring, auto.ring.lit(auto.ring.zero)
    drop = ring.close(F.col("weight"), w) if near else ring.is_zero(F.col("weight"))
    return replace(auto, arcs=auto.arcs.filter(~drop))
