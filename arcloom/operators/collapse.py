"""Sums over parallel arcs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from arcloom.sources.automaton import ARCS, Automaton


def collapse_edges(auto: Automaton) -> Automaton:
    """One arc for each source, target and label."""
    return replace(auto, arcs=auto.ring.sum(auto.arcs, ["auto_id", "src", "dst", "ilabel", "olabel"]).select(*ARCS))


def neighbour_distances(auto: Automaton) -> DataFrame:
    """(auto_id, src, dst, weight), whatever the labels."""
    return auto.ring.sum(auto.arcs, ["auto_id", "src", "dst"])
