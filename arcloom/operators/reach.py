"""Accessible states and arcs, trimming, and the test for cycles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import BOOLEAN
from arcloom.plans.iterate import PATIENCE, Growing, Replaced, Steps, counted, laid_out, settled, together
from arcloom.sources.automaton import ARCS, STATES, Automaton

from .contract import contracted


def _spread(links: DataFrame, start: DataFrame, limit: int, what: str | None = None) -> DataFrame | None:
    """(auto_id, state) that links lead to from start; None if limit steps don't reach them all, or an error that names what."""
    front, fresh = counted(start)
    seen, done = Growing(front), 0
    while fresh:
        done += 1
        if done > limit and what:
            raise RuntimeError(f"{what} took more than {limit} steps")
        if done > limit:
            return None
        after = front.alias("f").join(links.alias("a"), (F.col("f.auto_id") == F.col("a.auto_id")) & (F.col("f.state") == F.col("a.src")))
        after = after.select(F.col("a.auto_id").alias("auto_id"), F.col("a.dst").alias("state")).distinct()
        front, fresh = counted(after.join(seen.all(), ["auto_id", "state"], "left_anti"))
        seen.add(front)
    return seen.all()


def _linked(arcs: DataFrame) -> DataFrame:
    """(auto_id, src, dst, weight): whether there is an arc, without loops."""
    return arcs.select("auto_id", "src", "dst").filter("src <> dst").distinct().withColumn("weight", F.lit(True))


def accessible_states(auto: Automaton, max_steps: int = 10_000) -> DataFrame:
    """(auto_id, state), each state once: breadth first from the initial states, all automata of the batch at once. A search that
    isn't done after PATIENCE steps starts again on the graph without its unary chains, whose inner states are then those of
    chains whose beginning was reached."""
    links = laid_out(_linked(auto.arcs), "auto_id", "src")
    start = settled(auto.initial.select("auto_id", "state").distinct())
    found = _spread(links, start, min(PATIENCE, max_steps))
    if found is None:
        short = contracted(links, start, BOOLEAN)
        heads = settled(_spread(short.links, start, max_steps, "reachability"))
        inner = short.inner.select("auto_id", "state", "at").join(heads.withColumnRenamed("state", "at"), ["auto_id", "at"], "left_semi")
        found = heads.unionByName(inner.select("auto_id", "state"))
    return found


def accessible_arcs(auto: Automaton) -> DataFrame:
    """The arcs whose source is accessible; all arcs where arcs off all paths belong to the value."""
    if not auto.reachable_only:
        return auto.arcs.select(*ARCS)
    states = accessible_states(auto).withColumnRenamed("state", "src")
    return auto.arcs.join(states, ["auto_id", "src"], "left_semi").select(*ARCS)


def restricted(auto: Automaton, states: DataFrame) -> Automaton:
    """The part of auto on states (auto_id, state)."""
    arcs = auto.arcs
    for end in ("src", "dst"):
        arcs = arcs.join(states.withColumnRenamed("state", end), ["auto_id", end], "left_semi")
    ends = [x.join(states, ["auto_id", "state"], "left_semi").select(*STATES) for x in (auto.initial, auto.final)]
    return replace(auto, arcs=arcs.select(*ARCS), initial=ends[0], final=ends[1])


def trim(auto: Automaton) -> Automaton:
    """Only states on a path from an initial to a final state."""
    from .project import reverse

    states = accessible_states(auto).join(accessible_states(reverse(auto)), ["auto_id", "state"], "left_semi")
    return restricted(auto, settled(states))


def is_cyclic(auto: Automaton, max_steps: int = 10_000) -> DataFrame:
    """(auto_id, cyclic): whether accessible arcs other than self-loops form a cycle.

    Arcs that no arc leads to, or from, are peeled off, and every PATIENCE rounds unary chains are shortened, so chains and trees
    take a logarithm of their depth. A cycle is left over, or shortens to a loop, or to a ring that nothing leads to. Whether states are
    accessible is looked at only in automata with a cycle somewhere."""
    arcs = settled(_linked(auto.arcs))
    some = settled(_with_cycles(arcs, auto.initial, max_steps))
    if not some.isEmpty():
        own = replace(auto, arcs=auto.arcs.join(some, "auto_id", "left_semi").select(*ARCS), initial=auto.initial.join(some, "auto_id", "left_semi").select(*STATES))
        states = settled(accessible_states(own, max_steps)).withColumnRenamed("state", "src")
        some = _with_cycles(arcs.join(some, "auto_id", "left_semi").join(states, ["auto_id", "src"], "left_semi"), auto.initial, max_steps)
    found = some.withColumn("cyclic", F.lit(True))
    return auto.initial.select("auto_id").distinct().join(found, "auto_id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def _with_cycles(links: DataFrame, states: DataFrame, max_steps: int) -> DataFrame:
    """(auto_id) of the automata with a cycle of links (auto_id, src, dst, weight; no loops). states gives the states' type."""
    arcs = Replaced(links.select("auto_id", "src", "dst", "weight"))
    steps, found = Steps(max_steps, "the cycle test"), []
    while arcs.n:
        steps.next()
        if steps.done % PATIENCE == 0:
            short = contracted(arcs.rows, states.select("auto_id", "state").limit(0), BOOLEAN)
            found.append(settled(short.links.filter("src = dst").select("auto_id").unionByName(short.rings.select("auto_id")).distinct()))
            arcs.put(short.links.filter("src <> dst"))
        size = arcs.n
        entered = arcs.rows.select("auto_id", F.col("dst").alias("src")).distinct()
        gone_on = arcs.rows.select("auto_id", F.col("src").alias("dst")).distinct()
        if arcs.put(arcs.rows.join(entered, ["auto_id", "src"], "left_semi").join(gone_on, ["auto_id", "dst"], "left_semi")) == size:
            break
    return together([*found, arcs.rows.select("auto_id")]).distinct()
