"""Composition with automata whose arcs are made on demand: column expressions give the arcs that a state and a label ask for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring
from arcloom.plans.iterate import settled, together
from arcloom.sources.automaton import ARCS, EPSILON, STATES, Alphabet, Automaton

from .compose import LEFT_EPS, NO_EPS, RIGHT_EPS, STRUCTS, explored


@dataclass(frozen=True)
class Generated:
    """An automaton without a table of arcs, for alphabets that are too large to list or not known.

    initial: auto_id, state, weight; shared, as in Automaton, says that its states start every automaton of the other side, whatever their
    auto_id. reading(state, label) gives an array of structs (dst, olabel, weight): the arcs from state that read label, which is not
    empty. silent(state) gives those that read nothing, ending(state) the final weight, the ring's zero where state isn't final. All
    are expressions over columns, so arcs are made inside the superstep's own plan and only for labels that the other side writes.
    """

    initial: DataFrame
    reading: Callable[[Column, Column], Column]
    silent: Callable[[Column], Column]
    ending: Callable[[Column], Column]
    ring: Semiring
    epsilon: object = EPSILON
    shared: bool = True

    def arcs_for(self, state: Column, label: Column) -> Column:
        return F.when(label == Alphabet(self.epsilon).lit(), self.silent(state)).otherwise(self.reading(state, label))


def arcs_on_demand(made: Generated, asked: DataFrame) -> DataFrame:
    """The arcs that asked's rows (auto_id, state, label) ask for, as rows like an automaton's; the empty label asks for silent ones.

    A row that asks for nothing there is gives none, repeated rows give repeated arcs, a null state or label gives none."""
    rows = asked.filter(F.col("state").isNotNull() & F.col("label").isNotNull())
    arcs = rows.select("auto_id", F.col("state").alias("src"), F.col("label").alias("ilabel"), F.explode(made.arcs_for(F.col("state"), F.col("label"))).alias("arc"))
    return arcs.select("auto_id", "src", "arc.dst", "ilabel", "arc.olabel", "arc.weight").filter(~made.ring.is_zero(F.col("weight"))).select(*ARCS)


def compose_generated(left: Automaton, made: Generated, max_steps: int = 10_000) -> Automaton:
    """left's outputs read by made: what compose gives for made's arcs listed over all labels that left writes.

    States are structs (l, r, e) under the same epsilon filter. A superstep joins its frontier with left's arcs alone; made's arcs come from
    its expressions. Work and rows grow with the pairs of states reached, never with the square of the alphabet."""
    ring, eps = left.ring, left.eps
    one = ring.lit(ring.one)
    state = lambda l, r, e: STRUCTS.pack(l, r, F.lit(e))
    parts = lambda c: [p.alias(n) for n, p in zip("lre", STRUCTS.parts(F.col(c)), strict=True)]
    arcs = settled(left.arcs.select(F.col("auto_id").alias("a_id"), F.col("src").alias("a_src"), F.col("dst").alias("a_dst"), F.col("ilabel").alias("a_in"), F.col("olabel").alias("a_out"), F.col("weight").alias("a_w")))

    begun = left.initial.alias("a").join(made.initial.alias("b"), F.lit(True) if made.shared else F.col("a.auto_id") == F.col("b.auto_id"))
    start = begun.select("a.auto_id", state(F.col("a.state"), F.col("b.state"), NO_EPS).alias("state"), ring.times(F.col("a.weight"), F.col("b.weight")).alias("weight"))
    start = settled(start.filter(~ring.is_zero(F.col("weight"))))

    def grown(front: DataFrame) -> DataFrame:
        f = front.select("auto_id", "state", *parts("state"))
        fa = f.join(arcs, (F.col("auto_id") == F.col("a_id")) & (F.col("l") == F.col("a_src")))
        both = fa.filter((F.col("a_out") != eps) | (F.col("e") == NO_EPS)).withColumn("arc", F.explode(made.arcs_for(F.col("r"), F.col("a_out"))))
        both = both.select("auto_id", F.col("state").alias("src"), state(F.col("a_dst"), F.col("arc.dst"), NO_EPS).alias("dst"), F.col("a_in").alias("ilabel"), F.col("arc.olabel").alias("olabel"), ring.times(F.col("a_w"), F.col("arc.weight")).alias("weight"))
        alone = fa.filter((F.col("a_out") == eps) & (F.col("e") != RIGHT_EPS))
        alone = alone.select("auto_id", F.col("state").alias("src"), state(F.col("a_dst"), F.col("r"), LEFT_EPS).alias("dst"), F.col("a_in").alias("ilabel"), eps.alias("olabel"), F.col("a_w").alias("weight"))
        other = f.filter(F.col("e") != LEFT_EPS).withColumn("arc", F.explode(made.silent(F.col("r"))))
        other = other.select("auto_id", F.col("state").alias("src"), state(F.col("l"), F.col("arc.dst"), RIGHT_EPS).alias("dst"), eps.alias("ilabel"), F.col("arc.olabel").alias("olabel"), F.col("arc.weight").alias("weight"))
        return together([both, alone, other]).filter(~ring.is_zero(F.col("weight"))).select(*ARCS)

    seen, found = explored(start, grown, max_steps, "a composition")
    if found is None:  # no initial states: no arcs either
        found = grown(start.select("auto_id", "state"))
    ends = seen.select("auto_id", "state", *parts("state")).join(left.final.select("auto_id", F.col("state").alias("l"), F.col("weight").alias("a_w")), ["auto_id", "l"])
    final = ends.select("auto_id", "state", ring.times(F.col("a_w"), made.ending(F.col("r"))).alias("weight")).filter(~ring.is_zero(F.col("weight")))
    return Automaton(found, start.select(*STATES), final.select(*STATES), ring, left.epsilon)
