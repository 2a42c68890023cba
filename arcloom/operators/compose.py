"""Composition under an epsilon filter, and intersection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.plans.iterate import PATIENCE, Growing, Steps, counted, settled, together
from arcloom.sources.automaton import ARCS, STATES, Automaton

from .project import as_transducer, output_projection

NO_EPS, LEFT_EPS, RIGHT_EPS = 0, 1, 2

#: States of a shared side, with the filter's status, up to which a long chain is composed by doubling.
MOST_BESIDE = 64

Weigh = Callable[[Column, Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class StateComposer:
    """How two states and the filter's status make one state, and how they are read from it."""

    pack: Callable[[Column, Column, Column], Column]
    parts: Callable[[Column], tuple[Column, Column, Column]]


#: States of any type, as structs (l, r, e).
STRUCTS = StateComposer(lambda l, r, e: F.struct(l.alias("l"), r.alias("r"), e.cast("byte").alias("e")), lambda s: (s["l"], s["r"], s["e"]))


def dense_composer(left_size: int) -> StateComposer:
    """For dense automata (states 0, 1, ..., of which the left side has left_size): numbers e + 3 * (l + left_size * r)."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return StateComposer(
        lambda l, r, e: (e + 3 * (l + left_size * r)).cast("long"),
        lambda s: (div(s, 3) % left_size, div(s, 3 * left_size), (s % 3).cast("byte")),
    )


def doubled(front: DataFrame, arcs: DataFrame) -> DataFrame:
    """(auto_id, state) that arcs lead to from front, front included: round k knows the pairs that 2**k arcs join."""
    key = ["auto_id", "state"]
    seen, jump = Growing(front), settled(arcs.select("auto_id", "src", "dst").distinct())
    while True:
        after = seen.all().join(jump.withColumnRenamed("src", "state"), key).select("auto_id", F.col("dst").alias("state")).distinct()
        fresh, n = counted(after.join(seen.all(), key, "left_anti"))
        if not n:
            return seen.all()
        seen.add(fresh)
        later = jump.select("auto_id", F.col("src").alias("dst"), F.col("dst").alias("to"))
        jump = settled(jump.join(later, ["auto_id", "dst"]).select("auto_id", "src", F.col("to").alias("dst")).distinct())


def explored(
    start: DataFrame, grown: Callable[[DataFrame], DataFrame], max_steps: int, what: str, beyond: Callable[[DataFrame], DataFrame | None] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The states (auto_id, state) that are reached from start, and their arcs, which grown gives for each step's new states; None
    for the arcs where there is no start. beyond is asked once, after PATIENCE steps, for a table with all states that the front may still
    lead to (None: not known); what of these is accessible is then found by doubling, in a logarithm of the steps."""
    front, fresh = counted(start.select("auto_id", "state").distinct())
    seen, made, steps = Growing(front), None, Steps(max_steps, what)
    while fresh:
        steps.next()
        states = beyond(front) if beyond is not None and steps.done == PATIENCE else None
        if states is not None:
            arcs = settled(grown(states))
            reached = settled(doubled(front, arcs))
            made.add(settled(arcs.join(reached.withColumnRenamed("state", "src"), ["auto_id", "src"], "left_semi").select(*arcs.columns)))
            seen.add(settled(reached.join(seen.all(), ["auto_id", "state"], "left_anti")))
            break
        arcs = settled(grown(front))
        if made is None:
            made = Growing(arcs)
        else:
            made.add(arcs)
        after = arcs.select("auto_id", F.col("dst").alias("state")).distinct()
        front, fresh = counted(after.join(seen.all(), ["auto_id", "state"], "left_anti"))
        seen.add(front)
    return seen.all(), None if made is None else made.all()


def compose(left: Automaton, right: Automaton, weigh: Weigh | None = None, max_steps: int = 10_000, composer: StateComposer = STRUCTS) -> Automaton:
    """left's outputs joined with right's inputs; only the accessible part is made.

    A state is composer's form of (l, r, e). e tells which side has moved alone on epsilon last: while left does, right may not, and the other
    way round, and both move together only from neither; so each pair of paths is counted once. weigh(in, mid, out, w1, w2) gives
    an arc's weight, the ring's product by default; a side that stays put weighs one and has epsilon for mid and its label.
    A shared side has one automaton for all auto_ids of the other. Each step joins the frontier with both sides' arcs, on
    state, and on label where both move. Chains on the left that go on after PATIENCE steps are composed with a small shared right side
    all at once: their states stand against all of the right side's, and doubling tells which of these pairs are accessible.
    """
    ring, eps = left.ring, left.eps
    _state = lambda l, r, e: composer.pack(l, r, F.lit(e))
    of_state = lambda c: [p.alias(n) for n, p in zip("lre", composer.parts(F.col(c)), strict=True)]
    weigh = weigh or (lambda i, m, o, a, b: ring.times(a, b))
    one = ring.lit(ring.one)
    own = right if left.shared and not right.shared else left
    a_arcs = settled(left.arcs.select(F.col("auto_id").alias("a_id"), F.col("src").alias("a_src"), F.col("dst").alias("a_dst"), F.col("ilabel").alias("a_in"), F.col("olabel").alias("a_out"), F.col("weight").alias("a_w")))
    b_arcs = settled(right.arcs.select(F.col("auto_id").alias("b_id"), F.col("src").alias("b_src"), F.col("dst").alias("b_dst"), F.col("ilabel").alias("b_in"), F.col("olabel").alias("b_out"), F.col("weight").alias("b_w")))

    def same(name: str, auto: Automaton) -> Column:
        return F.lit(True) if auto.shared and auto is not own else F.col("f.auto_id") == F.col(name)

    def ends(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        joined = a.join(b, F.lit(True) if left.shared or right.shared else F.col("a.auto_id") == F.col("b.auto_id"))
        keep = "b.auto_id" if own is right else "a.auto_id"
        return joined.select(F.col(keep).alias("auto_id"), F.col("a.state").alias("l"), F.col("b.state").alias("r"), F.col("a.weight").alias("wa"), F.col("b.weight").alias("wb"))

    start = ends(left.initial, right.initial).select("auto_id", _state(F.col("l"), F.col("r"), NO_EPS).alias("state"), ring.times(F.col("wa"), F.col("wb")).alias("weight"))
    start = settled(start.filter(~ring.is_zero(F.col("weight"))))

    def grown(front: DataFrame) -> DataFrame:
        f = front.select("auto_id", "state", *of_state("state")).alias("f")
        fa = f.join(a_arcs, same("a_id", left) & (F.col("f.l") == F.col("a_src")))
        on = (F.col("f.r") == F.col("b_src")) & same("b_id", right)
        both = fa.join(b_arcs, on & (F.col("a_out") == F.col("b_in")) & ((F.col("a_out") != eps) | (F.col("f.e") == NO_EPS)))
        pairs = both.select("f.auto_id", F.col("f.state").alias("src"), _state(F.col("a_dst"), F.col("b_dst"), NO_EPS).alias("dst"), F.col("a_in").alias("ilabel"), F.col("b_out").alias("olabel"), weigh(F.col("a_in"), F.col("a_out"), F.col("b_out"), F.col("a_w"), F.col("b_w")).alias("weight"))
        alone = fa.filter((F.col("a_out") == eps) & (F.col("f.e") != RIGHT_EPS))
        alone = alone.select("f.auto_id", F.col("f.state").alias("src"), _state(F.col("a_dst"), F.col("f.r"), LEFT_EPS).alias("dst"), F.col("a_in").alias("ilabel"), eps.alias("olabel"), weigh(F.col("a_in"), eps, eps, F.col("a_w"), one).alias("weight"))
        other = f.join(b_arcs, on & (F.col("b_in") == eps)).filter(F.col("f.e") != LEFT_EPS)
        other = other.select("f.auto_id", F.col("f.state").alias("src"), _state(F.col("f.l"), F.col("b_dst"), RIGHT_EPS).alias("dst"), eps.alias("ilabel"), F.col("b_out").alias("olabel"), weigh(eps, eps, F.col("b_out"), one, F.col("b_w")).alias("weight"))
        return together([pairs, alone, other]).select(*ARCS)

    def beyond(front: DataFrame) -> DataFrame | None:
        """Each state of the front's automata with each of right's, where the former are chains and every move but a last one takes an arc of
        theirs, so no more pairs are joined by so many arcs than right has pairs of states."""
        if left.shared or not right.shared:
            return None
        ending = b_arcs.filter(F.col("b_in") == eps).select(F.col("b_dst").alias("r"))
        if not ending.join(b_arcs.select(F.col("b_src").alias("r")), "r", "left_semi").isEmpty():
            return None
        own_arcs = settled(a_arcs.join(front.select(F.col("auto_id").alias("a_id")).distinct(), "a_id", "left_semi"))
        if not own_arcs.groupBy("a_id", "a_src").count().filter("count > 1").isEmpty():
            return None
        right_states = right.initial.select(F.col("state").alias("r")).unionByName(b_arcs.select(F.col("b_dst").alias("r"))).distinct()
        status = [NO_EPS, RIGHT_EPS] if own_arcs.filter(F.col("a_out") == eps).isEmpty() else [NO_EPS, LEFT_EPS, RIGHT_EPS]
        beside = right_states.select("r", F.explode(F.array(*map(F.lit, status))).alias("e"))
        beside = settled(beside.filter(F.col("e") != RIGHT_EPS).unionByName(beside.filter(F.col("e") == RIGHT_EPS).join(ending.distinct(), "r", "left_semi")))
        if beside.count() > MOST_BESIDE:
            return None
        places = together([own_arcs.select(F.col("a_id").alias("auto_id"), F.col(c).alias("l")) for c in ("a_src", "a_dst")]).distinct()
        every = places.crossJoin(F.broadcast(beside))  # MOST_BESIDE rows at most
        return every.select("auto_id", composer.pack(F.col("l"), F.col("r"), F.col("e")).alias("state")).unionByName(front.select("auto_id", "state")).distinct()

    seen, made = explored(start, grown, max_steps, "a composition", beyond)
    states = seen.select("auto_id", "state", *of_state("state")).alias("f")
    fa = left.final.select(F.col("auto_id").alias("a_id"), F.col("state").alias("a_state"), F.col("weight").alias("a_w"))
    fb = right.final.select(F.col("auto_id").alias("b_id"), F.col("state").alias("b_state"), F.col("weight").alias("b_w"))
    done = states.join(fa, same("a_id", left) & (F.col("f.l") == F.col("a_state"))).join(fb, same("b_id", right) & (F.col("f.r") == F.col("b_state")))
    final = done.select("f.auto_id", "f.state", ring.times(F.col("a_w"), F.col("b_w")).alias("weight"))
    if made is None:  # no initial states: no arcs either
        none = start.select("auto_id", F.col("state").alias("src"), F.col("state").alias("dst"))
        labels = [F.lit(None).cast(a.schema[c].dataType).alias(c) for a, c in ((left.arcs, "ilabel"), (right.arcs, "olabel"))]
        made = none.select("*", *labels, one.alias("weight"))
    return replace(left, arcs=made, initial=start.select(*STATES), final=final.filter(~ring.is_zero(F.col("weight"))).select(*STATES), shared=left.shared and right.shared, reachable_only=True)


def intersect(left: Automaton, right: Automaton, max_steps: int = 10_000) -> Automaton:
    """Strings that both accept, weights multiplied."""
    return output_projection(compose(as_transducer(left), as_transducer(right), max_steps=max_steps))
