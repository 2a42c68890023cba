"""Shortest distances in any semiring: sums over all paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring
from arcloom.plans.iterate import PATIENCE, Growing, Replaced, Steps, counted, laid_out, settled, together
from arcloom.sources.automaton import Automaton

from .collapse import neighbour_distances
from .components import closed_inside, components, numbered_inside, placed_inside
from .contract import contracted

#: Gives (auto_id, state, weight), the sums over all paths from initial states: single_source, by_all_pairs, by_residuals, or
#: all_path_distances, which chooses.
Distances = Callable[[Automaton], DataFrame]
KEYS = ["auto_id", "state"]


def _folded(ring: Semiring, links: DataFrame, closed: DataFrame) -> DataFrame:
    """links with the sums closed (auto_id, src, dst, weight) before them, where their source has any."""
    before = closed.select("auto_id", F.col("src").alias("from"), F.col("dst").alias("src"), F.col("weight").alias("way"))
    both = links.join(before, ["auto_id", "src"], "left")
    weight = F.when(F.col("way").isNull(), F.col("weight")).otherwise(ring.times(F.col("way"), F.col("weight")))
    return ring.sum(both.select("auto_id", F.coalesce("from", "src").alias("src"), "dst", weight.alias("weight")), ["auto_id", "src", "dst"])


def _carried(ring: Semiring, reached: DataFrame, closed: DataFrame) -> DataFrame:
    """reached (auto_id, state, weight), moved on by the sums in closed where its states have any."""
    after = closed.select("auto_id", F.col("src").alias("state"), F.col("dst").alias("to"), F.col("weight").alias("way"))
    both = reached.join(after, KEYS, "left")
    weight = F.when(F.col("way").isNull(), F.col("weight")).otherwise(ring.times(F.col("weight"), F.col("way")))
    return ring.sum(both.select("auto_id", F.coalesce("to", "state").alias("state"), weight.alias("weight")), KEYS)


def _loops(ring: Semiring, links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """links without loops, each with its source's loop closed before it; the closed loops; how many."""
    star, n = counted(links.filter("src = dst").select("auto_id", "src", "dst", ring.closure(F.col("weight")).alias("weight")))
    rest = links.filter("src <> dst")
    return (laid_out(_folded(ring, rest, star), "auto_id", "src") if n else rest), star, n


def _moved(ring: Semiring, front: DataFrame, links: DataFrame) -> DataFrame:
    """front (auto_id, state, weight) moved along links. Links lie in buckets by their source, so only the front is shuffled, or broadcast."""
    f, a = front.alias("f"), links.alias("a")
    after = f.join(a, (F.col("f.auto_id") == F.col("a.auto_id")) & (F.col("f.state") == F.col("a.src")))
    return after.select(F.col("a.auto_id").alias("auto_id"), F.col("a.dst").alias("state"), ring.times(F.col("f.weight"), F.col("a.weight")).alias("weight"))


def _tried(ring: Semiring, links: DataFrame, start: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    """As _sweep, if nothing moves any more after limit steps. It gives up sooner once more states have moved than there are links and
    starts, for then states are come back to. Then None, the smallest front, and what had arrived before it (None: nothing)."""
    front, size = counted(start)
    fronts, room = [(size, front)], links.count() + size
    while size:
        if len(fronts) > limit or sum(n for n, _ in fronts) > room:
            least = min(range(len(fronts)), key=lambda i: fronts[i][0])
            return None, fronts[least][1], settled(together([x for _, x in fronts[:least]])) if least else None
        front, size = counted(ring.sum(_moved(ring, front, links).filter(~ring.is_zero(F.col("weight"))), KEYS))
        fronts.append((size, front))
    return ring.sum(together([x for _, x in fronts]), KEYS), start, None


def _sweep(ring: Semiring, links: DataFrame, start: DataFrame, limit: int, what: str | None = None) -> DataFrame | None:
    """(auto_id, state, weight): the sums of all that arrives, if nothing moves any more after limit steps; else None, or an error
    that names what took them."""
    front, size = counted(start)
    arrived, done = Growing(front), 0
    while size:
        done += 1
        if done > limit and what:
            raise RuntimeError(f"{what} took more than {limit} steps")
        if done > limit:
            return None
        front, size = counted(ring.sum(_moved(ring, front, links).filter(~ring.is_zero(F.col("weight"))), KEYS))
        arrived.add(front)
    return ring.sum(arrived.all(), KEYS)


def _over_chains(ring: Semiring, links: DataFrame, start: DataFrame, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What solve finds on the links without their unary chains, and from that the states inside chains."""
    short = contracted(links, start, ring)
    heads = settled(solve(short.links))
    inner = short.inner.withColumnRenamed("weight", "way").join(heads.select("auto_id", F.col("state").alias("at"), "weight"), ["auto_id", "at"])
    return heads.unionByName(inner.select(*KEYS, ring.times(F.col("weight"), F.col("way")).alias("weight")))


def _started(auto: Automaton) -> tuple[DataFrame, DataFrame]:
    ring = auto.ring
    live = ~ring.is_zero(F.col("weight"))
    return laid_out(neighbour_distances(auto).filter(live), "auto_id", "src"), settled(ring.sum(auto.initial.filter(live), KEYS))


def single_source(auto: Automaton, max_steps: int = 10_000) -> DataFrame:
    """(auto_id, state, weight): the sum over all paths from initial states, self-loops as closures; without other cycles.

    Every superstep moves what arrived at a state in the last one along all arcs; the sum of all arrivals is taken once,
    at the end. Steps are as many as the longest path has arcs; after PATIENCE of them unary chains are shortened, and it is
    the longest path over states with several arcs in or out that counts."""
    ring = auto.ring
    links, start = _started(auto)
    links, star, n = _loops(ring, links)
    found = _sweep(ring, links, start, min(PATIENCE, max_steps))
    if found is None:
        found = _over_chains(ring, links, start, lambda short: _sweep(ring, short, start, max_steps, "a distance without cycles"))
    return _carried(ring, found, star) if n else found


def _through_cycles(ring: Semiring, links: DataFrame, start: DataFrame, max_steps: int) -> DataFrame:
    """Sums over all paths of any graph: all pairs inside its components only, single source between them."""
    links, star, n = _loops(ring, links)
    found = _sweep(ring, links, start, min(PATIENCE // 3, max_steps))
    if found is None:
        members = components(links, max_steps)
        sweep = lambda x: _sweep(ring, x, start, max_steps, "a distance between components")
        if members is None:
            found = _over_chains(ring, links, start, sweep)
        else:
            closed, between = _split(ring, links, members)
            found = _carried(ring, _over_chains(ring, laid_out(_folded(ring, between, closed), "auto_id", "src"), start, sweep), closed)
    return _carried(ring, found, star) if n else found


def _split(ring: Semiring, links: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closures inside components, and the links between them."""
    own = numbered_inside(members)
    placed = settled(placed_inside(links, own))
    return closed_inside(ring, placed.filter("inside"), own), placed.filter("not inside").select("auto_id", "src", "dst", "weight")


def all_pairs(auto: Automaton, states: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(auto_id, src, dst, weight): the sum over all paths between two states, the empty path included; pairs not listed are zero.

    states (default: all) get a pair with themselves. Loops and components are closed first, by elimination. What is left has no
    cycles, so path doubling over it is exact: round k knows all paths of less than 2**k links, and it ends when there are no
    longer ones. Pairs inside a component come from its closure alone, so only those between components are summed."""
    ring, keys = auto.ring, ["auto_id", "src", "dst"]
    chosen = auto.arc_states() if states is None else states

    def product(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        both = a.join(b, (F.col("a.auto_id") == F.col("b.auto_id")) & (F.col("a.dst") == F.col("b.src")))
        both = both.select(F.col("a.auto_id").alias("auto_id"), F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), ring.times(F.col("a.weight"), F.col("b.weight")).alias("weight"))
        return both.filter(~ring.is_zero(F.col("weight")))

    links, star, n = _loops(ring, settled(neighbour_distances(auto).filter(~ring.is_zero(F.col("weight")))))
    members = components(links)
    closed = None
    if members is not None:
        closed, between = _split(ring, links, members)
        links = settled(_folded(ring, between, closed))
    power = Replaced(links)
    total, steps = Replaced(links), Steps(max_rounds, "an all-pairs distance")
    while power.n:
        steps.next()
        power.put(ring.sum(product(power.rows, power.rows), keys))
        if power.n:
            total.put(ring.sum(together([total.rows, power.rows, product(power.rows, total.rows)]), keys))

    def followed(ways: DataFrame, last: DataFrame) -> DataFrame:
        after = last.select("auto_id", F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("weight").alias("way"))
        both = ways.join(after, ["auto_id", "dst"], "left")
        weight = F.when(F.col("way").isNull(), F.col("weight")).otherwise(ring.times(F.col("weight"), F.col("way")))
        return both.select("auto_id", "src", F.coalesce("to", "dst").alias("dst"), weight.alias("weight"))

    own, between = chosen, total.rows
    if closed is not None:
        own = chosen.join(members, KEYS, "left_anti")
        between = ring.sum(followed(between, closed), keys)
    parts = [own.select("auto_id", F.col("state").alias("src"), F.col("state").alias("dst"), ring.lit(ring.one).alias("weight")), between]
    if closed is not None:
        parts.append(closed if states is None else closed.join(states.select("auto_id", F.col("state").alias("src")), ["auto_id", "src"], "left_semi"))
    found = together([x.select(*keys, "weight") for x in parts])
    return followed(found, star).select(*keys, "weight") if n else found


def by_all_pairs(auto: Automaton) -> DataFrame:
    """(auto_id, state, weight) from the initial states, by the distances of all pairs; cycles or not."""
    ring = auto.ring
    pairs, start = all_pairs(auto).alias("p"), auto.initial.alias("i")
    both = start.join(pairs, (F.col("i.auto_id") == F.col("p.auto_id")) & (F.col("i.state") == F.col("p.src")))
    both = both.select(F.col("p.auto_id").alias("auto_id"), F.col("p.dst").alias("state"), ring.times(F.col("i.weight"), F.col("p.weight")).alias("weight"))
    return ring.sum(both.filter(~ring.is_zero(F.col("weight"))), ["auto_id", "state"])


def by_residuals(auto: Automaton, max_steps: int = 10_000) -> DataFrame:
    """(auto_id, state, weight) from the initial states, cycles or not, by a worklist: what has newly arrived at a state and would
    still change its sum, by more than the ring's tolerance, moves on. For sums that converge within max_steps; it needs no
    closure, and no pairs of states."""
    ring = auto.ring
    links, start = _started(auto)
    total, steps = Replaced(start.withColumn("fresh", F.col("weight")), F.col("fresh").isNotNull()), Steps(max_steps, "a distance by residuals")
    while total.n:
        steps.next()
        front = total.rows.filter("fresh is not null").select(*KEYS, F.col("fresh").alias("weight"))
        came, old = ring.sum(_moved(ring, front, links), KEYS), total.rows.drop("fresh")
        new = ring.sum(old.unionByName(came), KEYS).join(old.withColumnRenamed("weight", "old"), KEYS, "left").join(came.withColumnRenamed("weight", "came"), KEYS, "left")
        moved = F.col("old").isNull() | ~ring.close(F.col("old"), F.col("weight"))
        total.put(new.select(*KEYS, "weight", F.when(moved, F.col("came")).alias("fresh")))
    return total.rows.drop("fresh")


def all_path_distances(auto: Automaton, max_steps: int = 10_000) -> DataFrame:
    """(auto_id, state, weight) from the initial states, cycles or not.

    Supersteps first, which end soon on shallow graphs without cycles. If they don't, the smallest of their fronts is what
    everything after it comes from: from there, unary chains are shortened, and if
    supersteps still don't end, strongly connected components are looked for: their sums are closed inside each, and supersteps go over
    what lies between. No pairs of states are made outside components."""
    ring = auto.ring
    links, start = _started(auto)
    links, star, n = _loops(ring, links)
    found, front, before = _tried(ring, links, start, min(PATIENCE, max_steps))
    if found is None:
        found = _over_chains(ring, links, front, lambda short: _through_cycles(ring, short, front, max_steps))
        found = found if before is None else ring.sum(before.unionByName(found), KEYS)
    return _carried(ring, found, star) if n else found


def cost(auto: Automaton, distances: Distances = all_path_distances) -> DataFrame:
    """(auto_id, weight): the sum over all accepting paths of each automaton; zero where there is none."""
    ring = auto.ring
    reached = distances(auto).alias("d")
    final = auto.final.alias("f")
    both = reached.join(final, (F.col("d.auto_id") == F.col("f.auto_id")) & (F.col("d.state") == F.col("f.state")))
    both = both.select(F.col("d.auto_id").alias("auto_id"), ring.times(F.col("d.weight"), F.col("f.weight")).alias("weight"))
    total = ring.sum(both, ["auto_id"])
    ids = auto.initial.select("auto_id").distinct()
    return ids.join(total, "auto_id", "left").withColumn("weight", F.coalesce("weight", ring.lit(ring.zero)))
