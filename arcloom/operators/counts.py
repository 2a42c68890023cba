"""Expected counts of a template's arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring
from arcloom.plans.iterate import PATIENCE, counted, settled
from arcloom.sources.automaton import ARCS, Automaton

from .compose import intersect
from .distance import all_path_distances
from .project import reverse


def without_dead_ends(auto: Automaton) -> Automaton:
    """auto without arcs to states that are not final and that no arc leaves, round by round while there are any, PATIENCE rounds at most:
    such arcs are on no accepting path, and make branches of what are chains otherwise."""
    ended = settled(auto.final.select("auto_id", F.col("state").alias("dst")).distinct())
    arcs, n = counted(auto.arcs.select(*ARCS))
    for _ in range(PATIENCE):
        alive = arcs.select("auto_id", F.col("src").alias("dst")).unionByName(ended).distinct()
        before = n
        arcs, n = counted(arcs.join(alive, ["auto_id", "dst"], "left_semi").select(*ARCS))
        if n == before:
            break
    return auto.with_arcs(arcs)


def expected_counts(weighted: Automaton, template: Automaton) -> DataFrame:
    """(src, dst, label, weight) over the whole batch, not normalised: for each arc of the template the sum, over all paths of weighted and
    template together, of their weights, once for each time the arc is taken."""
    ring = weighted.ring
    both = without_dead_ends(intersect(weighted, template))
    ahead = all_path_distances(both).select("auto_id", F.col("state").alias("src"), F.col("weight").alias("ahead"))
    back = all_path_distances(reverse(both)).select("auto_id", F.col("state").alias("dst"), F.col("weight").alias("back"))
    arcs = both.arcs.join(settled(ahead), ["auto_id", "src"]).join(settled(back), ["auto_id", "dst"])
    mass = ring.times(ring.times(F.col("ahead"), F.col("weight")), F.col("back"))
    found = arcs.select(F.col("src.r").alias("src"), F.col("dst.r").alias("dst"), F.col("olabel").alias("label"), mass.alias("weight"))
    return ring.sum(found.filter(~ring.is_zero(F.col("weight"))), ["src", "dst", "label"])


def chain_counts(steps: DataFrame, ring: Semiring, template: str, init: str = "#", longest: int = 10, weight: object = None, epsilon: str = "") -> DataFrame:
    """expected_counts of linear automata (steps: auto_id, pos, label) against an n-gram template, without a loop.

    A template's state after a step follows from that step (unigram, bigram) or its position (positional), so a chain
    meets it in one path, whose mass is the chain's weight. The bigram needs the label before, a window in each chain;
    sums are partial aggregates."""
    unit = ring.lit(ring.one if weight is None else weight)
    steps = steps.select("auto_id", F.col("pos").cast("long").alias("pos"), "label")
    if template == "unigram":
        seen = steps.select("auto_id", "pos", F.lit(1).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), "label", unit.alias("weight"))
        end = F.lit(0).cast("long")
    elif template == "bigram":
        before = F.lag("label").over(Window.partitionBy("auto_id").orderBy("pos"))
        seen = steps.select("auto_id", "pos", F.coalesce(before, F.lit(init)).alias("src"), F.col("label").alias("dst"), "label", unit.alias("weight"))
        end = F.lit(epsilon)
    elif template == "positional":
        at = lambda p: F.least(p, F.lit(longest - 1)).cast("long")
        seen = steps.select("auto_id", "pos", at(F.col("pos")).alias("src"), at(F.col("pos") + 1).alias("dst"), "label", unit.alias("weight"))
        end = F.lit(-1).cast("long")
    else:
        raise ValueError(f"unknown template {template}")
    last = seen.groupBy("auto_id").agg(F.max_by("dst", "pos").alias("src"), F.first("weight").alias("weight"))
    closing = last.select("src", end.alias("dst"), F.lit(epsilon).alias("label"), "weight")
    return ring.sum(seen.select("src", "dst", "label", "weight").unionByName(closing), ["src", "dst", "label"])
