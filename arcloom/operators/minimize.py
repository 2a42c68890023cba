"""Minimization by partition refinement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring
from arcloom.plans.iterate import Replaced, Steps, settled
from arcloom.sources.automaton import ARCS, STATES, Automaton

from .project import relabel
from .reach import accessible_states, restricted

#: A partitioner gives the form of a weight that a block's states must share.
Partitioner = Callable[[Semiring, Column], Column]


def identical(ring: Semiring, weight: Column) -> Column:
    """Weights equal but for the noise of floating point."""
    return ring.rounded(weight, 12)


def approximate(digits: int = 6) -> Partitioner:
    """Weights equal once rounded; the same from both sides and in any order."""
    return lambda ring, weight: ring.rounded(weight, digits)


@dataclass(frozen=True)
class Closeness:
    """A partitioner that needs all weights: those are of one class that neighbours in order, none more than tolerance from the next, lead
    between. Unlike on a grid, weights that close never part, wherever they lie."""

    tolerance: float = 1e-6


def close_classes(values: DataFrame, tolerance: float) -> DataFrame:
    """(auto_id, weight, least) of the distinct weights in values (auto_id, weight), least being the smallest of each one's class.

    Weights are sorted by ranges. In each range a class begins where the gap to the weight before is too large, and a weight's class is the
    last begun; only ranges' first and last weights and their last beginning pass from one range to the next."""
    ranged = values.select("auto_id", "weight").distinct().repartitionByRange("auto_id", "weight")
    order = settled(ranged.select("auto_id", "weight", F.spark_partition_id().alias("part")))
    far = lambda before: F.coalesce((F.col("weight") != before) & ~(F.col("weight") - before <= tolerance), F.lit(True))
    within = Window.partitionBy("auto_id", "part").orderBy("weight")
    own = order.withColumn("before", F.lag("weight").over(within))
    own = own.select("auto_id", "part", "weight", F.when(F.col("before").isNotNull() & far(F.col("before")), F.col("weight")).alias("begun"))
    parts = settled(own.groupBy("auto_id", "part").agg(F.min("weight").alias("weight"), F.max("weight").alias("last"), F.max("begun").alias("begun")))  # a row for each range
    across = Window.partitionBy("auto_id").orderBy("part")
    parts = parts.withColumn("opens", F.when(far(F.lag("last").over(across)), F.col("weight")))
    ended = F.last(F.coalesce("begun", "opens"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("auto_id", "part", F.coalesce("opens", ended).alias("carried"))
    least = F.coalesce(F.last("begun", ignorenulls=True).over(within), "carried")
    return own.join(F.broadcast(parts), ["auto_id", "part"]).select("auto_id", "weight", least.alias("least"))


def minimize(auto: Automaton, partitioner: Partitioner | Closeness = identical, max_rounds: int = 10_000) -> Automaton:
    """States that no string of labels and weights tells apart, merged; numbered from 0 in each automaton.

    A worklist of blocks: only what arcs sum to by label and by block that has split in the last round is looked at, so only states
    with arcs into such blocks can be told apart anew. A block's largest part keeps its name, the others get names of
    their own, and all of its parts are looked at in the next round; it ends when no block splits. For an automaton with several
    arcs of one label this is a bisimulation. Push weights first for the smallest result."""
    ring = auto.ring

    def formed(df: DataFrame) -> DataFrame:
        """df with the form of its weight."""
        if not isinstance(partitioner, Closeness):
            return df.withColumn("form", partitioner(ring, F.col("weight")))
        df = settled(df)
        return df.join(close_classes(df, partitioner.tolerance).withColumnRenamed("least", "form"), ["auto_id", "weight"])

    own = restricted(auto, settled(accessible_states(auto)))
    states, arcs = settled(own.arc_states()), settled(own.arcs)
    keys = ["auto_id", "state"]
    weighed = states.join(own.final, keys, "left").withColumn("weight", F.coalesce("weight", ring.lit(ring.zero)))
    first = F.sha2(F.coalesce(F.col("form").cast("string"), F.lit("-")), 256)
    table = Replaced(formed(weighed).select(*keys, first.alias("block"), F.lit(True).alias("split")), F.col("split"))
    steps = Steps(max_rounds, "a minimization")
    while table.n:
        steps.next()
        to = table.rows.filter("split").select("auto_id", F.col("state").alias("dst"), F.col("block").alias("to"))
        sums = ring.sum(arcs.join(to, ["auto_id", "dst"]), ["auto_id", "src", "ilabel", "olabel", "to"])
        item = F.struct("ilabel", "olabel", "to", F.col("form").alias("w"))
        arms = formed(sums.filter(~ring.is_zero(F.col("weight")))).groupBy("auto_id", F.col("src").alias("state")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(item))), 256).alias("arms"))
        seen = table.rows.drop("split").join(arms, keys, "left").withColumn("arms", F.coalesce("arms", F.lit("")))
        parts = seen.groupBy("auto_id", "block", "arms").agg(F.count("*").alias("n"))
        most = parts.groupBy("auto_id", "block").agg(F.max(F.struct("n", "arms")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
        named = seen.join(most, ["auto_id", "block"], "left")
        block = F.when(F.col("most").isNull() | (F.col("most.arms") == F.col("arms")), F.col("block")).otherwise(F.sha2(F.concat_ws("|", "block", "arms", F.lit(steps.done)), 256))
        table.put(named.select(*keys, block.alias("block"), F.col("most").isNotNull().alias("split")))
    blocks = table.rows.drop("split")
    low = blocks.groupBy("auto_id", "block").agg(F.min("state").alias("src"))
    to = blocks.select("auto_id", F.col("state").alias("dst"), F.col("block").alias("to"))
    merged = arcs.join(low, ["auto_id", "src"]).join(to, ["auto_id", "dst"])
    merged = ring.sum(merged.select("auto_id", F.col("block").alias("src"), F.col("to").alias("dst"), "ilabel", "olabel", "weight"), ["auto_id", "src", "dst", "ilabel", "olabel"])
    initial = ring.sum(own.initial.join(blocks, keys).select("auto_id", F.col("block").alias("state"), "weight"), keys)
    final = own.final.join(low.withColumnRenamed("src", "state"), keys).select("auto_id", F.col("block").alias("state"), "weight")
    return relabel(replace(auto, arcs=settled(merged.select(*ARCS)), initial=settled(initial.select(*STATES)), final=settled(final.select(*STATES)), reachable_only=True))
