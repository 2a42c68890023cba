"""The k best paths of each automaton, best first and as far as they are asked for."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import TROPICAL, Best
from arcloom.plans.iterate import PATIENCE, Replaced, laid_out, settled
from arcloom.sources.automaton import Automaton

from .contract import contracted
from .distance import all_path_distances
from .project import reverse

KEYS = ["auto_id", "state"]
#: What has become of a path: it may be extended, it is extended in this superstep, it has been.
OPEN, TAKEN, SPENT = 0, 1, 2


def uniform(auto: Automaton) -> DataFrame | None:
    """No heuristic: every state may still gain a weight of one."""
    return None


def a_star(auto: Automaton) -> DataFrame:
    """For each state the sum over all its ways to an end; never worse than the best of them."""
    return all_path_distances(reverse(auto))


def best_way(auto: Automaton) -> DataFrame:
    """For each state the weight of its best way to an end, so that only beginnings of best paths are extended."""
    return all_path_distances(reverse(replace(auto, ring=Best(auto.ring))))


def _single(auto: Automaton) -> DataFrame:
    """(auto_id, src, dst, labels array, n, weight): each arc as a way of one."""
    label = auto.arcs.schema["olabel"].dataType.simpleString()
    own = F.when(F.col("olabel") == auto.eps, F.array().cast(f"array<{label}>")).otherwise(F.array("olabel"))
    return auto.arcs.filter(~auto.ring.is_zero(F.col("weight"))).select("auto_id", "src", "dst", own.alias("labels"), F.lit(1).cast("long").alias("n"), "weight")


def _chained(ways: DataFrame, auto: Automaton) -> DataFrame:
    """ways with each unary chain as one. States that are initial or final stay; of the others, those with one way in and one out
    are inside a chain, numbered from its first by pointer jumping."""
    ring = auto.ring
    ends = auto.initial.select(*KEYS).unionByName(auto.final.select(*KEYS)).distinct()
    degree = lambda end: ways.groupBy("auto_id", F.col(end).alias("state")).agg(F.count("*").alias("k")).filter("k = 1").select(*KEYS)
    inner = settled(degree("src").join(degree("dst"), KEYS).join(ends, KEYS, "left_anti"))
    named = lambda end: inner.withColumnRenamed("state", end)
    into = settled(ways.join(named("dst"), ["auto_id", "dst"], "left_semi").select("auto_id", "src", "dst", F.lit(1.0).alias("weight")))
    first = settled(into.join(named("src"), ["auto_id", "src"], "left_anti").select("auto_id", F.col("dst").alias("state")))
    short = contracted(into.join(named("src"), ["auto_id", "src"], "left_semi").unionByName(ways.join(named("src"), ["auto_id", "src"], "left_semi").join(named("dst"), ["auto_id", "dst"], "left_anti").select("auto_id", "src", "dst", F.lit(1.0).alias("weight"))), first.unionByName(ends), TROPICAL)
    place = settled(short.inner.select(*KEYS, F.col("at").alias("chain"), F.col("weight").cast("long").alias("pos")).unionByName(first.select(*KEYS, F.col("state").alias("chain"), F.lit(0).cast("long").alias("pos"))))
    at = lambda end: place.select("auto_id", F.col("state").alias(end), F.col("chain").alias(f"{end}_chain"), F.col("pos").alias(f"{end}_pos"))
    placed = settled(ways.join(at("src"), ["auto_id", "src"], "left").join(at("dst"), ["auto_id", "dst"], "left"))
    alone = placed.filter("src_chain is null and dst_chain is null").select(*ways.columns)
    chain = placed.filter("src_chain is not null or dst_chain is not null").withColumn("chain", F.coalesce("dst_chain", "src_chain")).withColumn("pos", F.coalesce(F.col("dst_pos"), F.col("src_pos") + 1))
    item = F.struct("pos", "src", "dst", "labels", "n", "weight")
    whole = chain.groupBy("auto_id", "chain").agg(F.array_sort(F.collect_list(item)).alias("all"))  # a chain's labels are in one row of the result as well
    product = F.aggregate("all", ring.lit(ring.one), lambda w, x: ring.times(w, x["weight"]))
    long = whole.select("auto_id", F.col("all")[0]["src"].alias("src"), F.element_at("all", -1)["dst"].alias("dst"), F.flatten(F.transform("all", lambda x: x["labels"])).alias("labels"), F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), product.alias("weight"))
    return alone.unionByName(long)


class BestPaths:
    """The accepting paths of each automaton in order of weight, ties by labels. next(k) gives the next k of each; what has been found is
    kept, and the search goes on from there.

    A path that may still be extended hopes for its weight times the heuristic's at its last state. Each superstep takes the paths
    that hope for most, a few times k of each automaton, and extends them by all ways out of their states. A path isn't taken
    while k better ones end at its state, or once k accepted ones beat its hope. A search that isn't done after PATIENCE supersteps
    begins again on the graph with each unary chain as one way, so a chain of any length takes a single superstep."""

    def __init__(self, auto: Automaton, heuristic=best_way, max_len: int | None = None, max_steps: int = 10_000):
        ring = auto.ring
        self.auto, self.max_len, self.max_steps, self.given = auto, max_len, max_steps, 0
        self.ways, self.short = laid_out(_single(auto), "auto_id", "src"), False
        ends = ring.sum(auto.final.filter(~ring.is_zero(F.col("weight"))), KEYS).withColumnRenamed("weight", "end")
        hints = heuristic(auto)
        self.blind = hints is None
        self.marks = settled(ends if hints is None else hints.filter(~ring.is_zero(F.col("weight"))).select(*KEYS, F.col("weight").alias("hint")).join(ends, KEYS, "left"))
        self.paths: Replaced | None = None

    def _order(self, name: str) -> Column:
        return F.col(name).desc() if self.auto.ring.descending else F.col(name).asc()

    def _arrived(self, df: DataFrame) -> DataFrame:
        """df (auto_id, state, labels, n, weight) with hope and, at final states, the total weight."""
        ring = self.auto.ring
        df = df.join(self.marks, KEYS, "left" if self.blind else "inner")
        hope = F.col("weight") if self.blind else ring.times(F.col("weight"), F.col("hint"))
        total = F.when(F.col("end").isNotNull(), ring.times(F.col("weight"), F.col("end")))
        return df.select(*KEYS, "labels", "n", "weight", hope.alias("hope"), total.alias("total"), F.lit(OPEN).alias("stage"))

    def _placed(self, paths: DataFrame) -> DataFrame:
        """paths with their place among those that end at the same state."""
        here = Window.partitionBy(*KEYS, *["n"] * (self.max_len is not None)).orderBy(self._order("weight"), "labels")
        return paths.withColumn("place", F.row_number().over(here))

    def _started(self) -> DataFrame:
        ring, auto = self.auto.ring, self.auto
        label = auto.arcs.schema["olabel"].dataType.simpleString()
        start = auto.initial.filter(~ring.is_zero(F.col("weight"))).select(*KEYS, F.array().cast(f"array<{label}>").alias("labels"), F.lit(0).cast("long").alias("n"), "weight")
        return self._placed(self._arrived(start))

    def _extended(self, paths: DataFrame, k: int) -> DataFrame:
        """paths after a superstep: those TAKEN in the last one are SPENT, those that hope for most are TAKEN, and what they
        grow into is added. Two weights of each automaton decide, that of its k-th accepted path and the lowest hope that is
        taken; both are found without bringing an automaton's paths together."""
        ring, width = self.auto.ring, max(64, 4 * k)

        def bar(df: DataFrame, by: str, at: int, name: str) -> DataFrame:
            order = Window.partitionBy("auto_id").orderBy(self._order(by))
            first = df.filter(F.col(by).isNotNull()).select("auto_id", by).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= at)
            return first.filter(F.col("r") == at).select("auto_id", F.col(by).alias(name))

        def reaches(name: str) -> Column:
            if ring.type == "boolean":
                return F.lit(True)
            slack = 1e-9 * F.greatest(F.lit(1.0), F.abs(name))
            return F.col(name).isNull() | ((F.col("hope") >= F.col(name) - slack) if ring.descending else (F.col("hope") <= F.col(name) + slack))

        may = (F.col("stage") == OPEN) & (F.col("place") <= k) & reaches("worst")
        if self.max_len is not None:
            may = may & (F.col("n") < self.max_len)
        known = paths.join(bar(paths, "total", k, "worst"), "auto_id", "left").withColumn("may", may)
        known = known.join(bar(known.filter("may"), "hope", width, "least"), "auto_id", "left").withColumn("taken", F.col("may") & reaches("least"))
        columns = [*KEYS, "labels", "n", "weight", "hope", "total"]
        kept = known.select(*columns, F.when(F.col("taken"), TAKEN).when(F.col("stage") == TAKEN, SPENT).otherwise(F.col("stage")).alias("stage"))
        p, w = known.filter("taken").alias("p"), self.ways.alias("w")
        grown = p.join(w, (F.col("p.auto_id") == F.col("w.auto_id")) & (F.col("p.state") == F.col("w.src")))
        grown = grown.select("p.auto_id", F.col("w.dst").alias("state"), F.concat("p.labels", "w.labels").alias("labels"), (F.col("p.n") + F.col("w.n")).alias("n"), ring.times(F.col("p.weight"), F.col("w.weight")).alias("weight"))
        if self.max_len is not None:
            grown = grown.filter(F.col("n") <= self.max_len)
        return self._placed(kept.unionByName(self._arrived(grown)))

    def _search(self, k: int, limit: int) -> bool:
        if self.paths is None:
            self.paths = Replaced(self._started(), F.col("stage") == TAKEN)
        for _ in range(limit):
            if not self.paths.put(self._extended(self.paths.rows, k)):
                return True
        return False

    def next(self, k: int) -> DataFrame:
        """(auto_id, rank, labels array, text, weight): the next k accepting paths of each automaton."""
        most = self.given + k
        if self.short or not self._search(most, PATIENCE):
            if not self.short:
                self.ways, self.short, self.paths = laid_out(_chained(self.ways, self.auto), "auto_id", "src"), True, None
            if not self._search(most, self.max_steps):
                raise RuntimeError(f"k-best took more than {self.max_steps} steps")
        best = Window.partitionBy("auto_id").orderBy(self._order("total"), "labels")
        found = self.paths.rows.filter("total is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)  # each task's first ones only are shuffled
        text = F.array_join(F.transform("labels", lambda x: x.cast("string")), "")
        found = settled(found.filter(F.col("rank") > self.given).select("auto_id", "rank", "labels", text.alias("text"), F.col("total").alias("weight")))
        self.given = most
        return found


def k_best(auto: Automaton, k: int, max_len: int | None = None, heuristic=best_way) -> DataFrame:
    """(auto_id, rank, labels array, text, weight): the k best accepting paths of each automaton, best first, ties by labels.

    Paths, not distinct strings, of any length, or of at most max_len arcs. Empty labels do not show. Tropical weights are best small,
    others large; weights must not get better along a path. See BestPaths, which can be asked for more later."""
    return BestPaths(auto, heuristic, max_len).next(k)
