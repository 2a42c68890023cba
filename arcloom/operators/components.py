"""Strongly connected components, and sums over all paths inside them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring
from arcloom.plans.iterate import Replaced, Steps, importable, settled

from .project import numbered

KEYS = ["auto_id", "state"]
#: States of a component up to which one task sums its paths; larger components are eliminated block by block.
BLOCK = 256
#: States of a component up to which it is one row, so that a task closes many of them at once.
SMALL = 32


def core(links: DataFrame, max_steps: int = 10_000) -> Replaced:
    """The rows of links (auto_id, src, dst) on cycles or between cycles: arcs that none leads to, or from, go until none does."""

    def peeled(arcs: DataFrame) -> DataFrame:
        entered = arcs.select("auto_id", F.col("dst").alias("src")).distinct()
        left = arcs.select("auto_id", F.col("src").alias("dst")).distinct()
        return arcs.join(entered, ["auto_id", "src"], "left_semi").join(left, ["auto_id", "dst"], "left_semi")

    rest, steps, size = Replaced(links.select("auto_id", "src", "dst").filter("src <> dst").distinct()), Steps(max_steps, "the search for cycles"), -1
    while rest.n and rest.n != size:
        steps.next()
        size = rest.n
        rest.put(peeled(rest.rows))
    return rest


def components(links: DataFrame, max_steps: int = 10_000) -> DataFrame | None:
    """(auto_id, state, root) of the states in components of two states or more, root being the smallest; None where there are none.

    Forward and backward labelling: every state takes the smallest state that leads to it as its colour; the states of a
    colour that lead back to the state it is named after are one component. These go, links between colours go, and what
    cycles are left are coloured anew. All components of all automata advance together."""
    rest, steps, found = core(links, max_steps), Steps(max_steps, "components"), []
    while rest.n:
        arcs = rest.rows
        states = arcs.select("auto_id", F.col("src").alias("state"))  # every state of the core has an arc out
        colour = Replaced(states.distinct().withColumn("colour", F.col("state")).withColumn("moved", F.lit(True)), F.col("moved"))
        while colour.n:
            steps.next()
            passed = colour.rows.filter("moved").select("auto_id", F.col("state").alias("src"), "colour").join(arcs, ["auto_id", "src"])
            least = passed.groupBy("auto_id", F.col("dst").alias("state")).agg(F.min("colour").alias("new"))
            moved = F.coalesce(F.col("new") < F.col("colour"), F.lit(False))
            colour.put(colour.rows.drop("moved").join(least, KEYS, "left").select(*KEYS, F.when(moved, F.col("new")).otherwise(F.col("colour")).alias("colour"), moved.alias("moved")))
        named = colour.rows.select(*KEYS, "colour")
        at = lambda end: named.select("auto_id", F.col("state").alias(end), F.col("colour").alias(f"{end}_colour"))
        inside = settled(arcs.join(at("src"), ["auto_id", "src"]).join(at("dst"), ["auto_id", "dst"]).filter("src_colour = dst_colour").select("auto_id", "src", "dst", F.col("src_colour").alias("colour")))
        back = Replaced(named.filter("state = colour").withColumn("new", F.lit(True)), F.col("new"))
        reached, states_in_all = back.n, named.count()
        while back.n and reached < states_in_all:
            steps.next()
            led = inside.join(back.rows.filter("new").select("auto_id", F.col("state").alias("dst")), ["auto_id", "dst"], "left_semi").select("auto_id", F.col("src").alias("state"), "colour").distinct()
            fresh = led.join(back.rows, KEYS, "left_anti").withColumn("new", F.lit(True))
            back.put(back.rows.withColumn("new", F.lit(False)).unionByName(fresh))
            reached += back.n
        done = back.rows.select(*KEYS, F.col("colour").alias("root"))
        found.append(done)
        if reached == states_in_all:
            break
        left = inside
        for end in ("src", "dst"):
            left = left.join(done.select("auto_id", F.col("state").alias(end)), ["auto_id", end], "left_anti")
        rest = core(settled(left.select("auto_id", "src", "dst")), max_steps)
    if not found:
        return None
    every = reduce(DataFrame.unionByName, found)
    size = every.groupBy("auto_id", "root").agg(F.count("*").alias("n")).filter("n > 1").select("auto_id", "root")
    return settled(every.join(size, ["auto_id", "root"]).select(*KEYS, "root"))


def _solved(cells: DataFrame, ring: Semiring) -> DataFrame:
    """cells (comp, i, j, weight) of square matrices, each the sum of its powers; a task for each comp, of BLOCK states at most."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(np.concatenate([part["i"], part["j"]]))
        a = np.full((len(own), len(own)), ring.zero, dtype=np.bool_ if ring.type == "boolean" else np.float64)
        a[np.searchsorted(own, part["i"]), np.searchsorted(own, part["j"])] = part["weight"]
        i, j = np.nonzero((closed := ring.closed_(a)) != ring.zero)
        return pd.DataFrame({"comp": part["comp"].iloc[0], "i": own[i], "j": own[j], "weight": closed[i, j]})

    return cells.groupBy("comp").applyInPandas(solve, f"comp long, i long, j long, weight {ring.type}")


def _eliminated(cells: DataFrame, ring: Semiring, blocks: int, block: int) -> DataFrame:
    """The same for components of any size: for each block of states, its own matrix is closed, and paths through it are added to
    all other cells by joins."""
    keys, bi, bj = ["comp", "i", "j"], F.floor(F.col("i") / block), F.floor(F.col("j") / block)
    table = Replaced(cells)

    def product(x: DataFrame, y: DataFrame) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        both = a.join(b, (F.col("a.comp") == F.col("b.comp")) & (F.col("a.j") == F.col("b.i")))
        return ring.sum(both.select("a.comp", "a.i", "b.j", ring.times(F.col("a.weight"), F.col("b.weight")).alias("weight")), keys)

    for k in range(blocks):
        now = table.rows
        here = now.filter(bi == k).select("comp", "i").unionByName(now.filter(bj == k).select("comp", F.col("j").alias("i"))).distinct()
        units = here.select("comp", "i", F.col("i").alias("j"), ring.lit(ring.zero).alias("weight"))  # states without arcs in the block have a closure as well
        own = settled(_solved(ring.sum(now.filter((bi == k) & (bj == k)).unionByName(units), keys), ring))
        to, of = now.filter((bi != k) & (bj == k)), now.filter((bi == k) & (bj != k))
        through = settled(product(to, own))
        rest = ring.sum(now.filter((bi != k) & (bj != k)).unionByName(product(through, of)), keys)
        table.put(own.unionByName(through).unionByName(product(own, of)).unionByName(rest).select(*keys, "weight"))
    return table.rows


def numbered_inside(members: DataFrame) -> DataFrame:
    """members (auto_id, state, root) with their component's size and, where that is SMALL at most, their number n in it, from 0."""
    size = members.groupBy("auto_id", "root").agg(F.count("*").alias("size"))
    sized = settled(members.join(size, ["auto_id", "root"]))
    small = sized.filter(F.col("size") <= SMALL).withColumn("n", F.row_number().over(Window.partitionBy("auto_id", "root").orderBy("state")) - 1)
    return settled(small.unionByName(sized.filter(F.col("size") > SMALL).withColumn("n", F.lit(None).cast("int"))))


def placed_inside(links: DataFrame, own: DataFrame) -> DataFrame:
    """links with root, size, s and d of own (as numbered_inside gives it), and whether both ends are in one component."""
    at = lambda end, *more: own.select("auto_id", F.col("state").alias(end), F.col("root").alias(f"{end}_root"), F.col("n").alias(end[0]), *more)
    both = links.join(at("src", "size"), ["auto_id", "src"], "left").join(at("dst"), ["auto_id", "dst"], "left")
    inside = F.coalesce(F.col("src_root") == F.col("dst_root"), F.lit(False))
    return both.select("auto_id", "src", "dst", "weight", F.col("src_root").alias("root"), "size", "s", "d", inside.alias("inside"))


def _closed_rows(ring: Semiring):
    """Rows of small components: size, and i, j, w of their cells; to the same of their closures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.bool_ if ring.type == "boolean" else np.float64
        for batch in batches:
            flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "j", "w")]
            size = batch.column("size").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), batch.column("i").value_lengths().to_numpy(zero_copy_only=False))
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                for a in range(0, len(mine), step := max(1, (1 << 20) // (n * n))):
                    part = mine[a : a + step]
                    cells, spot = np.isin(row, part), np.full((len(part), n, n), ring.zero, dtype=kind)
                    i, j, w = (x[cells] for x in flat)
                    spot[np.searchsorted(part, row[cells]), i, j] = w
                    b, i, j = np.nonzero((closed := ring.closed_all_(spot)) != ring.zero)
                    ends = pa.array(np.searchsorted(b, np.arange(len(part) + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (i.astype(np.int32), j.astype(np.int32), closed[b, i, j])]
                    kept = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([kept.column("auto_id"), kept.column("names"), *lists], names=["auto_id", "names", "i", "j", "w"])

    return run


def closed_inside(ring: Semiring, links: DataFrame, own: DataFrame, block: int = BLOCK) -> DataFrame:
    """(auto_id, src, dst, weight): the sum over all paths inside a component, the empty path included. links as placed_inside gives them, from
    inside components; own as numbered_inside does. A small component is a row, and its states' names stay in Spark."""
    importable(links.sparkSession)
    key = ["auto_id", "root"]
    cells = ring.sum(links.filter(F.col("size") <= SMALL), [*key, "s", "d"])
    rows = cells.groupBy(*key).agg(F.collect_list(F.struct("s", "d", "weight")).alias("c")).select(*key, F.col("c.s").alias("i"), F.col("c.d").alias("j"), F.col("c.weight").alias("w"))
    names = own.filter(F.col("size") <= SMALL).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "state"))).alias("c"), F.first("size").cast("int").alias("size"))
    whole = rows.join(names.select(*key, "size", F.col("c.state").alias("names")), key).select("auto_id", "names", "size", "i", "j", "w")
    types = {c: whole.schema[c].dataType.simpleString() for c in ("auto_id", "names")}
    made = whole.mapInArrow(_closed_rows(ring), f"auto_id {types['auto_id']}, names {types['names']}, i array<int>, j array<int>, w array<{ring.type}>")
    made = made.select("auto_id", "names", F.explode(F.arrays_zip("i", "j", "w")).alias("c"))
    found = settled(made.select("auto_id", F.get("names", F.col("c.i")).alias("src"), F.get("names", F.col("c.j")).alias("dst"), F.col("c.w").alias("weight")))
    more = own.filter(F.col("size") > SMALL).select("auto_id", "state", "root")
    if more.isEmpty():
        return found
    return found.unionByName(_closed_by_cells(ring, links.filter(F.col("size") > SMALL).select("auto_id", "src", "dst", "weight"), more, block))


def closures(spark: SparkSession, ring: Semiring, links: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(auto_id, src, dst, weight): the sum over all paths inside a component, the empty path included, of the components that members
    (auto_id, state, root) names. Exact for closed rings: loops are summed by the ring's closure, not approached."""
    if block < SMALL:
        return _closed_by_cells(ring, links, members, block)
    own = numbered_inside(members)
    return closed_inside(ring, placed_inside(links, own).filter("inside"), own, block)


def _closed_by_cells(ring: Semiring, links: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """The same by rows of cells: a task for each component of up to block states, elimination by joins beyond."""
    importable(links.sparkSession)
    comp = members.select(F.struct("auto_id", "root").alias("key")).distinct().select(F.col("key").alias("state"), F.lit(0).alias("auto_id"))
    numbers = settled(numbered(comp.select("auto_id", "state")).select(F.col("state.auto_id").alias("auto_id"), F.col("state.root").alias("root"), F.col("n").alias("comp")))
    placed = settled(numbered(members.join(numbers, ["auto_id", "root"]).select(F.col("comp").alias("auto_id"), F.struct("auto_id", "state").alias("state"))).select(F.col("auto_id").alias("comp"), F.col("state.auto_id").alias("auto_id"), F.col("state.state").alias("state"), "n"))
    at = lambda end: placed.select("auto_id", F.col("state").alias(end), F.col("comp").alias(f"{end}_comp"), F.col("n").alias(end[0]))
    cells = links.join(at("src"), ["auto_id", "src"]).join(at("dst"), ["auto_id", "dst"]).filter("src_comp = dst_comp")
    cells = settled(ring.sum(cells.select(F.col("src_comp").alias("comp"), F.col("s").alias("i"), F.col("d").alias("j"), "weight"), ["comp", "i", "j"]))
    sizes = settled(placed.groupBy("comp").agg(F.count("*").alias("size")))
    small, large = (sizes.filter(x).select("comp") for x in (F.col("size") <= block, F.col("size") > block))
    made = _solved(cells.join(small, "comp", "left_semi"), ring)
    most = sizes.agg(F.max("size")).first()[0] or 0
    if most > block:
        made = made.unionByName(_eliminated(cells.join(large, "comp", "left_semi"), ring, -(-most // block), block))
    back = lambda end, n: placed.select("comp", F.col("n").alias(n), "auto_id", F.col("state").alias(end))
    return settled(made.join(back("src", "i"), ["comp", "i"]).join(back("dst", "j").drop("auto_id"), ["comp", "j"]).filter(~ring.is_zero(F.col("weight"))).select("auto_id", "src", "dst", "weight"))
