"""Dense automata: states are numbers from 0, and weights between them lie in square blocks, multiplied block by block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring
from arcloom.plans.iterate import Steps, counted, importable, settled
from arcloom.sources.automaton import Automaton

from .collapse import neighbour_distances
from .project import numbered

BLOCK = ["auto_id", "i", "j"]
#: Cells that one row of a product's side holds, and up to a block's more.
PANEL = 1 << 14


@dataclass(frozen=True)
class DenseBlocks:
    """The matrix of one-step weights of automata whose states are 0, 1, ...

    blocks: auto_id, i, j, cells array<int>, weights: block (i, j) of size x size states; cell c is row c div size, column c mod size. Only
    blocks with an arc are there, and only their cells that aren't zero. names: auto_id, state, number."""

    blocks: DataFrame
    names: DataFrame
    ring: Semiring
    size: int


def _packed(ring: Semiring, cells: DataFrame) -> DataFrame:
    """(auto_id, i, j, cell, weight) with repeated cells summed, as rows of blocks. A block has size * size cells at most."""
    whole = ring.sum(cells, [*BLOCK, "cell"]).filter(~ring.is_zero(F.col("weight")))
    return whole.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("cell", "weight"))).alias("own")).select(*BLOCK, F.col("own.cell").alias("cells"), F.col("own.weight").alias("weights"))


def dense_blocks(auto: Automaton, size: int = 128) -> DenseBlocks:
    """auto's states numbered from 0 in each automaton, in their order, and its one-step weights in blocks. Parallel arcs are summed;
    states that only initial or final weights name have numbers too; an empty automaton has no blocks."""
    names = settled(numbered(auto.arc_states()).withColumnRenamed("n", "number"))
    at = lambda end: names.select("auto_id", F.col("state").alias(end), F.col("number").alias(f"{end}_no"))
    steps = neighbour_distances(auto).join(at("src"), ["auto_id", "src"]).join(at("dst"), ["auto_id", "dst"])
    part = lambda c: F.floor(F.col(c) / size).cast("long")
    cell = (F.col("src_no") % size * size + F.col("dst_no") % size).cast("int")
    blocks = _packed(auto.ring, steps.select("auto_id", part("src_no").alias("i"), part("dst_no").alias("j"), cell.alias("cell"), "weight"))
    return DenseBlocks(settled(blocks), names, auto.ring, size)


def _matched(ring: Semiring, a: list[np.ndarray], b: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and weights of the product of cells a (row, k, weight) and b (k, column, weight), 0 <= k < size. Where products are more
    than the places they fall into, sums are taken in a matrix, k by k; else they are matched by k and given one by one."""
    (rows, a_k, a_w), (b_k, columns, b_w) = a, b
    order = np.argsort(b_k, kind="stable")
    b_k, columns, b_w = b_k[order], columns[order], b_w[order]
    begin = np.searchsorted(b_k, np.arange(size + 1))
    times = np.diff(begin)[a_k]
    if not times.sum():
        return
    own_rows, own_columns = np.unique(rows), np.unique(columns)
    if len(own_rows) * len(own_columns) <= min(times.sum(), 1 << 22):
        made = np.full((len(own_rows), len(own_columns)), ring.zero, dtype=b_w.dtype)
        up, across = np.searchsorted(own_rows, rows), np.searchsorted(own_columns, columns)
        for k in np.unique(a_k[times > 0]):
            left, right = np.flatnonzero(a_k == k), slice(begin[k], begin[k + 1])
            spot = np.ix_(up[left], across[right])
            made[spot] = ring.plus_array(made[spot], ring.times_array(a_w[left][:, None], b_w[right][None, :]))
        i, j = np.nonzero(made != ring.zero)
        yield own_rows[i], own_columns[j], made[i, j]
        return
    cut = np.searchsorted(np.cumsum(times), np.arange(0, times.sum(), 1 << 18), side="right")
    for x, y in zip(cut, [*cut[1:], len(times)], strict=True):
        n = times[x:y]
        left = np.repeat(np.arange(x, y), n)
        right = np.arange(n.sum()) + np.repeat(begin[a_k[x:y]] - np.cumsum(n) + n, n)
        yield rows[left], columns[right], ring.times_array(a_w[left], b_w[right])


def _multiplied(ring: Semiring, size: int):
    """Pairs of panels to the cells of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.bool_ if ring.type == "boolean" else np.float64
        values = lambda batch, c, x: batch.column(c)[x].values.to_numpy(zero_copy_only=False)
        for batch in batches:
            for x in range(batch.num_rows):
                a = [values(batch, "a_far", x), values(batch, "a_near", x), values(batch, "a_weight", x).astype(kind)]
                b = [values(batch, "b_near", x), values(batch, "b_far", x), values(batch, "b_weight", x).astype(kind)]
                for r, c, w in _matched(ring, a, b, size):
                    own = batch.column("auto_id").take(pa.array(np.full(len(r), x)))
                    yield pa.RecordBatch.from_arrays([own, *map(pa.array, (r // size, c // size, (r % size * size + c % size).astype(np.int32), w))], names=["auto_id", "i", "j", "cell", "weight"])

    return run


def _panels(blocks: DataFrame, size: int, p: str) -> DataFrame:
    """(auto_id, k, p_far, p_near, p_weight): cells of blocks of one column k of blocks (p = a) or row k (b), near being their number in k. Nearly empty blocks
    share a row of PANEL cells or so, so what they cost goes by their cells."""
    k, far = ("j", "i") if p == "a" else ("i", "j")
    order = Window.partitionBy("auto_id", k).orderBy(far).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row, column = (lambda c: F.call_function("div", c, F.lit(size))), (lambda c: c % size)
    outer, inner = (row, column) if p == "a" else (column, row)
    placed = blocks.select(
        "auto_id",
        F.col(k).alias("k"),
        F.floor(F.sum(F.size("cells")).over(order) / PANEL).alias("panel"),
        F.transform("cells", lambda c: F.col(far) * size + outer(c)).alias("far"),
        F.transform("cells", lambda c: inner(c).cast("int")).alias("near"),
        "weights",
    )
    whole = placed.groupBy("auto_id", "k", "panel").agg(F.collect_list(F.struct("far", "near", "weights")).alias("own"))
    return whole.select("auto_id", "k", *[F.flatten(f"own.{c}").alias(f"{p}_{n}") for c, n in (("far", "far"), ("near", "near"), ("weights", "weight"))])


def block_product(ring: Semiring, size: int, left: DataFrame, right: DataFrame) -> DataFrame:
    """(auto_id, i, j, cell, weight): left times right; cells of one place are still to be summed."""
    importable(left.sparkSession)
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # panels are few rows of much work: not to be put together
    side = lambda df, p: _panels(df, size, p).repartition(n, "auto_id", "k")
    pairs = side(left, "a").join(side(right, "b"), ["auto_id", "k"])
    kind = left.schema["auto_id"].dataType.simpleString()
    return pairs.mapInArrow(_multiplied(ring, size), f"auto_id {kind}, i long, j long, cell int, weight {ring.type}")


def _cells(blocks: DataFrame) -> DataFrame:
    both = blocks.select(*BLOCK, F.explode(F.arrays_zip("cells", "weights")).alias("own"))
    return both.select(*BLOCK, F.col("own.cells").alias("cell"), F.col("own.weights").alias("weight"))


def block_distances(dense: DenseBlocks, max_doublings: int = 40) -> DataFrame:
    """(auto_id, src, dst, weight) by the states' own names: the sum over all paths between each pair, a path of no arcs included.

    Sums over paths of 1 to 2n arcs are those of 1 to n, and the n-th power times them and itself; each round doubles n. It ends when the power has no block
    left, after log2 of the longest path's arcs; in a graph with cycles that never is, and it raises at max_doublings (use all_pairs)."""
    ring, size = dense.ring, dense.size
    power, left = counted(dense.blocks)
    total, steps = power, Steps(max_doublings, "products of blocks")
    while left:
        steps.next()
        further = block_product(ring, size, power, total)
        total = settled(_packed(ring, _cells(total).unionByName(further)))
        power, left = counted(_packed(ring, block_product(ring, size, power, power)))
    number = lambda block, inner: (F.col(block) * size + inner).cast("long")
    cells = _cells(total).select("auto_id", number("i", F.floor(F.col("cell") / size)).alias("s"), number("j", F.col("cell") % size).alias("d"), "weight")
    named = lambda no, name: dense.names.select("auto_id", F.col("number").alias(no), F.col("state").alias(name))
    ways = cells.join(named("s", "src"), ["auto_id", "s"]).join(named("d", "dst"), ["auto_id", "d"]).select("auto_id", "src", "dst", "weight")
    own = dense.names.select("auto_id", F.col("state").alias("src"), F.col("state").alias("dst"), ring.lit(ring.one).alias("weight"))
    return ring.sum(ways.unionByName(own), ["auto_id", "src", "dst"])
