"""GraphViz output and equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.plans.iterate import settled
from arcloom.sources.automaton import Automaton


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(auto: Automaton) -> DataFrame:
    """(auto_id, kind, line): a line for each arc (kind 0) and each state (kind 1) of a GraphViz digraph, quotes escaped; initial states are drawn bold."""
    label = F.when(F.col("ilabel") == F.col("olabel"), F.col("ilabel").cast("string")).otherwise(F.concat_ws(":", "ilabel", "olabel"))
    text = F.concat(label, F.lit("/"), F.col("weight").cast("string"))
    arcs = auto.edges().select("auto_id", F.lit(0).alias("kind"), F.concat(_quoted(F.col("src")), F.lit("->"), _quoted(F.col("dst")), F.lit("[label="), _quoted(text), F.lit("]")).alias("line"))
    states = auto.final_weight(auto.states()).join(auto.initial.select("auto_id", "state", F.lit(True).alias("start")), ["auto_id", "state"], "left")
    name = F.concat(F.col("state").cast("string"), F.lit(" "), F.col("weight").cast("string"))
    bold = F.when(F.col("start"), F.lit(",style=bold")).otherwise(F.lit(""))
    nodes = states.select("auto_id", F.lit(1).alias("kind"), F.concat(_quoted(F.col("state")), F.lit("[label="), _quoted(name), bold, F.lit("]")).alias("line"))
    return arcs.unionByName(nodes)


def write_dot(auto: Automaton, path: str) -> None:
    """One digraph file of a single automaton, lines in order of kind and text. A drawing is small: one task writes it."""
    body = dot_lines(auto).orderBy("kind", "line").select("line")
    spark = body.sparkSession
    lines = [spark.createDataFrame([(t,)], "line string") for t in ("digraph {", "}")]
    lines[0].unionByName(body.coalesce(1)).unionByName(lines[1]).coalesce(1).write.text(path)


def equal(a: Automaton, b: Automaton, digits: int | None = None) -> bool:
    """The same initial weights, accessible arcs (as a set) and final weights of their states; names of states count. digits: weights compared rounded."""
    ring = a.ring

    def same(x: DataFrame, y: DataFrame) -> bool:
        if digits is not None:
            x, y = (z.withColumn("weight", ring.rounded(F.col("weight"), digits)) for z in (x, y))
        x, y = x.distinct(), y.distinct()
        return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()

    if not same(a.initial, b.initial):
        return False
    edges = [settled(z.edges()) for z in (a, b)[: 1 if a is b else 2]]  # found once, for what follows reads them several times
    ends = [z.final_weight(x.select("auto_id", F.col("src").alias("state")).unionByName(x.select("auto_id", F.col("dst").alias("state"))).unionByName(z.initial.select("auto_id", "state")).distinct()) for z, x in zip((a, b), edges)]
    return same(edges[0], edges[-1]) and same(ends[0], ends[-1])


def fingerprint(auto: Automaton) -> DataFrame:
    """(auto_id, hash) of the initial weights."""
    return auto.initial.groupBy("auto_id").agg(F.bit_xor(F.xxhash64("state", "weight")).alias("hash"))
