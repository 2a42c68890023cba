"""Automata from literals, sequences and tables; edit distance, length models and n-gram templates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.semiring import LOG, PROBABILITY, Semiring, log_diff

from .automaton import ARCS, EPSILON, INT_EPSILON, STATES, Automaton

eps = EPSILON


def arc(src: int, dst: int, label: object, weight: object = 1.0, out: object = None) -> tuple:
    """One arc of an acceptor, or of a transducer if out is given."""
    return (src, dst, label, label if out is None else out, weight)


def _frames(spark: SparkSession, ring: Semiring, auto_id: str, arcs: Iterable[tuple], initial: Mapping, final: Mapping, label: str):
    arcs = spark.createDataFrame([(auto_id, *a) for a in arcs], f"auto_id string, src long, dst long, ilabel {label}, olabel {label}, weight {ring.type}")
    ends = [spark.createDataFrame([(auto_id, s, w) for s, w in x.items() if w != ring.zero], f"auto_id string, state long, weight {ring.type}") for x in (initial, final)]
    return arcs, *ends


def automaton(spark: SparkSession, ring: Semiring, initial: Mapping[int, object], final: Mapping[int, object], arcs: Iterable[tuple], auto_id: str = "a") -> Automaton:
    """An automaton from literal arcs; states that initial or final leave out weigh zero. Integer labels have an integer epsilon."""
    arcs = list(arcs)
    number = bool(arcs) and isinstance(arcs[0][2], int)
    return Automaton(*_frames(spark, ring, auto_id, arcs, initial, final, "int" if number else "string"), ring, INT_EPSILON if number else EPSILON)


def transducer(spark: SparkSession, ring: Semiring, initial: Mapping[int, object], final: Mapping[int, object], arcs: Iterable[tuple], auto_id: str = "a") -> Automaton:
    """Like automaton, with an input and an output label on each arc. Its edges are all arcs, reachable or not."""
    made = automaton(spark, ring, initial, final, arcs, auto_id)
    return Automaton(made.arcs, made.initial, made.final, ring, made.epsilon, reachable_only=False)


def int_automaton(spark: SparkSession, ring: Semiring, arcs: Sequence[Sequence[tuple]], initial: Sequence, final: Sequence, auto_id: str = "a") -> Automaton:
    """From indexed sequences: arcs[s] holds (dst, label, weight) of state s."""
    listed = [arc(s, d, label, w) for s, out in enumerate(arcs) for d, label, w in out]
    return automaton(spark, ring, dict(enumerate(initial)), dict(enumerate(final)), listed, auto_id)


def from_frames(arcs: DataFrame, initial: DataFrame, final: DataFrame, ring: Semiring, epsilon: object = EPSILON, shared: bool = False) -> Automaton:
    """From tables; a missing olabel is the ilabel, a missing auto_id one automaton. Zero initial and final weights go."""
    if "olabel" not in arcs.columns:
        arcs = arcs.withColumn("olabel", F.col("ilabel"))
    arcs, initial, final = (x if "auto_id" in x.columns else x.withColumn("auto_id", F.lit("a")) for x in (arcs, initial, final))
    live = [x.filter(~ring.is_zero(F.col("weight"))).select(*STATES) for x in (initial, final)]
    return Automaton(arcs.select(*ARCS), *live, ring, epsilon, shared)


def chains(steps: DataFrame, ring: Semiring, weight: object = None) -> Automaton:
    """One linear automaton for each auto_id of steps (auto_id, pos, label); positions count from 0 without gaps."""
    one = ring.lit(ring.one)
    arcs = steps.select("auto_id", F.col("pos").cast("long").alias("src"), (F.col("pos") + 1).cast("long").alias("dst"), F.col("label").alias("ilabel"), F.col("label").alias("olabel"), one.alias("weight"))
    sizes = steps.groupBy("auto_id").agg(F.max("pos").alias("last"))
    initial = sizes.select("auto_id", F.lit(0).cast("long").alias("state"), ring.lit(ring.one if weight is None else weight).alias("weight"))
    final = sizes.select("auto_id", (F.col("last") + 1).cast("long").alias("state"), one.alias("weight"))
    return Automaton(arcs, initial, final, ring)


def spelled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(auto_id, pos, label) of texts, a character each."""
    return df.select(F.col(id_col).cast("string").alias("auto_id"), F.posexplode(F.split(text_col, "")).alias("pos", "label")).filter("label <> ''")


def constant(spark: SparkSession, text: str, weight: object, ring: Semiring, auto_id: str = "a") -> Automaton:
    """The linear automaton of one text: weight at its start, one elsewhere; the empty text is one state."""
    n = len(text)
    return automaton(spark, ring, {0: weight}, {n: ring.one}, [arc(i, i + 1, c, ring.one) for i, c in enumerate(text)], auto_id)


def edit_distance(spark: SparkSession, substitution: float, insertion: float, alphabet: Iterable[str], auto_id: str = "edit") -> Automaton:
    """A one-state transducer in the log ring whose mass over all inputs is one for any output.

    Ratios are logs relative to a match; minus infinity leaves an edit out."""
    if not (substitution < 0 and insertion < 0):
        raise ValueError("both ratios must be below 0")
    letters = sorted(set(alphabet))
    n = len(letters)
    match = -math.log((n - 1) * math.exp(substitution) + 1 + (n + 1) * math.exp(insertion))
    sub, ins = substitution + match, insertion + match
    chars = spark.createDataFrame([(c,) for c in [*letters, eps]], "c string")
    a, b = chars.select(F.col("c").alias("ilabel")), chars.select(F.col("c").alias("olabel"))
    weight = F.when((F.col("ilabel") == eps) | (F.col("olabel") == eps), F.lit(ins)).when(F.col("ilabel") == F.col("olabel"), F.lit(match)).otherwise(F.lit(sub))
    pairs = a.crossJoin(F.broadcast(b)).filter("ilabel <> '' or olabel <> ''")  # an alphabet with itself
    arcs = pairs.select(F.lit(auto_id).alias("auto_id"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), "ilabel", "olabel", weight.alias("weight"))
    start = spark.createDataFrame([(auto_id, 0, 0.0)], "auto_id string, state long, weight double")
    end = spark.createDataFrame([(auto_id, 0, math.log(1 - n * math.exp(ins)))], "auto_id string, state long, weight double")
    return Automaton(arcs.filter(F.col("weight") > -math.inf), start, end, LOG, shared=True)


def unit_edits(spark: SparkSession, alphabet: Iterable[str], ring: Semiring, edit: float = 1.0) -> Automaton:
    """A one-state transducer that copies at weight one and edits at weight edit."""
    letters = sorted(set(alphabet))
    arcs = [(0, 0, x, y, ring.one if x == y else edit) for x in [*letters, eps] for y in [*letters, eps] if x or y]
    made = transducer(spark, ring, {0: ring.one}, {0: ring.one}, arcs, "edit")
    return Automaton(made.arcs, made.initial, made.final, ring, shared=True)


def decay(spark: SparkSession, expected: float, chars: Iterable[str], auto_id: str = "decay") -> Automaton:
    """Geometric lengths with the given mean, letters uniform; log ring, total mass one."""
    letters = sorted(set(chars))
    own = math.log(expected / (1 + expected)) - math.log(len(letters))
    return automaton(spark, LOG, {0: 0.0}, {0: math.log(1 / (1 + expected))}, [arc(0, 0, c, own) for c in letters], auto_id)


def poisson(spark: SparkSession, expected: float, longest: int, chars: Iterable[str], loop: float = 0.9, normalized: bool = False, auto_id: str = "poisson") -> Automaton:
    """Poisson lengths up to longest, then a loop for what is left; log ring.

    As the formula is usually given, every loop step takes the left-over mass again, so the total stays below one;
    normalized takes it once, with the final weight."""
    letters = spark.createDataFrame([(c,) for c in sorted(set(chars))], "c string")
    size = math.log(letters.count())
    steps = spark.range(0, longest + 1).select(F.col("id").alias("state"))
    # log pmf(s) = s log E - E - sum of log k for k up to s
    facts = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("state")), F.lit(0.0), lambda a, k: a + F.log(F.greatest(k, F.lit(1)).cast("double")))
    mass = steps.select("state", (F.col("state") * math.log(expected) - expected - facts).alias("weight"))
    below = LOG.sum(mass.filter(F.col("state") < longest), [])
    left = below.select(log_diff(F.lit(0.0), F.col("weight")).alias("left")).first()[0] if longest else 0.0
    named = lambda df: df.withColumn("auto_id", F.lit(auto_id))
    final = named(mass.withColumn("weight", F.when(F.col("state") < longest, F.col("weight")).otherwise(F.lit(left + math.log(loop))))).select(*STATES)
    again = math.log(1 - loop) + (0.0 if normalized else left) - size
    arcs = named(steps.crossJoin(F.broadcast(letters)).select(F.col("state").alias("src"), F.least(F.col("state") + 1, F.lit(longest)).alias("dst"), F.col("c").alias("ilabel"), F.col("c").alias("olabel"), F.when(F.col("state") < longest, F.lit(-size)).otherwise(F.lit(again)).alias("weight")))
    start = spark.createDataFrame([(auto_id, 0, 0.0)], "auto_id string, state long, weight double")
    return Automaton(arcs.select(*ARCS), start, final, LOG)


def _letters(spark: SparkSession, chars: Iterable[str] | DataFrame) -> DataFrame:
    if isinstance(chars, DataFrame):
        return chars.select(F.col(chars.columns[0]).alias("c")).distinct()
    return spark.createDataFrame([(c,) for c in sorted(set(chars))], "c string")


def _template(arcs: DataFrame, start: Column, end: Column, ring: Semiring, spark: SparkSession) -> Automaton:
    one = ring.lit(ring.one)
    arcs = arcs.select(F.lit("t").alias("auto_id"), "src", "dst", F.col("c").alias("ilabel"), F.col("c").alias("olabel"), one.alias("weight"))
    ends = [spark.range(1).select(F.lit("t").alias("auto_id"), s.alias("state"), one.alias("weight")) for s in (start, end)]
    return Automaton(arcs, *ends, ring, shared=True)


def unigram_template(spark: SparkSession, chars: Iterable[str] | DataFrame, ring: Semiring = PROBABILITY) -> Automaton:
    """States 1 and 0: any letter loops at 1, epsilon leads to 0, which is final."""
    letters = _letters(spark, chars).select(F.lit(1).cast("long").alias("src"), F.lit(1).cast("long").alias("dst"), "c")
    end = spark.range(1).select(F.lit(1).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(eps).alias("c"))
    return _template(letters.unionByName(end), F.lit(1).cast("long"), F.lit(0).cast("long"), ring, spark)


def bigram_template(spark: SparkSession, init: str, chars: Iterable[str] | DataFrame, ring: Semiring = PROBABILITY) -> Automaton:
    """The state is the letter before; epsilon leads to the empty state, which is final, from all but init."""
    letters = _letters(spark, chars).filter(F.col("c") != eps)
    states = letters.select(F.col("c").alias("src")).unionByName(spark.range(1).select(F.lit(init).alias("src"))).distinct()
    inner = states.crossJoin(F.broadcast(letters)).select("src", F.col("c").alias("dst"), "c")  # an alphabet with itself
    ends = states.filter(F.col("src") != init).select("src", F.lit(eps).alias("dst"), F.lit(eps).alias("c"))
    return _template(inner.unionByName(ends), F.lit(init), F.lit(eps), ring, spark)


def positional_template(spark: SparkSession, chars: Iterable[str] | DataFrame, longest: int, ring: Semiring = PROBABILITY) -> Automaton:
    """The state is the position, at most longest - 1; epsilon leads from any to -1, which is final."""
    letters = _letters(spark, chars)
    steps = spark.range(0, longest).select(F.col("id").alias("src"))
    inner = steps.crossJoin(F.broadcast(letters)).select("src", F.least(F.col("src") + 1, F.lit(longest - 1)).alias("dst"), "c")
    ends = steps.select("src", F.lit(-1).cast("long").alias("dst"), F.lit(eps).alias("c"))
    return _template(inner.unionByName(ends), F.lit(0).cast("long"), F.lit(-1).cast("long"), ring, spark)
