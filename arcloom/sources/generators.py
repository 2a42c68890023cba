"""Automata without tables of arcs: edits towards given words, lengths over any letters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcloom.functions.semiring import LOG, TROPICAL, Semiring
from arcloom.operators.generated import Generated
from arcloom.sources.automaton import EPSILON


def edits_to(targets: DataFrame, most: int, ring: Semiring = TROPICAL, same: float = 0.0, edit: float = 1.0) -> Generated:
    """Reads anything and writes targets' words (auto_id, word), with at most `most` substitutions, deletions and insertions on the way.

    A state is (word, at, edits): the word, how many of its letters are written and the edits so far. Letters that stay weigh `same`, edits
    `edit`. Words are those of each auto_id. Null words are left out; an empty word is reached by deletions alone."""
    words = targets.filter("word is not null").select("auto_id", "word").distinct()
    start = words.select("auto_id", F.struct("word", F.lit(0).alias("at"), F.lit(0).alias("edits")).alias("state"), ring.lit(ring.one).alias("weight"))
    length = lambda s: F.char_length(s["word"])
    letter = lambda s: F.substr(s["word"], s["at"] + 1, F.lit(1))

    def moved(s, step, edits, olabel, weight):
        return F.struct(F.struct(s["word"].alias("word"), (s["at"] + step).alias("at"), (s["edits"] + edits).cast("int").alias("edits")).alias("dst"), olabel.alias("olabel"), weight.cast("double").alias("weight"))

    def allowed(s, arcs):
        return F.filter(arcs, lambda a: (a["dst"]["at"] <= length(s)) & (a["dst"]["edits"] <= most))

    def reading(s, c):
        stays = letter(s) == c
        over = moved(s, 1, F.when(stays, 0).otherwise(1), letter(s), F.when(stays, F.lit(same)).otherwise(F.lit(edit)))
        return allowed(s, F.array(over, moved(s, 0, F.lit(1), F.lit(EPSILON), F.lit(edit))))

    def silent(s):
        return allowed(s, F.array(moved(s, 1, F.lit(1), letter(s), F.lit(edit))))

    def ending(s):
        return F.when(s["at"] == length(s), ring.lit(ring.one)).otherwise(ring.lit(ring.zero))

    return Generated(start, reading, silent, ending, ring, shared=False)


def any_lengths(spark, expected: float, letters: int) -> Generated:
    """Geometric lengths with the given mean over an alphabet of which only the size is known; log ring."""
    own = math.log(expected / (1 + expected)) - math.log(letters)
    start = spark.range(1).select(F.lit("decay").alias("auto_id"), F.col("id").alias("state"), F.lit(0.0).alias("weight"))
    arc = lambda s, c: F.struct(s.alias("dst"), c.alias("olabel"), F.lit(own).alias("weight"))
    return Generated(start, lambda s, c: F.array(arc(s, c)), lambda s: F.slice(F.array(arc(s, F.lit(EPSILON))), 1, 0), lambda s: F.lit(math.log(1 / (1 + expected))), LOG)
