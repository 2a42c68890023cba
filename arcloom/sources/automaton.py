"""The automaton: arcs, initial and final weights as DataFrames, a batch of automata under auto_id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.semiring import Semiring

ARCS = ("auto_id", "src", "dst", "ilabel", "olabel", "weight")
STATES = ("auto_id", "state", "weight")
#: The empty label of text alphabets, and of integer ones.
EPSILON, INT_EPSILON = "", -(1 << 31)


@dataclass(frozen=True)
class Alphabet:
    """A type of labels and its empty one. Labels of a product are structs (left, right), its empty label the pair of both."""

    epsilon: object

    def lit(self) -> Column:
        if isinstance(self.epsilon, tuple):
            return F.struct(*[Alphabet(e).lit().alias(n) for n, e in zip(("left", "right"), self.epsilon, strict=True)])
        return F.lit(self.epsilon)

    def __mul__(self, other: Alphabet) -> Alphabet:
        return Alphabet((self.epsilon, other.epsilon))


TEXT, INTEGERS = Alphabet(EPSILON), Alphabet(INT_EPSILON)


@dataclass(frozen=True)
class Automaton:
    """A batch of weighted automata or transducers over one semiring.

    arcs: auto_id, src, dst, ilabel, olabel, weight; initial and final: auto_id, state, weight. States are of any type that Spark
    can compare; an acceptor has equal labels on each arc. epsilon is the empty label. shared: a single automaton that stands
    against every auto_id of another batch. reachable_only is False where arcs off all paths belong to the value (after
    filter_arcs, or from a transducer's listed arcs).
    """

    arcs: DataFrame
    initial: DataFrame
    final: DataFrame
    ring: Semiring
    epsilon: object = EPSILON
    shared: bool = False
    reachable_only: bool = True

    def __post_init__(self) -> None:
        for frame, names in ((self.arcs, ARCS), (self.initial, STATES), (self.final, STATES)):
            missing = [n for n in names if n not in frame.columns]
            if missing:
                raise ValueError(f"columns {missing} are missing; found {frame.columns}")

    @property
    def alphabet(self) -> Alphabet:
        return Alphabet(self.epsilon)

    @property
    def eps(self) -> Column:
        """The empty label."""
        return self.alphabet.lit()

    @property
    def spark(self) -> SparkSession:
        return self.arcs.sparkSession

    def with_arcs(self, arcs: DataFrame) -> Automaton:
        return replace(self, arcs=arcs.select(*ARCS))

    def transform(self, step: Callable[[Automaton], Automaton]) -> Automaton:
        return step(self)

    # Accessors ----------------------------------------------------------------------------------------------------

    def arcs_from(self, state: object) -> DataFrame:
        return self.arcs.filter(F.col("src") == F.lit(state))

    def final_weight(self, states: DataFrame) -> DataFrame:
        """(auto_id, state, weight) of every row of states; zero where a state isn't final."""
        own = states.select("auto_id", "state").join(self.final, ["auto_id", "state"], "left")
        return own.withColumn("weight", F.coalesce("weight", self.ring.lit(self.ring.zero)))

    def arc_states(self) -> DataFrame:
        """All states that arcs, initial or final weights name."""
        pick = lambda df, c: df.select("auto_id", F.col(c).alias("state"))
        found = pick(self.arcs, "src").unionByName(pick(self.arcs, "dst"))
        return found.unionByName(pick(self.initial, "state")).unionByName(pick(self.final, "state")).distinct()

    # Operators ----------------------------------------------------------------------------------------------------

    def filter_arcs(self, keep: Column) -> Automaton:
        from arcloom.operators.select import filter_arcs

        return filter_arcs(self, keep)

    def as_transducer(self) -> Automaton:
        from arcloom.operators.project import as_transducer

        return as_transducer(self)

    def swap_labels(self) -> Automaton:
        from arcloom.operators.project import swap_labels

        return swap_labels(self)

    def input_projection(self) -> Automaton:
        from arcloom.operators.project import input_projection

        return input_projection(self)

    def output_projection(self) -> Automaton:
        from arcloom.operators.project import output_projection

        return output_projection(self)

    def relabel(self) -> Automaton:
        from arcloom.operators.project import relabel

        return relabel(self)

    def reverse(self) -> Automaton:
        from arcloom.operators.project import reverse

        return reverse(self)

    def collapse_edges(self) -> Automaton:
        from arcloom.operators.collapse import collapse_edges

        return collapse_edges(self)

    def edges(self) -> DataFrame:
        from arcloom.operators.reach import accessible_arcs

        return accessible_arcs(self)

    def states(self) -> DataFrame:
        from arcloom.operators.reach import accessible_states

        return accessible_states(self)

    def is_cyclic(self) -> DataFrame:
        from arcloom.operators.reach import is_cyclic

        return is_cyclic(self)

    def cost(self, **options) -> DataFrame:
        from arcloom.operators.distance import cost

        return cost(self, **options)

    def push_weights(self, **options) -> Automaton:
        from arcloom.operators.push import push_weights

        return push_weights(self, **options)

    def remove_epsilons(self) -> Automaton:
        from arcloom.operators.epsilon import remove_epsilons

        return remove_epsilons(self)

    def determinize(self, **options) -> Automaton:
        from arcloom.operators.determinize import determinize

        return determinize(self, **options)

    def minimize(self, **options) -> Automaton:
        from arcloom.operators.minimize import minimize

        return minimize(self, **options)

    def k_best(self, k: int, **options) -> DataFrame:
        from arcloom.operators.kbest import k_best

        return k_best(self, k, **options)

    def __rshift__(self, other: Automaton) -> Automaton:
        from arcloom.operators.compose import compose

        return compose(self, other)

    def __and__(self, other: Automaton) -> Automaton:
        from arcloom.operators.compose import intersect

        return intersect(self, other)

    def __or__(self, other: Automaton) -> Automaton:
        from arcloom.operators.setops import union

        return union(self, other)
