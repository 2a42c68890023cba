"""Registered queries of the automata operators, over the driver's tables, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.functions.semiring import BOOLEAN, LOG, PROBABILITY, RINGS, TROPICAL
from arcloom.operators import select as sel
from arcloom.operators.collapse import neighbour_distances
from arcloom.operators.components import components
from arcloom.operators.compose import compose, dense_composer
from arcloom.operators.counts import chain_counts, expected_counts
from arcloom.operators.dense import block_distances, dense_blocks
from arcloom.operators.distance import Distances, all_pairs, all_path_distances, by_all_pairs, by_residuals
from arcloom.operators.generated import arcs_on_demand, compose_generated
from arcloom.operators.kbest import BestPaths, k_best, uniform
from arcloom.operators.minimize import Closeness, approximate, close_classes
from arcloom.operators.output import dot_lines, equal, fingerprint
from arcloom.operators.reach import is_cyclic, trim
from arcloom.operators.setops import batch_union
from arcloom.plans.iterate import settled
from arcloom.sources import constructors as make
from arcloom.sources import derived
from arcloom.sources.automaton import TEXT, Automaton
from arcloom.sources.generators import any_lengths, edits_to

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Common table expressions of the derived automata.
CH = "ch AS (SELECT CAST(user_id AS VARCHAR) AS auto_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS label FROM events)"
CV = "cv AS (SELECT CAST(conv_id AS VARCHAR) AS auto_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS label FROM conversations)"
LY = """ly AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_name AS ilabel, r_name AS olabel, (n_nationkey + 1) / 100.0::DOUBLE AS w FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_mktsegment, n_name, (c_custkey % 10 + 1) / 10.0::DOUBLE FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderstatus, c_mktsegment, o_totalprice / 1e6::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey)"""
NM = "nm AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name), px AS (SELECT name, n, i, substr(name, 1, i) AS p FROM nm, generate_series(0, 12) g(i) WHERE i <= length(name))"


def rounded(name: str = "weight", digits: int = 6) -> Column:
    return (F.round(name, digits) + F.lit(0.0)).alias(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def arcs_of(auto: Automaton, digits: int = 6) -> DataFrame:
    return auto.arcs.select("src", "dst", "ilabel", "olabel", rounded(digits=digits))


# Sources ---------------------------------------------------------------------------------------------------------------


@query("constant_chain", f"WITH {CH} SELECT auto_id, CAST(pos AS BIGINT) AS src, CAST(pos + 1 AS BIGINT) AS dst, label, 1.0::DOUBLE AS weight FROM ch")
def constant_chain(spark, sf):
    return make.chains(derived.event_steps(spark, sf), PROBABILITY).arcs.select("auto_id", "src", "dst", F.col("ilabel").alias("label"), "weight")


@query("layer_arcs", f"WITH {LY} SELECT src, dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly")
def layer_arcs(spark, sf):
    return arcs_of(derived.layers(spark, sf))


#: The alphabet of order states, its size, and the log weight of a match over it.
EDITS = """c AS (SELECT DISTINCT o_orderstatus AS x FROM orders UNION ALL SELECT ''), k AS (SELECT -ln((n - 1) * exp(-3.0::DOUBLE) + 1 + (n + 1) * exp(-4.0::DOUBLE)) AS m, n FROM (SELECT count(DISTINCT o_orderstatus) AS n FROM orders)),
ed AS (SELECT a.x AS i, b.x AS o, CASE WHEN a.x = '' OR b.x = '' THEN m - 4 WHEN a.x = b.x THEN m ELSE m - 3 END AS w FROM c a, c b, k WHERE a.x <> '' OR b.x <> '')"""


def letters_of(spark: SparkSession, sf: str, name: str, column: str) -> list[str]:
    """An alphabet: the distinct labels in a column of codes."""
    return [r[0] for r in derived.table(spark, sf, name).select(column).distinct().collect()]


def status_edits(spark: SparkSession, sf: str) -> Automaton:
    return make.edit_distance(spark, -3.0, -4.0, letters_of(spark, sf, "orders", "o_orderstatus"))


@query("edit_arcs", f"WITH {EDITS} SELECT i AS ilabel, o AS olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ed")
def edit_arcs(spark, sf):
    return status_edits(spark, sf).arcs.select("ilabel", "olabel", rounded())


def mean_length(steps: DataFrame) -> float:
    return steps.agg(F.count("*") / F.count_distinct("auto_id")).first()[0]


def event_decay(spark: SparkSession, sf: str) -> Automaton:
    """Lengths of the users' chains of events, as a geometric distribution."""
    return make.decay(spark, mean_length(derived.event_steps(spark, sf)), letters_of(spark, sf, "events", "event_type"))


DECAY = "de AS (SELECT count(*) / count(DISTINCT user_id)::DOUBLE AS e, count(DISTINCT event_type) AS n FROM events)"


@query("decay_cost", f"WITH {DECAY} SELECT 'decay' AS auto_id, round(ln(1 / (1 + e) / (1 - n * (e / (1 + e) / n))), 6) + 0.0::DOUBLE AS weight FROM de")
def decay_cost(spark, sf):
    return event_decay(spark, sf).cost().select("auto_id", rounded())


POISSON = """WITH m AS (SELECT count(*) / count(DISTINCT conv_id)::DOUBLE AS e FROM conversations), s AS (SELECT i, exp(i * ln(e) - e - ln(gamma(i + 1.0::DOUBLE))) AS p FROM generate_series(0, 4) g(i), m), l AS (SELECT 1 - sum(p) AS left_, sum(p) AS below FROM s)
SELECT 'poisson' AS auto_id, round(ln(below + {tail}), 6) + 0.0::DOUBLE AS weight FROM l"""


def turn_lengths(spark: SparkSession, sf: str, **options) -> Automaton:
    """Lengths of conversations, as a Poisson distribution up to five turns."""
    return make.poisson(spark, mean_length(derived.conversation_steps(spark, sf)), 5, letters_of(spark, sf, "conversations", "role"), **options)


@query("poisson_cost", POISSON.format(tail="left_ * 0.9 / (1 - left_ * 0.1)"))
def poisson_cost(spark, sf):
    return turn_lengths(spark, sf).cost().select("auto_id", rounded())


@query("poisson_cost_normalized", POISSON.format(tail="left_"))
def poisson_cost_normalized(spark, sf):
    return turn_lengths(spark, sf, normalized=True).cost().select("auto_id", rounded())


# Filters and projections -----------------------------------------------------------------------------------------------


@query("filter_arcs", f"WITH {CH} SELECT auto_id, CAST(pos AS BIGINT) AS src, label FROM ch WHERE label = 'click'")
def filter_arcs(spark, sf):
    kept = make.chains(derived.event_steps(spark, sf), PROBABILITY).filter_arcs(F.col("ilabel") == "click")
    return kept.edges().select("auto_id", "src", F.col("ilabel").alias("label"))


def matched(name: str, where: str, match: Callable[[], Column]) -> None:
    @query(name, f"WITH {LY} SELECT src, dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly WHERE {where}")
    def run(spark, sf):
        auto = derived.layers(spark, sf)
        return sel.edges_matching(auto, match()).select("src", "dst", "ilabel", "olabel", rounded())


matched("match_sigma", "src = 'n3'", lambda: sel.sigma("n3"))
matched("match_label", "src = 'n3' AND ilabel = 'BUILDING' AND olabel = 'BUILDING'", lambda: sel.label("n3", "BUILDING"))
matched("match_input", "src = 'n3' AND ilabel = 'BUILDING'", lambda: sel.input_label("n3", "BUILDING"))
matched("match_output", "src = 'c7' AND olabel = 'BUILDING'", lambda: sel.output_label("c7", "BUILDING"))


def matched_edits(name: str, where: str, match: Callable[[], Column]) -> None:
    @query(name, f"WITH {EDITS} SELECT i AS ilabel, o AS olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ed WHERE {where}")
    def run(spark, sf):
        return sel.edges_matching(status_edits(spark, sf), match()).select("ilabel", "olabel", rounded())


matched_edits("match_edit_sigma", "true", lambda: sel.sigma(0))
matched_edits("match_edit_input", "i = 'F'", lambda: sel.input_label(0, "F"))
matched_edits("match_edit_output", "o = ''", lambda: sel.output_label(0, ""))
matched_edits("match_edit_pair", "i = 'O' AND o = 'P'", lambda: sel.pair(0, "O", "P"))


@query("match_decay", f"WITH {DECAY} SELECT 'click' AS ilabel, round(ln(e / (1 + e)) - ln(n), 6) + 0.0::DOUBLE AS weight FROM de")
def match_decay(spark, sf):
    return sel.edges_matching(event_decay(spark, sf), sel.label(0, "click")).select("ilabel", rounded())


def without_building(spark: SparkSession, sf: str) -> Automaton:
    auto = derived.layers(spark, sf)
    return auto.with_arcs(auto.arcs.withColumn("weight", F.when(F.col("ilabel") == "BUILDING", 0.0).otherwise(F.col("weight"))))


@query("nonzero_arcs", f"WITH {LY} SELECT src, dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly WHERE ilabel <> 'BUILDING'")
def nonzero_arcs(spark, sf):
    return arcs_of(sel.nonzero(without_building(spark, sf)))


@query("transformed", f"WITH {LY} SELECT src, dst, olabel AS ilabel, ilabel AS olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly WHERE ilabel <> 'BUILDING'")
def transformed(spark, sf):
    return arcs_of(without_building(spark, sf).transform(sel.nonzero).transform(Automaton.swap_labels))


@query("integer_arcs", "SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(5 + n_nationkey AS BIGINT) AS dst, CAST(n_nationkey AS INTEGER) AS label, n_nationkey / 10.0::DOUBLE AS weight FROM nation")
def integer_arcs(spark, sf):
    """Regions and their nations as indexed sequences of arcs with integer labels."""
    rows = derived.table(spark, sf, "nation").select("n_regionkey", "n_nationkey").collect()
    n = 5 + max(r.n_nationkey for r in rows) + 1
    arcs = [[(5 + r.n_nationkey, r.n_nationkey, r.n_nationkey / 10.0) for r in rows if r.n_regionkey == s] for s in range(n)]
    auto = make.int_automaton(spark, TROPICAL, arcs, [0.0 if s < 5 else float("inf") for s in range(n)], [float("inf") if s < 5 else 0.0 for s in range(n)])
    return auto.edges().select("src", "dst", F.col("ilabel").alias("label"), "weight")


@query("edges_from", f"WITH {LY} SELECT src, dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly WHERE src = 'r1'")
def edges_from(spark, sf):
    return derived.layers(spark, sf).arcs_from("r1").select("src", "dst", "ilabel", "olabel", rounded())


def projected(name: str, columns: str, step: Callable[[Automaton], Automaton]) -> None:
    @query(name, f"WITH {LY} SELECT src, dst, {columns}, round(w, 6) + 0.0::DOUBLE AS weight FROM ly")
    def run(spark, sf):
        return arcs_of(step(derived.layers(spark, sf)))


projected("as_transducer", "ilabel, ilabel AS olabel", Automaton.as_transducer)
projected("swap_labels", "olabel AS ilabel, ilabel AS olabel", Automaton.swap_labels)
projected("input_projection", "ilabel, ilabel AS olabel", Automaton.input_projection)
projected("output_projection", "olabel AS ilabel, olabel", Automaton.output_projection)


@query("reverse", f"""WITH {LY} SELECT dst AS src, src AS dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly
UNION ALL SELECT 'o' || o_orderkey, NULL, 'initial', NULL, 1.0::DOUBLE FROM orders UNION ALL SELECT 'r' || r_regionkey, NULL, 'final', NULL, 1.0::DOUBLE FROM region""")
def reverse(spark, sf):
    auto = derived.layers(spark, sf).reverse()
    none = F.lit(None).cast("string")
    ends = [x.select(F.col("state").alias("src"), none.alias("dst"), F.lit(n).alias("ilabel"), none.alias("olabel"), "weight") for x, n in ((auto.initial, "initial"), (auto.final, "final"))]
    return arcs_of(auto).unionByName(ends[0]).unionByName(ends[1])


@query("relabel", f"""WITH {LY}, st AS (SELECT src AS s FROM ly UNION SELECT dst FROM ly UNION SELECT 'r' || r_regionkey FROM region UNION SELECT 'o' || o_orderkey FROM orders), d AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS n FROM st)
SELECT CAST(a.n AS BIGINT) AS src, CAST(b.n AS BIGINT) AS dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly JOIN d a ON src = a.s JOIN d b ON dst = b.s""")
def relabel(spark, sf):
    return arcs_of(derived.layers(spark, sf).relabel())


BG = f"""{CH}, nx AS (SELECT auto_id, pos, label, lead(label) OVER (PARTITION BY auto_id ORDER BY pos) AS next FROM ch), pr AS (SELECT label, next, count(*) AS n FROM nx GROUP BY 1, 2),
bg AS (SELECT label, next, n / sum(n) OVER (PARTITION BY label) AS w FROM pr)"""


@query("union", f"""WITH {LY}, {BG} SELECT CAST(0 AS TINYINT) AS side, src, dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly
UNION ALL SELECT CAST(1 AS TINYINT), label, next, next, next, round(w, 6) + 0.0::DOUBLE FROM bg WHERE next IS NOT NULL""")
def union(spark, sf):
    both = derived.layers(spark, sf) | derived.markov(spark, sf)
    return both.arcs.select(F.col("src.side").alias("side"), F.col("src.s").alias("src"), F.col("dst.s").alias("dst"), "ilabel", "olabel", rounded())


@query("union_cost", "SELECT p_name AS auto_id, round(2.0::DOUBLE * count(*), 6) AS weight FROM part GROUP BY p_name")
def union_cost(spark, sf):
    names = derived.weighted_names(spark, sf)
    return (names | names).cost().select("auto_id", rounded())


# Aggregates ------------------------------------------------------------------------------------------------------------

SUMS = {"probability": "round(sum(w), 6) + 0.0::DOUBLE", "tropical": "round(min(w), 6) + 0.0::DOUBLE", "log": "round(ln(sum(w)), 6) + 0.0::DOUBLE", "boolean": "bool_or(p > 200000)"}
SHORT = {"probability": "prob", "tropical": "trop", "log": "log", "boolean": "bool"}


def collapsed(name: str) -> None:
    ring = RINGS[name]
    source = "SELECT o_orderstatus AS src, o_orderpriority AS dst, CAST(o_orderkey % 3 AS VARCHAR) AS label, o_totalprice / 1e6::DOUBLE AS w, o_totalprice AS p FROM orders"

    @query(f"collapse_edges_{SHORT[name]}", f"SELECT src, dst, label, {SUMS[name]} AS weight FROM ({source}) GROUP BY src, dst, label")
    def run(spark, sf):
        found = derived.order_graph(spark, sf, ring).collapse_edges().arcs.select("src", "dst", F.col("ilabel").alias("label"), "weight")
        return found if name == "boolean" else found.withColumn("weight", rounded())

    @query(f"neighbour_distances_{SHORT[name]}", f"SELECT src, dst, {SUMS[name]} AS weight FROM ({source}) GROUP BY src, dst")
    def near(spark, sf):
        found = neighbour_distances(derived.order_graph(spark, sf, ring)).select("src", "dst", "weight")
        return found if name == "boolean" else found.withColumn("weight", rounded())


for _ring in RINGS:
    collapsed(_ring)



@query("reachable_states", f"WITH RECURSIVE {LY}, up(s) AS (SELECT 'r1' UNION SELECT dst FROM up JOIN ly ON src = s) SELECT s AS state FROM up")
def reachable_states(spark, sf):
    return derived.layers(spark, sf, regions="r_regionkey = 1").states().select("state")


@query("accessible_arcs", f"WITH RECURSIVE {LY}, up(s) AS (SELECT 'r1' UNION SELECT dst FROM up JOIN ly ON src = s) SELECT src, dst, ilabel, olabel, round(w, 6) + 0.0::DOUBLE AS weight FROM ly JOIN up ON src = s")
def accessible_arcs(spark, sf):
    return derived.layers(spark, sf, regions="r_regionkey = 1").edges().select("src", "dst", "ilabel", "olabel", rounded())


@query("trim", f"""WITH RECURSIVE {LY}, up(s) AS (SELECT 'r1' UNION SELECT dst FROM up JOIN ly ON src = s), down(s) AS (SELECT 'o' || o_orderkey FROM orders UNION SELECT src FROM down JOIN ly ON dst = s)
SELECT src, dst FROM ly WHERE src IN (SELECT s FROM up) AND dst IN (SELECT s FROM down)""")
def trim_query(spark, sf):
    return trim(derived.layers(spark, sf, regions="r_regionkey = 1")).arcs.select("src", "dst")


@query("is_cyclic", f"""WITH RECURSIVE {LY}, {CH}, nx AS (SELECT label, lead(label) OVER (PARTITION BY auto_id ORDER BY pos) AS next FROM ch),
e AS (SELECT DISTINCT 'bg' AS g, label AS a, next AS b FROM nx WHERE next <> label UNION SELECT DISTINCT 'ly', src[1], dst[1] FROM ly), r(g, a, b) AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON r.g = e.g AND r.b = e.a)
SELECT g AS auto_id, bool_or(a = b) AS cyclic FROM r GROUP BY g""")
def is_cyclic_query(spark, sf):
    a, b = derived.markov(spark, sf), derived.layers(spark, sf)
    both = Automaton(a.arcs.unionByName(b.arcs), a.initial.unionByName(b.initial), a.final.unionByName(b.final), PROBABILITY)
    return is_cyclic(both)


PATHS = """p1 AS (SELECT 'r' || r_regionkey AS s, 1.0::DOUBLE AS w FROM region), p2 AS (SELECT dst AS s, p1.w * ly.w AS w, ly.w AS t FROM p1 JOIN ly ON src = s),
p3 AS (SELECT dst AS s, p2.w * ly.w AS w, p2.t + ly.w AS t FROM p2 JOIN ly ON src = s), p4 AS (SELECT dst AS s, p3.w * ly.w AS w, p3.t + ly.w AS t FROM p3 JOIN ly ON src = s),
pa AS (SELECT s, w, 0.0::DOUBLE AS t FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)"""
FORWARD = {"probability": "round(sum(w), 6)", "tropical": "round(min(t), 9)", "log": "round(ln(sum(w)), 6)"}


def forward(name: str) -> None:
    @query(f"forward_{SHORT[name]}", f"WITH {LY}, {PATHS} SELECT s AS state, {FORWARD[name]} + 0.0::DOUBLE AS weight FROM pa GROUP BY s")
    def run(spark, sf):
        return all_path_distances(derived.layers(spark, sf, RINGS[name])).select("state", rounded(digits=9 if name == "tropical" else 6))

    @query(f"cost_{SHORT[name]}", f"WITH {LY}, {PATHS} SELECT 'ly' AS auto_id, {FORWARD[name]} + 0.0::DOUBLE AS weight FROM p4")
    def total(spark, sf):
        return derived.layers(spark, sf, RINGS[name]).cost().select("auto_id", rounded(digits=9 if name == "tropical" else 6))


for _ring in FORWARD:
    forward(_ring)


@query("cost_bool", "SELECT 'ly' AS auto_id, count(*) > 0 AS weight FROM orders")
def cost_bool(spark, sf):
    return derived.layers(spark, sf, BOOLEAN).cost()


@query("cost_by_all_pairs", f"WITH {CV} SELECT auto_id, count(*)::DOUBLE AS weight FROM cv GROUP BY auto_id")
def cost_by_all_pairs(spark, sf):
    """The tropical cost of chains whose arcs weigh one: their length, by the all-pairs strategy."""
    auto = make.chains(derived.conversation_steps(spark, sf), TROPICAL)
    return auto.with_arcs(auto.arcs.withColumn("weight", F.lit(1.0))).cost(distances=by_all_pairs).select("auto_id", "weight")


@query("cost_markov", "SELECT 'bg' AS auto_id, 1.0::DOUBLE AS weight")
def cost_markov(spark, sf):
    return derived.markov(spark, sf).cost().select("auto_id", rounded())


@query("all_pairs", f"""WITH {LY}, top AS (SELECT * FROM ly WHERE dst[1] <> 'o'), st AS (SELECT src AS s FROM top UNION SELECT dst FROM top UNION SELECT 'r' || r_regionkey FROM region UNION SELECT 'c' || c_custkey FROM customer),
al AS (SELECT s AS src, s AS dst, 1.0::DOUBLE AS w FROM st UNION ALL SELECT src, dst, w FROM top UNION ALL SELECT a.src, b.dst, a.w * b.w FROM top a JOIN top b ON a.dst = b.src)
SELECT src, dst, round(sum(w), 6) + 0.0::DOUBLE AS weight FROM al GROUP BY src, dst""")
def all_pairs_query(spark, sf):
    return all_pairs(derived.layers(spark, sf, orders=False)).select("src", "dst", rounded())


RT = """rk AS (SELECT c_custkey AS c, c_nationkey AS n, (c_custkey % 10 + 1) / 10.0::DOUBLE AS w FROM customer JOIN nation ON c_nationkey = n_nationkey),
ro AS (SELECT o_custkey AS c, o_orderkey AS o, o_totalprice / 1e6::DOUBLE AS w, (o_orderkey % 7 + 1) / 1000.0::DOUBLE AS r FROM orders JOIN customer ON o_custkey = c_custkey),
rl AS (SELECT c, 1 / (1 - sum(w * r)) AS l FROM ro GROUP BY c)"""


@query("components", f"WITH {RT} SELECT 'c' || c AS state, 'c' || c AS root FROM rl UNION ALL SELECT 'o' || o, 'c' || c FROM ro")
def components_query(spark, sf):
    """A customer with its orders is one component; customers without orders and nations are none."""
    return components(derived.returns(spark, sf).arcs).select("state", "root")


def with_cycles(name: str, value: str, how: Distances, suffix: str = "") -> None:
    """Distances and cost on the graph of returns. value: a customer's sum, from its own arc's weight rk.w and its cycle's closure l."""
    ring = RINGS[name]
    step, digits = {"tropical": "f.w + ro.w", "log": "f.w + ln(ro.w)"}.get(name, "f.w * ro.w"), 9 if name == "tropical" else 6
    total = {"tropical": "min(w)", "log": "ln(sum(exp(w)))"}.get(name, "sum(w)")
    sums = f"WITH {RT}, f AS (SELECT rk.c, {value} AS w FROM rk LEFT JOIN rl ON rk.c = rl.c), fo AS (SELECT o, {step} AS w FROM ro JOIN f ON ro.c = f.c)"
    unit = "0.0" if name in ("tropical", "log") else "1.0"

    @query(f"forward_cycles_{SHORT[name]}{suffix}", f"{sums} SELECT state, round(w, {digits}) + 0.0::DOUBLE AS weight FROM (SELECT 'n' || n_nationkey AS state, {unit}::DOUBLE AS w FROM nation UNION ALL SELECT 'c' || c, w FROM f UNION ALL SELECT 'o' || o, w FROM fo)")
    def run(spark, sf):
        return how(derived.returns(spark, sf, ring)).select("state", rounded(digits=digits))

    @query(f"cost_cycles_{SHORT[name]}{suffix}", f"{sums} SELECT 'rt' AS auto_id, round({total}, {digits}) + 0.0::DOUBLE AS weight FROM fo")
    def whole(spark, sf):
        return derived.returns(spark, sf, ring).cost(distances=how).select("auto_id", rounded(digits=digits))


with_cycles("probability", "rk.w * coalesce(l, 1)", all_path_distances)
with_cycles("log", "ln(rk.w * coalesce(l, 1))", all_path_distances)
with_cycles("tropical", "rk.w", by_residuals, "_residual")


@query("all_pairs_cycles", f"""WITH {RT}, pc AS (SELECT 'c' || c AS s, 'c' || c AS d, l AS w FROM rl UNION ALL SELECT 'c' || rl.c, 'o' || o, l * w FROM rl JOIN ro ON rl.c = ro.c UNION ALL SELECT 'o' || o, 'c' || rl.c, l * r FROM rl JOIN ro ON rl.c = ro.c
UNION ALL SELECT 'o' || a.o, 'o' || b.o, l * a.r * b.w + CASE WHEN a.o = b.o THEN 1 ELSE 0 END FROM rl JOIN ro a ON rl.c = a.c JOIN ro b ON rl.c = b.c UNION ALL SELECT 'c' || c, 'c' || c, 1.0 FROM rk WHERE c NOT IN (SELECT c FROM rl)),
pn AS (SELECT 'n' || n AS s, d, rk.w * pc.w AS w FROM rk JOIN pc ON pc.s = 'c' || rk.c UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 1.0 FROM nation)
SELECT s AS src, d AS dst, round(w, 6) + 0.0::DOUBLE AS weight FROM pc UNION ALL SELECT s, d, round(w, 6) + 0.0::DOUBLE FROM pn""")
def all_pairs_cycles(spark, sf):
    return all_pairs(derived.returns(spark, sf)).select("src", "dst", rounded())


# Joins -----------------------------------------------------------------------------------------------------------------


@query("all_pairs_dense", f"""WITH {LY}, st AS (SELECT src AS s FROM ly UNION SELECT dst FROM ly UNION SELECT 'r' || r_regionkey FROM region UNION SELECT 'c' || c_custkey FROM customer),
tw AS (SELECT a.src, b.dst, a.w * b.w AS w FROM ly a JOIN ly b ON a.dst = b.src),
al AS (SELECT s AS src, s AS dst, 1.0::DOUBLE AS w FROM st UNION ALL SELECT src, dst, w FROM ly UNION ALL SELECT * FROM tw UNION ALL SELECT a.src, b.dst, a.w * b.w FROM tw a JOIN ly b ON a.dst = b.src)
SELECT src, dst, round(sum(w), 12) + 0.0::DOUBLE AS weight FROM al GROUP BY src, dst""")
def all_pairs_dense(spark, sf):
    """All pairs of the whole layered graph, with its orders, by products of blocks."""
    return block_distances(dense_blocks(derived.layers(spark, sf))).select("src", "dst", rounded(digits=12))


@query("compose_chain", "WITH nm AS (SELECT DISTINCT p_name FROM part) SELECT p_name AS auto_id, CAST(i - 1 AS BIGINT) AS src, CAST(i AS BIGINT) AS dst, substr(p_name, i, 1) AS ilabel, upper(substr(p_name, i, 1)) AS olabel, 0.5::DOUBLE AS weight FROM nm, generate_series(1, 12) g(i) WHERE i <= length(p_name)")
def compose_chain(spark, sf):
    steps = derived.name_steps(spark, sf)
    letters = steps.select("label").distinct()
    flat = letters.select(F.lit("up").alias("auto_id"), F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.col("label").alias("ilabel"), F.upper("label").alias("olabel"), F.lit(0.5).alias("weight"))
    ends = spark.createDataFrame([("up", 0, 1.0)], "auto_id string, state long, weight double")
    both = make.chains(steps, PROBABILITY) >> make.from_frames(flat, ends, ends, PROBABILITY, shared=True)
    return both.arcs.select("auto_id", F.col("src.l").alias("src"), F.col("dst.l").alias("dst"), "ilabel", "olabel", "weight")


@query("intersect_chain", f"""WITH {CV}, ok AS (SELECT *, min(CASE WHEN label = 'system' THEN 0 ELSE 1 END) OVER (PARTITION BY auto_id ORDER BY pos) AS live FROM cv)
SELECT auto_id, CAST(pos AS BIGINT) AS src, CAST(pos + 1 AS BIGINT) AS dst, label FROM ok WHERE live = 1""")
def intersect_chain(spark, sf):
    steps = derived.conversation_steps(spark, sf)
    other = steps.withColumn("label", F.when(F.col("label") == "system", F.lit("user")).otherwise(F.col("label")))
    both = make.chains(steps, BOOLEAN) & make.chains(other, BOOLEAN)
    return both.arcs.select("auto_id", F.col("src.l").alias("src"), F.col("dst.l").alias("dst"), F.col("ilabel").alias("label"))


def silent_users(spark: SparkSession, sf: str) -> tuple[Automaton, Automaton]:
    """Chains of roles that write nothing where the user speaks, and a copier of one state that reads what is written."""
    chain = make.chains(derived.conversation_steps(spark, sf), PROBABILITY)
    left = chain.with_arcs(chain.arcs.withColumn("olabel", F.when(F.col("ilabel") == "user", F.lit("")).otherwise(F.col("olabel"))).withColumn("weight", F.lit(0.5)))
    roles = [r for r in letters_of(spark, sf, "conversations", "role") if r != "user"]
    copier = make.transducer(spark, PROBABILITY, {0: 1.0}, {0: 1.0}, [make.arc(0, 0, r, 0.25, r.upper()) for r in roles])
    return left, Automaton(copier.arcs, copier.initial, copier.final, PROBABILITY, shared=True)


SILENT = f"""WITH {CV}, st AS (SELECT auto_id, pos, label, coalesce(lag(label) OVER (PARTITION BY auto_id ORDER BY pos), '') AS prev FROM cv),
sa AS (SELECT auto_id, CAST(pos AS BIGINT) AS sl, CAST(0 AS BIGINT) AS sr, CAST(prev = 'user' AS TINYINT) AS se, CAST(pos + 1 AS BIGINT) AS dl, CAST(0 AS BIGINT) AS dr, CAST(label = 'user' AS TINYINT) AS de, label AS ilabel, CASE WHEN label = 'user' THEN '' ELSE upper(label) END AS olabel FROM st)"""


def marking(spark: SparkSession, sf: str) -> tuple[Automaton, Automaton]:
    """Silent users, and a copier that once, at any place, writes a mark for which it reads nothing."""
    left, copier = silent_users(spark, sf)
    roles = [r.ilabel for r in copier.arcs.select("ilabel").collect()]
    copies = [make.arc(k, k, r, 0.25, r.upper()) for k in (0, 1) for r in roles]
    right = make.transducer(spark, PROBABILITY, {0: 1.0}, {1: 1.0}, [*copies, make.arc(0, 1, "", 0.5, "|")])
    return left, Automaton(right.arcs, right.initial, right.final, PROBABILITY, shared=True)


# at each place: which states the mark's writer and the filter may be in (s0: unmarked, its e; s2: marked alone just before; s10, s11: marked before that)
MARKED = f"""WITH {CV}, ends AS (SELECT * FROM cv UNION ALL SELECT auto_id, max(pos) + 1, NULL FROM cv GROUP BY auto_id),
st AS (SELECT auto_id, CAST(pos AS BIGINT) AS l, label, coalesce(label = 'user', false) AS quiet, CASE WHEN label = 'user' THEN '' ELSE upper(label) END AS olabel,
  coalesce(lag(label) OVER w = 'user', false) AS p, coalesce(lag(label, 2) OVER w = 'user', false) AS pp FROM ends WINDOW w AS (PARTITION BY auto_id ORDER BY pos)),
arcs AS (
  SELECT auto_id, l, 0 AS sr, CAST(p AS INT) AS se, l + 1 AS dl, 0 AS dr, CAST(quiet AS INT) AS de, label AS ilabel, olabel FROM st WHERE label IS NOT NULL
  UNION ALL SELECT auto_id, l, 0, 0, l + 1, 1, 0, label, '|' FROM st WHERE quiet AND NOT p
  UNION ALL SELECT auto_id, l, 0, 0, l, 1, 2, '', '|' FROM st WHERE NOT p
  UNION ALL SELECT auto_id, l, 1, 2, l + 1, 1, 0, label, olabel FROM st WHERE label IS NOT NULL AND NOT quiet AND NOT p
  UNION ALL SELECT auto_id, l, 1, 0, l + 1, 1, CAST(quiet AS INT), label, olabel FROM st WHERE label IS NOT NULL AND l >= 1 AND NOT (p AND pp)
  UNION ALL SELECT auto_id, l, 1, 1, l + 1, 1, CAST(quiet AS INT), label, olabel FROM st WHERE label IS NOT NULL AND l >= 2 AND p)"""


@query("compose_epsilon", f"{MARKED} SELECT auto_id, l AS sl, CAST(sr AS BIGINT) AS sr, CAST(se AS TINYINT) AS se, dl, CAST(dr AS BIGINT) AS dr, CAST(de AS TINYINT) AS de, ilabel, olabel FROM arcs")
def compose_epsilon(spark, sf):
    """Each side moves alone, and both at once, on epsilon: all that the filter tells apart."""
    a, b = marking(spark, sf)
    return (a >> b).arcs.select("auto_id", *[F.col(f"{s}.{c}").alias(f"{s[0]}{c}") for s in ("src", "dst") for c in "lre"], "ilabel", "olabel")


@query("compose_dense", f"{SILENT} SELECT auto_id, CAST(se + 3 * (sl + 1000 * sr) AS BIGINT) AS src, CAST(de + 3 * (dl + 1000 * dr) AS BIGINT) AS dst, ilabel, olabel FROM sa")
def compose_dense(spark, sf):
    a, b = silent_users(spark, sf)
    return compose(a, b, composer=dense_composer(1000)).arcs.select("auto_id", "src", "dst", "ilabel", "olabel")


@query("compose_weigh", f"{SILENT} SELECT ilabel, CASE WHEN ilabel = 'user' THEN 1.5 ELSE 0.75 END::DOUBLE AS weight, count(*) AS n FROM sa GROUP BY ilabel")
def compose_weigh(spark, sf):
    a, b = silent_users(spark, sf)
    both = compose(a, b, weigh=lambda i, m, o, x, y: x + y)
    return both.arcs.groupBy("ilabel", "weight").agg(F.count("*").alias("n"))


# Edit distance ---------------------------------------------------------------------------------------------------------


@query("edit_distance_trop", "WITH t AS (SELECT DISTINCT event_type AS x FROM events) SELECT a.x AS a, b.x AS b, CAST(levenshtein(a.x, b.x) AS BIGINT) AS distance FROM t a, t b")
def edit_distance_trop(spark, sf):
    names = settled(derived.table(spark, sf, "events").select(F.col("event_type").alias("a")).distinct())
    pairs = names.crossJoin(names.withColumnRenamed("a", "b")).withColumn("auto_id", F.concat_ws("|", "a", "b"))  # the five types with themselves
    side = lambda c: make.chains(make.spelled(pairs, "auto_id", c), TROPICAL)
    letters = "".join(r.a for r in names.collect())
    total = (side("a") >> make.unit_edits(spark, letters, TROPICAL) >> side("b")).cost()
    return total.join(pairs, "auto_id").select("a", "b", F.col("weight").cast("long").alias("distance"))


@query("generated_edits", "WITH t AS (SELECT DISTINCT p_name AS x FROM part) SELECT a.x AS a, b.x AS b, CAST(levenshtein(a.x, b.x) AS BIGINT) AS distance FROM t a JOIN t b ON levenshtein(a.x, b.x) <= 3")
def generated_edits(spark, sf):
    """Each part name with the names at most three edits away. Only names of near lengths meet; edits' arcs are made on demand."""
    names = derived.table(spark, sf, "part").select(F.col("p_name").alias("auto_id"), F.char_length("p_name").alias("n")).distinct()
    words = names.select(F.col("auto_id").alias("word"), F.explode(F.sequence(F.col("n") - 3, F.col("n") + 3)).alias("n"))
    made = compose_generated(make.chains(derived.name_steps(spark, sf), TROPICAL), edits_to(names.join(words, "n"), 3))
    return made.final.groupBy(F.col("auto_id").alias("a"), F.col("state.r.word").alias("b")).agg(F.min("state.r.edits").cast("long").alias("distance"))  # final states tell their edits


@query("generated_arcs", f"""WITH {NM}, s AS (SELECT DISTINCT name, i AS place, substr(name, i + 1, 1) AS c FROM px WHERE i < length(name))
SELECT name, place, place + 1 AS to_place, 0 AS edits, c AS ilabel, c AS olabel, 0.0::DOUBLE AS weight FROM s UNION ALL SELECT name, place, place, 1, c, '', 1.0 FROM s
UNION ALL SELECT name, place, place + 1, 1, upper(c), c, 1.0 FROM s WHERE c <> upper(c) UNION ALL SELECT name, place, place, 1, upper(c), '', 1.0 FROM s WHERE c <> upper(c) UNION ALL SELECT name, place, place + 1, 1, '', c, 1.0 FROM s""")
def generated_arcs(spark, sf):
    """What leaves each place of each part name on its own letter, that letter's capital and no letter: arcs that no table lists."""
    steps = derived.name_steps(spark, sf)
    towards = edits_to(steps.select("auto_id", F.col("auto_id").alias("word")), 1)
    labels = F.array_distinct(F.array("label", F.upper("label"), F.lit("")))
    state = F.struct(F.col("auto_id").alias("word"), F.col("pos").cast("int").alias("at"), F.lit(0).alias("edits"))
    arcs = arcs_on_demand(towards, steps.select("auto_id", state.alias("state"), F.explode(labels).alias("label")))
    return arcs.select(F.col("auto_id").alias("name"), F.col("src.at").cast("long").alias("place"), F.col("dst.at").cast("long").alias("to_place"), F.col("dst.edits").alias("edits"), "ilabel", "olabel", "weight")


@query("generated_decay", f"WITH {CV}, de AS (SELECT count(*) / count(DISTINCT conv_id)::DOUBLE AS e, count(DISTINCT role) AS n FROM conversations) SELECT auto_id, round(count(*) * (ln(e / (1 + e)) - ln(n)) + ln(1 / (1 + e)), 6) + 0.0::DOUBLE AS weight FROM cv, de GROUP BY auto_id, e, n")
def generated_decay(spark, sf):
    """The log probability of each conversation's chain of roles under geometric lengths, roles uniform."""
    steps = derived.conversation_steps(spark, sf)
    size = steps.agg(F.count_distinct("label")).first()[0]
    return compose_generated(make.chains(steps, LOG, 0.0), any_lengths(spark, mean_length(steps), size)).cost().select("auto_id", rounded())


@query("edit_distance_mass", "SELECT o_orderpriority AS auto_id, round(ln(count(*) / count(*)), 6) + 0.0::DOUBLE AS weight FROM orders GROUP BY o_orderpriority")
def edit_distance_mass(spark, sf):
    """All inputs together have a mass of one for any output, here for each order priority."""
    texts = derived.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("t")).distinct()
    steps = make.spelled(texts, "t", "t")
    letters = [r[0] for r in steps.select("label").distinct().collect()]  # an alphabet
    return (make.edit_distance(spark, -3.0, -4.0, letters) >> make.chains(steps, LOG)).cost().select("auto_id", rounded())


@query("edit_distance_logsum", """WITH RECURSIVE al AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest(string_split(r_name, '')) AS x FROM region)), k AS (SELECT 1 / ((n - 1) * exp(-3.0::DOUBLE) + 1 + (n + 1) * exp(-4.0::DOUBLE)) AS m, n FROM al),
w AS (SELECT a.r_name AS a, b.r_name AS b FROM region a, region b),
p(a, b, i, j, v) AS (SELECT a, b, 0, 0, 1.0::DOUBLE FROM w UNION ALL
SELECT a, b, i + d.di, j + d.dj, v * (SELECT m FROM k) * CASE WHEN d.di + d.dj = 1 THEN exp(-4.0::DOUBLE) WHEN substr(a, i + 1, 1) = substr(b, j + 1, 1) THEN 1.0 ELSE exp(-3.0::DOUBLE) END
FROM p, (VALUES (0, 1), (1, 0), (1, 1)) d(di, dj) WHERE i + d.di <= length(a) AND j + d.dj <= length(b))
SELECT a || '|' || b AS auto_id, round(ln(sum(v) * (1 - (SELECT n FROM k) * exp(-4.0::DOUBLE) * (SELECT m FROM k))), 6) + 0.0::DOUBLE AS weight FROM p WHERE i = length(a) AND j = length(b) GROUP BY a, b""")
def edit_distance_logsum(spark, sf):
    names = derived.table(spark, sf, "region").select(F.col("r_name").alias("a"))
    pairs = names.crossJoin(names.withColumnRenamed("a", "b")).withColumn("auto_id", F.concat_ws("|", "a", "b"))  # the five regions with themselves
    side = lambda c: make.chains(make.spelled(pairs, "auto_id", c), LOG)
    letters = [r[0] for r in make.spelled(names, "a", "a").select("label").distinct().collect()]  # an alphabet
    return (side("a") >> make.edit_distance(spark, -3.0, -4.0, letters) >> side("b")).cost().select("auto_id", rounded())


# Expected counts -------------------------------------------------------------------------------------------------------

LAST = "SELECT auto_id, label, pos FROM (SELECT *, row_number() OVER (PARTITION BY auto_id ORDER BY pos DESC) AS back FROM {t}) WHERE back = 1"


def bigram_sql(t: str, cte: str) -> str:
    return f"""WITH {cte}, steps AS (SELECT coalesce(lag(label) OVER (PARTITION BY auto_id ORDER BY pos), '#') AS src, label AS dst, label FROM {t} UNION ALL SELECT label, '', '' FROM ({LAST.format(t=t)}))
SELECT src, dst, label, round(CAST(count(*) AS DOUBLE), 6) AS weight FROM steps GROUP BY 1, 2, 3"""


def positional_sql(t: str, cte: str, n: int) -> str:
    return f"""WITH {cte}, steps AS (SELECT least(pos, {n - 1}) AS src, least(pos + 1, {n - 1}) AS dst, label FROM {t} UNION ALL SELECT least(pos + 1, {n - 1}), -1, '' FROM ({LAST.format(t=t)}))
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, label, round(CAST(count(*) AS DOUBLE), 6) AS weight FROM steps GROUP BY 1, 2, 3"""


@query("expected_bigram", bigram_sql("ch", CH))
def expected_bigram(spark, sf):
    return chain_counts(derived.event_steps(spark, sf), PROBABILITY, "bigram").withColumn("weight", rounded())


@query("expected_unigram", f"""WITH {CH} SELECT CAST(1 AS BIGINT) AS src, CAST(1 AS BIGINT) AS dst, label, CAST(count(*) AS DOUBLE) AS weight FROM ch GROUP BY label
UNION ALL SELECT 1, 0, '', CAST(count(DISTINCT auto_id) AS DOUBLE) FROM ch""")
def expected_unigram(spark, sf):
    return chain_counts(derived.event_steps(spark, sf), PROBABILITY, "unigram").withColumn("weight", rounded())


@query("expected_positional", positional_sql("ch", CH, 10))
def expected_positional(spark, sf):
    return chain_counts(derived.event_steps(spark, sf), PROBABILITY, "positional", longest=10).withColumn("weight", rounded())


@query("expected_bigram_general", bigram_sql("cv", CV))
def expected_bigram_general(spark, sf):
    steps = derived.conversation_steps(spark, sf)
    template = make.bigram_template(spark, "#", steps.select("label"))
    return expected_counts(make.chains(steps, PROBABILITY), template).withColumn("weight", rounded())


@query("expected_positional_general", positional_sql("cv", CV, 3))
def expected_positional_general(spark, sf):
    steps = derived.conversation_steps(spark, sf)
    template = make.positional_template(spark, steps.select("label"), 3)
    return expected_counts(make.chains(steps, PROBABILITY), template).withColumn("weight", rounded())


@query("expected_unigram_general", f"""WITH {CV} SELECT CAST(1 AS BIGINT) AS src, CAST(1 AS BIGINT) AS dst, label, round(ln(CAST(count(*) AS DOUBLE)), 6) + 0.0::DOUBLE AS weight FROM cv GROUP BY label
UNION ALL SELECT 1, 0, '', round(ln(CAST(count(DISTINCT auto_id) AS DOUBLE)), 6) + 0.0::DOUBLE FROM cv""")
def expected_unigram_general(spark, sf):
    steps = derived.conversation_steps(spark, sf)
    template = make.unigram_template(spark, steps.select("label"), LOG)
    return expected_counts(make.chains(steps, LOG), template).withColumn("weight", rounded())


# Structure -------------------------------------------------------------------------------------------------------------


@query("push_weights", f"""WITH {LY}, b3 AS (SELECT src AS s, sum(w) AS b FROM ly WHERE src[1] = 'c' GROUP BY 1), b2 AS (SELECT src AS s, sum(w * b) AS b FROM ly JOIN b3 ON dst = s WHERE src[1] = 'n' GROUP BY 1),
b1 AS (SELECT src AS s, sum(w * b) AS b FROM ly JOIN b2 ON dst = s WHERE src[1] = 'r' GROUP BY 1), bb AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT 'o' || o_orderkey, 1.0::DOUBLE FROM orders)
SELECT src, dst, round(w * d.b / u.b, 6) + 0.0::DOUBLE AS weight FROM ly JOIN bb u ON src = u.s JOIN bb d ON dst = d.s UNION ALL SELECT s, NULL, round(b, 6) + 0.0::DOUBLE FROM b1""")
def push_weights(spark, sf):
    pushed = derived.layers(spark, sf).push_weights()
    start = pushed.initial.select(F.col("state").alias("src"), F.lit(None).cast("string").alias("dst"), rounded())
    return pushed.arcs.select("src", "dst", rounded()).unionByName(start)


@query("remove_epsilons", f"""WITH {CH}, nx AS (SELECT auto_id, pos, min(CASE WHEN label <> 'error' THEN pos END) OVER (PARTITION BY auto_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM ch)
SELECT nx.auto_id, CAST(nx.pos AS BIGINT) AS src, CAST(q + 1 AS BIGINT) AS dst, ch.label FROM nx JOIN ch ON ch.auto_id = nx.auto_id AND ch.pos = q""")
def remove_epsilons(spark, sf):
    steps = derived.event_steps(spark, sf).withColumn("label", F.when(F.col("label") == "error", F.lit("")).otherwise(F.col("label")))
    return make.chains(steps, PROBABILITY).remove_epsilons().arcs.select("auto_id", "src", "dst", F.col("ilabel").alias("label"))


@query("remove_epsilon_cycles", f"""WITH {RT}, rs AS (SELECT ro.c, l, sum(w) AS s FROM ro JOIN rl ON ro.c = rl.c GROUP BY ro.c, l)
SELECT 'c' || c AS state, round(l * s, 6) + 0.0::DOUBLE AS weight FROM rs UNION ALL SELECT 'o' || o, round(1 + r * l * s, 6) + 0.0::DOUBLE FROM ro JOIN rs ON ro.c = rs.c
UNION ALL SELECT 'n' || n || ' c' || c, round(w, 6) + 0.0::DOUBLE FROM rk""")
def remove_epsilon_cycles(spark, sf):
    """Customers and orders in cycles of empty labels: what is left are the arcs from nations, and final weights."""
    auto = derived.returns(spark, sf)
    quiet = auto.with_arcs(auto.arcs.withColumn("ilabel", F.when(F.col("src").startswith("n"), F.col("ilabel")).otherwise(F.lit(""))).withColumn("olabel", F.col("ilabel"))).remove_epsilons()
    return quiet.final.select("state", rounded()).unionByName(quiet.arcs.select(F.concat_ws(" ", "src", "dst").alias("state"), rounded()))


def shape(auto: Automaton, weights: bool = False) -> DataFrame:
    """What a graph's states' names don't matter to: arcs by label (and weight), final states and states."""
    auto = Automaton(auto.arcs, auto.initial, auto.final, auto.ring)
    w = rounded() if weights else F.lit(0.0).alias("weight")
    arcs = auto.arcs.select(F.col("ilabel").alias("label"), w)
    final = auto.final.select(F.lit("#final").alias("label"), w)
    states = auto.arc_states().select(F.lit("#state").alias("label"), F.lit(0.0).alias("weight"))
    return arcs.unionByName(final).unionByName(states).groupBy("label", "weight").agg(F.count("*").alias("n"))


@query("determinize_trie", f"""WITH {NM}, d AS (SELECT DISTINCT p FROM px) SELECT label, 0.0::DOUBLE AS weight, count(*) AS n FROM (SELECT right(p, 1) AS label FROM d WHERE p <> '' UNION ALL SELECT '#state' FROM d UNION ALL SELECT '#final' FROM nm) GROUP BY label""")
def determinize_trie(spark, sf):
    names = batch_union(make.chains(derived.name_steps(spark, sf), BOOLEAN))
    return shape(names.determinize())


WTRIE = f"""{NM}, s AS (SELECT p, sum(n) AS total, sum(CASE WHEN p = name THEN n ELSE 0 END) AS own FROM px GROUP BY p),
tr AS (SELECT p, right(p, 1) AS label, CASE WHEN length(p) = 1 THEN CAST(total AS DOUBLE) ELSE total / (SELECT u.total FROM s u WHERE u.p = left(s.p, length(s.p) - 1))::DOUBLE END AS w, total, own FROM s WHERE p <> '')"""


@query("determinize_weighted", f"""WITH {WTRIE} SELECT label, round(w, 6) + 0.0::DOUBLE AS weight, count(*) AS n FROM (SELECT label, w FROM tr UNION ALL SELECT '#final', own / total::DOUBLE FROM tr WHERE own > 0 UNION ALL SELECT '#state', 0.0::DOUBLE FROM s) GROUP BY 1, 2""")
def determinize_weighted(spark, sf):
    return shape(batch_union(derived.weighted_names(spark, sf)).determinize(), weights=True)


@query("minimize_trie", f"""WITH {NM}, c AS (SELECT p, string_agg(substr(name, i + 1), '/' ORDER BY name) AS cls FROM px GROUP BY p), k AS (SELECT DISTINCT cls FROM c), a AS (SELECT DISTINCT u.cls, right(v.p, 1) AS label FROM c v JOIN c u ON u.p = left(v.p, length(v.p) - 1) WHERE v.p <> '')
SELECT label, 0.0::DOUBLE AS weight, count(*) AS n FROM (SELECT label FROM a UNION ALL SELECT '#state' FROM k UNION ALL SELECT '#final' FROM k WHERE '/' || cls || '/' LIKE '%//%' OR cls = '') GROUP BY label""")
def minimize_trie(spark, sf):
    names = batch_union(make.chains(derived.name_steps(spark, sf), BOOLEAN))
    return shape(names.determinize().minimize())


@query("minimize_approx", f"""WITH {WTRIE}, q AS (SELECT p, label, round(w, 2) AS w, round(own / total::DOUBLE, 2) AS f FROM tr UNION ALL SELECT '', '', 0.0, 0.0),
c AS (SELECT u.p, string_agg(substr(v.p, length(u.p) + 1) || ':' || CASE WHEN v.p = u.p THEN 0.0::DOUBLE ELSE v.w END || ':' || v.f, '/' ORDER BY v.p) AS cls FROM q u JOIN q v ON starts_with(v.p, u.p) GROUP BY u.p)
SELECT count(DISTINCT cls) AS n_states FROM c""")
def minimize_approx(spark, sf):
    trie = batch_union(derived.weighted_names(spark, sf)).determinize()
    return trie.minimize(partitioner=approximate(2)).arc_states().agg(F.count("*").alias("n_states"))


@query("weight_classes", """WITH w AS (SELECT DISTINCT o_totalprice / 1e6::DOUBLE AS w FROM orders), g AS (SELECT w, w - lag(w) OVER (ORDER BY w) AS gap FROM w), c AS (SELECT w, sum(CASE WHEN gap <= 5e-6 THEN 0 ELSE 1 END) OVER (ORDER BY w) AS k FROM g)
SELECT round(w, 9) AS weight, round(min(w) OVER (PARTITION BY k), 9) AS least FROM c""")
def weight_classes(spark, sf):
    """The orders' weights in classes of closeness."""
    weights = derived.table(spark, sf, "orders").select(F.lit("a").alias("auto_id"), (F.col("o_totalprice") / 1e6).alias("weight"))
    return close_classes(weights, 5e-6).select(rounded(digits=9), rounded("least", 9))


@query("minimize_close", """WITH c AS (SELECT c_mktsegment AS label, 'c' || c_custkey AS s, (c_custkey % 10 + 1) / 10.0::DOUBLE + (c_custkey % 4) * 0.008::DOUBLE AS f FROM customer), d AS (SELECT f, f - lag(f) OVER (ORDER BY f) AS gap FROM (SELECT DISTINCT f FROM c)),
k AS (SELECT f, sum(CASE WHEN gap <= 0.01 THEN 0 ELSE 1 END) OVER (ORDER BY f) AS k FROM d), m AS (SELECT label, s, c.f, k.k FROM c JOIN k ON c.f = k.f), r AS (SELECT k, arg_min(f, s) AS f FROM m GROUP BY k)
SELECT label, round(r.f, 6) AS final, count(*)::DOUBLE AS weight FROM m JOIN r ON m.k = r.k GROUP BY label, r.k, r.f""")
def minimize_close(spark, sf):
    """Customers after one start, merged where their final weights are close."""
    customer = derived.table(spark, sf, "customer")
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    arcs = customer.select(F.lit("start").alias("src"), key.alias("dst"), F.col("c_mktsegment").alias("ilabel"), F.lit(1.0).alias("weight"))
    final = customer.select(key.alias("state"), ((F.col("c_custkey") % 10 + 1) / 10.0 + (F.col("c_custkey") % 4) * 0.008).alias("weight"))
    start = arcs.select(F.col("src").alias("state"), "weight").distinct()
    small = make.from_frames(arcs, start, final, PROBABILITY).minimize(partitioner=Closeness(0.01))
    ends = small.final.select("auto_id", F.col("state").alias("dst"), F.round("weight", 6).alias("final"))
    return small.arcs.join(ends, ["auto_id", "dst"]).select(F.col("ilabel").alias("label"), "final", rounded())


# K best, output --------------------------------------------------------------------------------------------------------


BEST = """SELECT CAST(row_number() OVER (ORDER BY round({key}, 9) {order}, labels) AS INT) AS rank, labels, round({key}, 9) + 0.0::DOUBLE AS weight FROM (
SELECT a.olabel || '|' || b.olabel || '|' || c.olabel AS labels, a.w * b.w * c.w AS prob, a.w + b.w + c.w AS trop FROM ly a JOIN ly b ON a.dst = b.src JOIN ly c ON b.dst = c.src) QUALIFY rank <= 10"""


@query("kbest", f"WITH {LY} " + BEST.format(key="prob", order="DESC"))
def kbest(spark, sf):
    return k_best(derived.layers(spark, sf), 10).select("rank", F.array_join("labels", "|").alias("labels"), rounded(digits=9))


@query("kbest_uniform", f"WITH {LY} " + BEST.format(key="trop", order="ASC"))
def kbest_uniform(spark, sf):
    return k_best(derived.layers(spark, sf, TROPICAL), 10, heuristic=uniform).select("rank", F.array_join("labels", "|").alias("labels"), rounded(digits=9))


@query("kbest_union", "SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, p_name) AS INT) AS rank, p_name AS text, count(*)::DOUBLE AS weight FROM part GROUP BY p_name QUALIFY rank <= 3")
def kbest_union(spark, sf):
    """The commonest part names, as paths of the union of their chains."""
    return k_best(batch_union(derived.weighted_names(spark, sf)), 3).select("rank", "text", rounded())


@query("kbest_resumed", f"WITH {LY} " + BEST.format(key="prob", order="DESC"))
def kbest_resumed(spark, sf):
    """The four best paths, and then the next six."""
    search = BestPaths(derived.layers(spark, sf))
    found = search.next(4).unionByName(search.next(6))
    return found.select("rank", F.array_join("labels", "|").alias("labels"), rounded(digits=9))


@query("fingerprints", "WITH n AS (SELECT p_name, count(*) AS k FROM part GROUP BY p_name) SELECT a.p_name AS auto_id, (SELECT count(*) FROM n b WHERE b.k = a.k) AS alike FROM n a")
def fingerprints(spark, sf):
    """How many of the part names' automata have the same hash: it covers initial weights alone, so names of one count meet."""
    own = fingerprint(derived.weighted_names(spark, sf))
    return own.join(own.groupBy("hash").agg(F.count("*").alias("alike")), "hash").select("auto_id", "alike")


@query("alphabet_pairs", "SELECT CASE WHEN s = '' THEN 'none' ELSE s || '/' || p END AS label, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders) GROUP BY 1")
def alphabet_pairs(spark, sf):
    """Orders by labels of a product alphabet, its empty label where both parts are empty."""
    both = TEXT * TEXT
    blank = lambda c: F.when(F.col("o_orderkey") % 5 == 0, TEXT.lit()).otherwise(F.col(c))
    labels = derived.table(spark, sf, "orders").select(F.struct(blank("o_orderstatus").alias("left"), blank("o_orderpriority").alias("right")).alias("label"))
    name = F.when(F.col("label") == both.lit(), F.lit("none")).otherwise(F.concat_ws("/", "label.left", "label.right"))
    return labels.groupBy(name.alias("label")).agg(F.count("*").alias("n"))


@query("dot_lines", f"""WITH {CV}, z AS (SELECT auto_id, max(pos) + 1 AS n FROM cv GROUP BY 1) SELECT auto_id, 0 AS kind, '"' || pos || '"->"' || (pos + 1) || '"[label="' || label || '/1.0"]' AS line FROM cv
UNION ALL SELECT auto_id, 1, '"' || i || '"[label="' || i || CASE WHEN i = n THEN ' 1.0"' ELSE ' 0.0"' END || CASE WHEN i = 0 THEN ',style=bold' ELSE '' END || ']' FROM z, generate_series(0, 100) g(i) WHERE i <= n""")
def dot(spark, sf):
    return dot_lines(make.chains(derived.conversation_steps(spark, sf), PROBABILITY))


@query("equals_self", "SELECT true AS same, false AS other")
def equals_self(spark, sf):
    a, b = derived.layers(spark, sf, orders=False), derived.layers(spark, sf, orders=False, regions="r_regionkey > 0")
    return spark.createDataFrame([(equal(a, a), equal(a, b))], "same boolean, other boolean")


@query("final_weights", f"WITH {LY} SELECT s AS state, CASE WHEN s[1] = 'o' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM (SELECT src AS s FROM ly UNION SELECT dst FROM ly)")
def final_weights(spark, sf):
    auto = derived.layers(spark, sf)
    ends = auto.arcs.select("auto_id", F.col("src").alias("state")).unionByName(auto.arcs.select("auto_id", F.col("dst").alias("state"))).distinct()
    return auto.final_weight(ends).select("state", "weight")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
