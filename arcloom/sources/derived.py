"""Automata derived from relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcloom.functions.semiring import PROBABILITY, Semiring
from arcloom.plans.iterate import settled

from .automaton import Automaton
from .constructors import chains, from_frames, spelled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """(auto_id, pos, label): each key's rows in order, counted from 0."""
    at = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).cast("string").alias("auto_id"), (F.row_number().over(at) - 1).cast("long").alias("pos"), F.col(label).alias("label"))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role")


def name_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return spelled(names, "p_name", "p_name")


def weighted_names(spark: SparkSession, sf_dir: str) -> Automaton:
    """A chain for each distinct part name, whose weight is how many parts have it."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("auto_id")).agg(F.count("*").cast("double").alias("weight"))
    own = chains(name_steps(spark, sf_dir), PROBABILITY)
    initial = own.initial.drop("weight").join(counts, "auto_id").select("auto_id", "state", "weight")
    return Automaton(own.arcs, initial, own.final, own.ring)


def layers(spark: SparkSession, sf_dir: str, ring: Semiring = PROBABILITY, orders: bool = True, regions: str = "true") -> Automaton:
    """region to nation to customer to orders as a layered transducer.

    Each arc reads what the lower table says and writes what the upper one does; weights come from the lower table's columns."""
    read = lambda name: table(spark, sf_dir, name)
    region, nation, customer = read("region").filter(regions), read("nation"), read("customer")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    weigh = lambda w: {"boolean": F.lit(True), "log": F.log(w)}.get(ring.name, w).alias("weight")
    named = nation.join(read("region"), nation.n_regionkey == F.col("r_regionkey"))
    arcs = [named.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"), F.col("n_name").alias("ilabel"), F.col("r_name").alias("olabel"), weigh((F.col("n_nationkey") + 1) / 100.0))]
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    arcs.append(named.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), F.col("c_mktsegment").alias("ilabel"), F.col("n_name").alias("olabel"), weigh((F.col("c_custkey") % 10 + 1) / 10.0)))
    ends = customer.select(key("c", "c_custkey").alias("state"))
    if orders:
        order = read("orders")
        named = order.join(customer, order.o_custkey == customer.c_custkey)
        arcs.append(named.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.col("o_orderstatus").alias("ilabel"), F.col("c_mktsegment").alias("olabel"), weigh(F.col("o_totalprice") / 1e6)))
        ends = order.select(key("o", "o_orderkey").alias("state"))
    one = ring.lit(ring.one).alias("weight")
    start = region.select(key("r", "r_regionkey").alias("state"), one)
    return from_frames(reduce(DataFrame.unionByName, arcs).withColumn("auto_id", F.lit("ly")), start.withColumn("auto_id", F.lit("ly")), ends.select("state", one).withColumn("auto_id", F.lit("ly")), ring)


def returns(spark: SparkSession, sf_dir: str, ring: Semiring = PROBABILITY) -> Automaton:
    """Nations to customers, and customers to their orders and back: each customer with its orders is a cycle of its own. All nations
    are initial, all orders final."""
    read = lambda name: table(spark, sf_dir, name)
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    weigh = lambda w: {"boolean": F.lit(True), "log": F.log(w)}.get(ring.name, w).alias("weight")
    customer, nation = read("customer"), read("nation")
    orders = read("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    down = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), F.col("c_mktsegment").alias("ilabel"), weigh((F.col("c_custkey") % 10 + 1) / 10.0))
    out = orders.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.col("o_orderstatus").alias("ilabel"), weigh(F.col("o_totalprice") / 1e6))
    back = orders.select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"), F.lit("again").alias("ilabel"), weigh((F.col("o_orderkey") % 7 + 1) / 1000.0))
    one = ring.lit(ring.one).alias("weight")
    named = lambda df: df.withColumn("auto_id", F.lit("rt"))
    return from_frames(named(down.unionByName(out).unionByName(back)), named(nation.select(key("n", "n_nationkey").alias("state"), one)), named(orders.select(key("o", "o_orderkey").alias("state"), one)), ring)


def markov(spark: SparkSession, sf_dir: str) -> Automaton:
    """The chain of event types: how often each follows another, starts and ends a user's events. Total mass one."""
    steps = event_steps(spark, sf_dir)
    after = steps.withColumn("next", F.lead("label").over(Window.partitionBy("auto_id").orderBy("pos")))
    pairs = settled(after.groupBy("label", "next").count())  # a row for each two types; the events are read once for it
    total = pairs.groupBy("label").agg(F.sum("count").alias("total"))
    share = pairs.join(total, "label").select(F.lit("bg").alias("auto_id"), "label", "next", (F.col("count") / F.col("total")).alias("weight"))
    arcs = share.filter("next is not null").select("auto_id", F.col("label").alias("src"), F.col("next").alias("dst"), F.col("next").alias("ilabel"), "weight")
    final = share.filter("next is null").select("auto_id", F.col("label").alias("state"), "weight")
    first = steps.filter("pos = 0")
    whole = first.agg(F.count("*").alias("n"))
    initial = first.groupBy("label").count().crossJoin(F.broadcast(whole)).select(F.lit("bg").alias("auto_id"), F.col("label").alias("state"), (F.col("count") / F.col("n")).alias("weight"))  # whole is one row
    return from_frames(arcs, initial, final, PROBABILITY)


def order_graph(spark: SparkSession, sf_dir: str, ring: Semiring = PROBABILITY) -> Automaton:
    """Order status to priority, with an arc for each order: a graph of many parallel arcs."""
    w = F.col("o_totalprice") / 1e6
    weight = {"boolean": F.col("o_totalprice") > 200_000, "log": F.log(w)}.get(ring.name, w)
    arcs = table(spark, sf_dir, "orders").select(F.lit("og").alias("auto_id"), F.col("o_orderstatus").alias("src"), F.col("o_orderpriority").alias("dst"), (F.col("o_orderkey") % 3).cast("string").alias("ilabel"), weight.alias("weight"))
    one = ring.lit(ring.one).alias("weight")
    ends = [arcs.select("auto_id", F.col(c).alias("state")).distinct().select("*", one) for c in ("src", "dst")]
    return from_frames(arcs, *ends, ring)
