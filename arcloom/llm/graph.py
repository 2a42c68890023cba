"""Connected components of edge tables, and of nodes that share buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, written

#: Nodes of a bucket that one task pairs with the bucket's others.
AT_ONCE = 512
#: Ranges of buckets that are shuffled one after the other, so that no more of all nodes' rows than that lies on disks at once.
RANGES = 4
LAST = (1 << 63) - 1


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps, each a grouped minimum (summed before the shuffle) and a join back, and
    writes the edges after each round; a component's diameter halves at least, so rounds grow with its logarithm. Loops
    and repeated edges count for nothing; no edges give no rows."""
    with Scratch(edges.sparkSession) as tables:

        def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
            seen = Observation()
            out = tables.written(df.observe(seen, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("sum")), "edges")
            return out, (seen.get["n"], seen.get["sum"])

        now, mark = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        for _ in range(most_rounds):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
            now, state = kept(small)
            if state == mark:
                roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
                return written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "labels")
            mark = state
    raise RuntimeError("the components did not settle")


def bucket_components(
    member: DataFrame,
    keys: list[str],
    payload: DataFrame,
    alike: Callable[[str, str], Column],
    linked: Callable[[DataFrame], DataFrame],
    early: bool = False,
    judged: tuple[DataFrame, Callable[[str, str], Column]] | None = None,
) -> DataFrame:
    """(node, root) of the components that nodes sharing a bucket form, for nodes that have a link.

    member has a row for each node (cls, distinct within a bucket) and bucket (keys); payload what alike needs of a node.
    linked gives those of candidate pairs (a, b) that are links; alike(x, y) is a condition that all links meet. judged, if
    given, is a table with a row for each node (cls, a long) and a condition on two such rows that all links meet and few others:
    the pairs left after the stars then meet it, in one bucket each, before they are ever rows.

    First every bucket gives a star: its smallest node paired with each other one (early: that alike allows, where pairs, once
    each, meet their payloads before they are written). Buckets that then still hold several
    components go on: their nodes outside the bucket's largest component are paired with the nodes of its other
    components that alike allows. Pairs inside a component are never formed, and no link between buckets' nodes is lost.
    The links found last join components, so they are followed over roots."""
    with Scratch(member.sparkSession) as tables:
        star = member.groupBy(*keys).agg(F.min("cls").alias("a"), F.count("*").alias("size")).filter("size > 1")
        buckets = tables.written(member.join(star, keys), "buckets")
        pairs = buckets.filter("a <> cls")
        if early:
            rest = [c for c in payload.columns if c != "cls"]
            side = lambda at: payload.select(F.col("cls").alias(at), F.struct(*rest).alias(f"of_{at}"))
            pairs = pairs.select("a", "cls").distinct().join(side("a"), "a").join(side("cls"), "cls").filter(alike("of_a", "of_cls"))
        pairs = tables.written(pairs.select("a", F.col("cls").alias("b")).distinct(), "stars")
        labels = components(tables.written(linked(pairs), "links"))

        placed = buckets.drop("size").join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        placed = tables.written(placed if judged else placed.drop("a"), "placed")
        if judged:
            extra = tables.written(linked(met(placed, keys, alike, *judged, tables)), "links")
            return labels if extra.isEmpty() else joined_up(labels, extra)
        shares = placed.groupBy(*keys, "root").agg(F.count("*").alias("n"))
        apart = shares.groupBy(*keys).agg(F.count("*").alias("parts"), F.max(F.struct("n", "root")).alias("most")).filter("parts > 1")
        open_ = placed.join(apart.select(*keys, F.col("most.root").alias("most")), keys).join(payload, "cls")
        x, y = open_.filter("root <> most").alias("x"), open_.alias("y")
        on = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.most")) | (F.col("x.cls") < F.col("y.cls"))) & alike("x", "y")
        for k in keys:
            on = (F.col(f"x.{k}") == F.col(f"y.{k}")) & on
        more = x.join(y, on).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        more = tables.written(more.join(pairs, ["a", "b"], "left_anti"), "rest")
        if more.isEmpty():
            return labels
        extra = tables.written(linked(more), "links")
        if extra.isEmpty():
            return labels
        return joined_up(labels, extra)


def joined_up(labels: DataFrame, extra: DataFrame) -> DataFrame:
    """labels (node, root) with the components joined that links (a, b) join; their nodes may be new."""
    root_of = lambda at: labels.select(F.col("node").alias(at), F.col("root").alias(f"root_{at}"))
    across = extra.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    across = across.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
    joined = components(across.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    fresh = across.select(F.explode(F.array("root_a", "root_b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(fresh.select("node", F.col("node").alias("root")))
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(every.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")


def met(
    placed: DataFrame, keys: list[str], alike: Callable[[str, str], Column], of: DataFrame, link: Callable[[str, str], Column], tables: Scratch
) -> DataFrame:
    """The pairs (a, b) of nodes of different components that share a bucket and meet alike and link. placed has the nodes of the
    buckets (keys, a: the bucket's smallest node, cls, root); of has what alike and link need of each.

    Each row carries what is compared, so no row is made for a pair that fails. A pair that shares several buckets is compared
    in the first of them; pairs with a bucket's smallest node have been compared before. A large bucket is dealt over
    several tasks: each node is the first of a pair in one of them, and the second in all. alike is asked of every pair, link
    of those only that alike leaves."""
    size = placed.groupBy(*keys, "root").agg(F.count("*").alias("n")).groupBy(*keys)
    size = size.agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most")).filter("parts > 1")
    open_ = placed.join(size.select(*keys, "size", F.col("most.root").alias("most")), keys)
    key = F.xxhash64(*keys) if len(keys) > 1 else F.col(keys[0])
    tasks = F.ceil(F.col("size") / AT_ONCE).cast("int")
    nodes = open_.groupBy("cls").agg(F.first("root").alias("root"), F.collect_list(F.struct(key.alias("key"), tasks.alias("tasks"), (F.col("most") == F.col("root")).alias("most"), (F.col("a") == F.col("cls")).alias("low"))).alias("at"))
    nodes = tables.written(nodes.join(of, "cls"), "nodes")
    # an array, so that both sides of the join read all of it and share one shuffle: the node as first of a pair (or LAST: never), and as second
    first = F.when(~F.col("at.most") & (F.pmod(F.xxhash64("cls"), F.col("at.tasks")) == F.col("task")), F.col("cls")).otherwise(LAST)
    turn = F.array(first, F.when(F.col("at.most"), LAST).otherwise(F.col("cls")))

    def pairs(nth: int) -> DataFrame:
        here = F.filter("at", lambda b: ~b["low"] & (F.pmod(b["key"], F.lit(RANGES)) == nth))
        rows = nodes.withColumn("shared", F.col("at.key")).withColumn("at", F.explode(here)).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("at.tasks") - 1)))
        rows = rows.withColumn("turn", turn).withColumn("key", F.col("at.key")).drop("at").repartition("key", "task")
        x, y = rows.alias("x"), rows.alias("y")
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.task") == F.col("y.task"))
        on = (F.get("x.turn", F.lit(0)) < F.get("y.turn", F.lit(1))) & (F.col("x.root") != F.col("y.root"))
        once = F.array_min(F.array_intersect("x.shared", "y.shared")) == F.col("x.key")
        found = x.join(y, same & on & alike("x", "y") & once & link("x", "y"))
        return tables.written(found.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")), "rest")

    return reduce(DataFrame.unionByName, map(pairs, range(RANGES)))
