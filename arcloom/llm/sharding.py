"""Sharding: a two-pass external shuffle of a table into shard files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, scratch, stable

#: Buckets whose first positions are summed up together.
SPAN = 4096


def shard_documents(
    df: DataFrame,
    n_shards: int = 24,
    seed: int = 17,
    bucket_bytes: int = 16 << 20,
    least_buckets: int = 64,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write df's documents in a uniformly random order as n_shards folders of Parquet files, and return them reread.

    Pass one counts: a seeded hash of id and row number scatters the rows over buckets of about bucket_bytes of text,
    and sums of the buckets' counts, in spans of SPAN buckets and over the spans, give each bucket its first position in
    the permuted table, which meets the bucket's rows by a cogroup: neither the driver nor a task holds all of them.
    Pass two moves each row once to its bucket, where a seeded Fisher-Yates shuffle of the rows, in the order of their row
    numbers, fixes their positions; so a bucket is what a task holds, however long its texts are. Shards are equal ranges of positions, so their row counts
    differ by one at most, and a retried task writes the same files.

    Returns (id, text, shard int, slot long); slot counts from 0 in each shard. The hash takes a row number, so many
    rows with one id, one text or no id spread like any others, and no bucket grows with a group of copies. Null ids
    and texts pass through as they are; an empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    rows = stable(df.select(id_col, text_col), "documents").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    total, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    n_buckets = max(least_buckets, -(-n_bytes // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id", "row"), F.lit(n_buckets)).cast("int")

    def shuffled(group: pa.Table, place: pa.Table) -> pa.Table:
        b, n, first = place["bucket"][0].as_py(), group.num_rows, place["first"][0].as_py()
        order = np.argsort(group["row"].to_numpy(), kind="stable")
        np.random.default_rng([seed, b]).shuffle(order)  # numpy's shuffle is Fisher and Yates'
        at = first + np.arange(n, dtype=np.int64)
        shard = ((at + 1) * n_shards - 1) // total
        group = group.take(pa.array(order))
        return pa.table({"id": group["id"], "text": group["text"], "shard": pa.array(shard.astype(np.int32)), "slot": pa.array(at - shard * total // n_shards)})

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text string, shard int, slot long"
    path = path or scratch(spark, "shards")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    with Scratch(spark) as own:
        counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("bucket") / SPAN))
        counts = own.written(counts.withColumn("inside", before(Window.partitionBy("span").orderBy("bucket"))), "buckets")
        spans = counts.groupBy("span").agg(F.sum("n").alias("n")).withColumn("start", before(Window.orderBy("span")))
        places = counts.join(spans, "span").select("bucket", (F.col("start") + F.col("inside")).alias("first"))
        out = rows.withColumn("bucket", bucket).groupBy("bucket").cogroup(places.groupBy("bucket")).applyInArrow(shuffled, schema)
        out.write.partitionBy("shard").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return back.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "shard", "slot")
