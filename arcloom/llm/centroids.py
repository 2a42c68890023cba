"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors, in exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spare_prefix, without, written

#: Quantised components beyond this would let a squared distance of 64 components leave 64 bits.
LARGEST = 1 << 26
#: A vector with more than this share of all rows is hot; there are fewer than 1 / HOT_SHARE such vectors, so they are broadcast.
HOT_SHARE = 0.001
RESULT = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def quantised(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector hasn't exactly dim components, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when((F.size(vector) == dim) & ~bad, whole)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of equal ones, and the squared distance; exact.

    Doubles are exact while every product and sum stays below 2**53, and much faster; else 64-bit integers."""
    small = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 * x.shape[1] * 4 < 1 << 53
    kind = np.float64 if small else np.int64
    c = centroids.astype(kind)
    own = (c * c).sum(axis=1)
    cluster, distance = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), step):
        part = x[a : a + step].astype(kind)
        far = (part * part).sum(axis=1)[:, None] - 2 * (part @ c.T) + own
        best = far.argmin(axis=1)
        cluster[a : a + step] = best
        distance[a : a + step] = far[np.arange(len(part)), best].astype(np.int64)
    return cluster, distance


def lloyd_round(distinct: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """New centroids: each batch sums the vectors of each cluster, weighted with their multiplicities; Spark adds the sums up.
    What the driver gets are the sums of each cluster, however many vectors there are."""
    old, dim = np.array(centroids, dtype=np.int64), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(old), np.zeros(len(old), dtype=np.int64)
        for batch in batches:
            x, n = matrix(batch.column("q"), dim), batch.column("n").to_numpy(zero_copy_only=False)
            cluster, _ = nearest(x, old)
            np.add.at(total, cluster, x * n[:, None])
            np.add.at(count, cluster, n)
        full = np.flatnonzero(count)
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array(count[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = distinct.select("q", "n").mapInArrow(sums, "cluster int, n long, sums array<long>")
    # a sum's parts are longs, but all of them may be more than a long holds
    whole = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    made = [list(c) for c in centroids]
    for r in whole.collect():
        made[r["cluster"]][r["at"]] = int(r["value"]) // r["n"]
    return made


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """df's other columns with cluster, distance, cluster_inertia, inertia and centroid_sha256, a row for each vector that takes part.

    Vectors of exactly dim finite components take part, quantised to floor(scale * x). They are grouped by their quantised form
    with multiplicities (a partial aggregate before the shuffle, so a vector that is a third of all rows is one row of each
    task). The k start centroids are those of the smallest sha256 of "seed:id". A round assigns every distinct vector to the
    nearest centroid (ties: the smaller number) and replaces each centroid that has vectors by the floor of their weighted mean.
    Then distinct vectors are assigned once more and joined back to the ids: hot vectors, of which there are fewer than
    1 / HOT_SHARE, by broadcast, the others by a shuffle.

    Null vectors, those of other lengths and those with null or non-finite components give no row; an id that repeats gives a row
    for each of its vectors; a null id hashes as the empty text. Fewer than k vectors make fewer clusters; an empty table gives
    no rows. A component beyond LARGEST after scaling is an error, since its distance may not fit 64 bits. vector_col isn't
    returned, and columns named like a result are replaced.
    """
    spark = df.sparkSession
    mark = spare_prefix(df)
    q, n = f"{mark}q", f"{mark}n"
    carried = [c for c in without(df, *RESULT).columns if c != vector_col]
    own = df.withColumn(q, quantised(F.col(f"`{vector_col}`"), dim, scale)).filter(F.col(q).isNotNull())
    beyond = F.array_max(F.transform(q, lambda x: F.abs(x))) > LARGEST
    own = own.withColumn(q, F.when(beyond, F.raise_error(F.lit(f"a component exceeds {LARGEST} once scaled"))).otherwise(F.transform(q, lambda x: x.cast("int"))))
    rows = written(own.select(*[F.col(f"`{c}`") for c in carried], q), "quantised")
    with Scratch(spark) as scratch:
        distinct = scratch.written(rows.groupBy(F.col(q).alias("q")).agg(F.count("*").alias("n")), "distinct")
        first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
        centroids = [list(r[0]) for r in rows.select(q, first.alias(n)).orderBy(n, q).limit(k).collect()]
        for _ in range(rounds if centroids else 0):
            centroids = lloyd_round(distinct, centroids)
        placed = written(assigned(distinct, centroids, dim), "assigned")
    marks = [(i, ",".join(map(str, c))) for i, c in enumerate(centroids)]
    digests = spark.createDataFrame(marks, "cluster int, text string").select("cluster", F.sha2("text", 256).alias("centroid_sha256"))
    inertia = placed.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("cluster_inertia"))
    shared = digests.join(inertia, "cluster").select("*", F.expr("sum(cluster_inertia) OVER ()").alias("inertia"))  # k rows
    share = placed.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > HOT_SHARE * share
    found = placed.select(F.col("q").alias(q), "cluster", "distance", F.col("n").alias(n))
    hot = found.filter(F.col(n) > HOT_SHARE * share).drop(n)
    cold = found.filter(F.col(n) <= HOT_SHARE * share).drop(n)
    if placed.filter(is_hot).isEmpty():
        joined = rows.join(cold, q)
    else:
        joined = rows.join(F.broadcast(hot), q).unionByName(rows.join(F.broadcast(hot.select(q)), q, "left_anti").join(cold, q))
    return joined.join(F.broadcast(shared), "cluster").select(*[F.col(f"`{c}`") for c in carried], *RESULT)


def assigned(distinct: DataFrame, centroids: list[list[int]], dim: int) -> DataFrame:
    """(q, n, cluster, distance) of every distinct vector."""
    final = np.array(centroids, dtype=np.int64).reshape(-1, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(matrix(batch.column("q"), dim), final)
            yield pa.record_batch([batch.column("q"), batch.column("n"), pa.array(cluster), pa.array(distance)], ["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(place, "q array<int>, n long, cluster int, distance long")
