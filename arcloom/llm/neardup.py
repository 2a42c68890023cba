"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import spare_prefix, written
from .graph import bucket_components

BINS, ROWS, BANDS = 256, 4, 32
PROBES = np.random.default_rng(7).integers(0, BINS, (256, BINS))
SALTS = np.random.default_rng(8).integers(1, 1 << 63, BINS, dtype=np.uint64)
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
#: Deviations over the mean by which two sketches may differ at similarity 0.75: 3 pairs in a million differ by more.
DEVIATIONS = 4.5
SKETCH = ("sketch_a", "sketch_b", "sketch_c", "sketch_d")
#: A set's bitmap: a bit for each of 1,024 values that its shingles' hashes take.
MAP = tuple(f"map_{k:02d}" for k in range(16))
PAYLOAD = ("n_shingles", *SKETCH, *MAP)
NO_ID = -(1 << 63)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS minima for each set: one permutation (the hash's own order) is cut into bins, and an empty bin takes
    the value of the first full bin on a probe sequence of its own that all sets share."""
    out = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    bins = np.arange(BINS)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    for i, s in enumerate(sets):
        if len(s):
            k = np.minimum(np.searchsorted(s, EDGES), len(s) - 1)
            out[i], full[i] = s[k], (s[k] >> shift) == bins
    got = full.copy()
    live = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    for probe in PROBES:
        if not len(live):
            break
        take = ~got[live] & full[live][:, probe]
        out[live] = np.where(take, out[live][:, probe], out[live])
        got[live] |= take
        live = live[~got[live].all(axis=1)]
    for i in live:  # sets with few full bins: a plain minimum for what is left
        for b in np.flatnonzero(~got[i]):
            out[i, b] = sets[i][np.argmin(hashing.mixed(sets[i] ^ SALTS[b]))]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.repeat(SALTS[None, :BANDS], len(sig), axis=0)
    for r in range(ROWS):
        keys = keys + sig[:, r * BANDS : (r + 1) * BANDS] * hashing.PLACE[r]
    return hashing.mixed(keys)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), 64 * len(MAP)), np.uint8)
    for i, s in enumerate(sets):
        bits[i, ((s * hashing.PLACE[10]) >> np.uint64(54)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def class_ids(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that name each set."""
    out: list[bytes | None] = []
    for s in sets:
        if len(s):
            out.append(np.array([hashing.mixed(s ^ SALTS[0]).sum() + np.uint64(len(s)), np.bitwise_xor.reduce(hashing.mixed(s ^ SALTS[1]))], dtype=">u8").tobytes())
        else:
            out.append(None)
    return out


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about most bytes."""
    size = np.cumsum(np.diff(hashing.raw(texts)[1]))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most)))
        yield a, b
        a = b


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text_hash, text) to (key.., n, cls, bands, sketch)."""
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            sets = hashing.shingle_sets(*hashing.raw(part.column("text")))
            sig = signatures(sets)
            bits = ((sig * hashing.PLACE[9]) >> np.uint64(63)).astype(np.uint8)
            sketch = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
            keys, maps = band_keys(sig).view(np.int64), bitmaps(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(class_ids(sets), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1))),
                    *[pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(len(SKETCH))],
                    *[pa.array(np.ascontiguousarray(maps[:, k])) for k in range(len(MAP))],
                ],
                names=["doc_id", "text_hash", "n_shingles", "cls", "bands", *SKETCH, *MAP],
            )


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            sets = hashing.shingle_sets(*hashing.raw(part.column("text")))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            edge = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat))], names=["cls", "set"])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough. One text a class is read again to give its set."""
    need = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    need = need.join(classes.select("cls", F.coalesce("rep.doc_id", F.lit(NO_ID)).alias("key"), F.col("rep.text_hash").alias("text_hash")), "cls")
    texts = docs.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))).join(need, ["key", "text_hash"]).dropDuplicates(["key", "text_hash"])
    sets = written(texts.select("cls", "text").mapInArrow(full_sets, "cls binary, set array<long>"), "sets")
    one = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter((100 + percent) * F.col("common") >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def alike(x: str, y: str, percent: int) -> Column:
    """What two sets over the threshold have in common: their sizes are near, and so are their sketches and bitmaps.

    A sketch has a bit for each bin; of two sets of similarity 0.75, an eighth of the bits differ on average, with the
    deviation of as many draws as there are bins, or three quarters of the shingles where these are fewer. Each bit that
    only one set's bitmap has is a shingle at least that the other lacks, which bounds what they share. Of the buckets that
    two sets share, the first one alone gives their pair."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    bits = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH), F.lit(0))
    spread = F.sqrt(F.lit(7 / 64) / F.least(F.lit(float(BINS)), 0.75 * F.least(n, m)))
    first = F.array_position(F.zip_with(F.col(f"{x}.bands"), F.col(f"{y}.bands"), lambda a, b: a == b), True) == F.col(f"{x}.band") + 1
    only = lambda a, b: sum((F.bit_count(F.col(f"{a}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{c}")))) for c in MAP), F.lit(0))
    most = F.least(n - only(x, y), m - only(y, x))
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (bits <= BINS * (0.125 + DEVIATIONS * spread)) & ((100 + percent) * most >= percent * (n + m)) & first


def near_duplicates(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_hash, n_shingles, component_id (smallest doc_id linked with it, over any
    number of links), kept (doc_id is component_id) and chosen (this doc_id and text is the group's one survivor).

    Equal sets form classes first, so copies cost one row each from there on. A class has BANDS bucket keys. In each
    bucket every class is paired with the bucket's smallest one only (a star: as many pairs as members), and pairs are
    confirmed on full sets. Where a bucket then still holds several components, the classes outside its largest
    component are paired with the bucket's classes of other components that size and sketch allow, so a link is lost
    only if two sets meet in no bucket: at similarity 0.75 with a chance of (1 - 0.75^4)^32, 5 in a million.

    percent is at least 75 (the size filter takes that for granted). Documents without words link with nothing. Null
    doc_ids take part, never name a component that has another id, and count as their own where they stand alone;
    repeated rows share class and component. An empty table gives no rows. Other columns are not read.
    """
    if percent < 75:
        raise ValueError("links below 75 percent would be missed")
    docs = keyed(df, id_col, text_col)
    schema = "doc_id long, text_hash long, n_shingles long, cls binary, bands array<long>, " + ", ".join(f"{c} long" for c in (*SKETCH, *MAP))
    signed = written(docs.select("doc_id", "text_hash", "text").mapInArrow(sign, schema), "signed")
    same = ("bands", *PAYLOAD)
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    classes = written(signed.filter("n_shingles > 0").groupBy("cls").agg(rep, *[F.first(c).alias(c) for c in same]), "classes")
    member = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    labels = bucket_components(member, ["band", "bucket"], classes.select("cls", "bands", *PAYLOAD), lambda x, y: alike(x, y, percent), lambda pairs: linked(pairs, classes, docs, percent))

    rooted = classes.select("cls", "rep").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("low"))
    named = rooted.join(lowest, "root").select("cls", "low")
    out = signed.drop("bands", *SKETCH, *MAP).join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        (F.col("cls").isNull() | (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_hash") == F.col("low.text_hash")))).alias("chosen"),
    )


def without_near_duplicates(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without all but one document of each group, all columns kept. Rows without words stay, repeated ones too;
    of repeated rows with words one stays. An empty table gives none; very long texts are compared whole."""
    own_id, own_hash = (spare_prefix(df) + n for n in ("id", "hash"))
    spare = {own_id: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), own_hash: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    groups = near_duplicates(df, percent, id_col, text_col).filter("chosen and n_shingles > 0")
    chosen = groups.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    has_word = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    worded = df.filter(has_word).withColumns(spare).join(chosen, [own_id, own_hash]).dropDuplicates([own_id, own_hash])
    return worded.select(*[f"`{c}`" for c in df.columns]).unionByName(df.filter(~has_word))
