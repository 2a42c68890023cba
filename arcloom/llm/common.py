"""Shared folders, written intermediate tables and small column helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that the contracts call white space: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        holder = spark.sparkContext._jsc.sc().getCheckpointDir()
        if holder.isDefined():
            root = holder.get()
        else:
            root = "file://" + tempfile.mkdtemp(prefix="arcloom-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Shuffle files of a query are deleted when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str) -> None:
    """Write df; what its shuffles left on executors' disks goes once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no more than a reread."""
    path = scratch(df.sparkSession, name)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that nothing needs once the block is left: they are deleted then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        save(df, path)
        return self.spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame, name: str) -> DataFrame:
    """df, whose rows can be numbered as they come: as it is if it only reads, filters and computes; else written first.

    What a shuffle, join or Python code gives may come in another order each time it is computed."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if re.search(r"Exchange|Repartition|Join|Aggregate|Window|Limit|Sample|Python|Arrow|Pandas|Sort|TakeOrdered", plan):
        return written(df, name)
    return df


#: Rows and bytes of a batch between Spark and Python, unless the session says otherwise: long texts count in the
#: thousands, and both sides hold a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "8388608")}


def reachable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver did, and keep their batches small."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    for key, (usual, ours) in BATCH.items():
        if spark.conf.get(key, usual) in (usual, "64MB", "64m"):
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has, for columns of the operator's own."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names clash, in any case, with those that the operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
