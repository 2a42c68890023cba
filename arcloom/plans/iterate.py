"""What loops on the driver share: tables written once, growing tables and a step limit."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own is set only where none is (tests)."""
    root, holder = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and holder.isDefined():
        root = holder.get()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="arcloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Supersteps after which a loop over a graph first shortens the graph's unary chains.
PATIENCE = 10


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver did."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def _stored(df: DataFrame, test: Column | None) -> tuple[DataFrame, int, str]:
    seen, path = Observation(), f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.observe(seen, F.count("*" if test is None else F.when(test, 1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"], path


def counted(df: DataFrame, test: Column | None = None) -> tuple[DataFrame, int]:
    """df written to storage that outlives executors and read back, its lineage cut, and how many of its rows there are
    (for which test holds): all in one job."""
    return _stored(df, test)[:2]


class Replaced:
    """A table that a loop writes anew each time: rows is the latest form, n as in counted; the form before is deleted then."""

    def __init__(self, df: DataFrame, test: Column | None = None):
        self.test = test
        self.rows, self.n, self.path = _stored(df, test)

    def put(self, df: DataFrame) -> int:
        old = self.path
        self.rows, self.n, self.path = _stored(df, self.test)
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return self.n


def settled(df: DataFrame) -> DataFrame:
    return counted(df)[0]


def laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """df written once to the shared folder in buckets by keys, sorted in each, as many as there are shuffle partitions: a join on
    the keys moves the other side only, however often it is done."""
    spark, name = df.sparkSession, f"laid_out_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Growing:
    """A table that a loop adds to; its plan stays small, since the parts are written into one when there are many."""

    MOST = 8

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        if len(self.parts) == self.MOST:
            self.parts = [settled(together(self.parts))]
        self.parts.append(part)

    def all(self) -> DataFrame:
        return together(self.parts)


class Steps:
    """Counts supersteps and raises when there are more than the limit, rather than give part of a result."""

    def __init__(self, limit: int, what: str):
        self.limit, self.what, self.done = limit, what, 0

    def next(self) -> None:
        self.done += 1
        if self.done > self.limit:
            raise RuntimeError(f"{self.what} took more than {self.limit} steps")
