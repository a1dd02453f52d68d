"""Tables written once to shared storage, to cut lineage and reuse results.

Loops and tables that several results read are written as parquet below the
folder the cluster names in ``spark.checkpoint.dir``.  A written table survives
the loss of any executor and is read back column-pruned.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}

#: Spark's setting to remove the shuffle files of a query when it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written is read from there: the shuffle files behind it go at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables; a private one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-blastradius-")
    return _local_dirs[app]


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are dealt by the key, and none is sent whole to the driver and all tasks.

    Spark takes a side to be as large as its files; names spelled from numbers fill a hundred times as much in memory.
    """
    return df.hint("merge")


class Workspace:
    """One folder of written tables; every table gets a name of its own."""

    def __init__(self, spark: SparkSession, codec: str | None = None):
        self.spark = spark
        self.codec = codec or spark.conf.get("spark.sql.parquet.compression.codec")
        self.root = f"{shared_dir(spark)}/blastradius-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        return self.save_counted(df, name, by)[0]

    def save_counted(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
        """Write ``df``, in a folder a value of ``by``, and read it back; the row count comes from the same job."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        seen = Observation()
        with _shuffles_removed(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path, partitionBy=list(by), compression=self.codec)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["rows"]

    def drop(self) -> None:
        """Delete the folder; call when no result built on it is read any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path, True)
