"""Helpers the operators of this folder share: tables, ranges of keys, stored results."""

from __future__ import annotations

import math
import tempfile
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blastradius.workspace import Workspace

#: Rows drawn for each range when ranges are cut; the driver holds that many short keys a range.
SAMPLE_PER_RANGE = 100
CODEC = "zstd"
LAST_ID = (1 << 63) - 1
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application; executors that join later get it too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> Workspace:
    """A new folder below the shared one that the cluster names; tables that hold texts stay until the end, so they are packed well."""
    return Workspace(spark, CODEC)


class Tables(Workspace):
    """A workspace whose tables can be deleted one by one, once nothing that is still to run reads them."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, CODEC)
        self._paths: list[tuple[DataFrame, str]] = []

    def save_counted(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> tuple[DataFrame, int]:
        out, rows = super().save_counted(df, name, by)
        self._paths.append((out, f"{self.root}/{self._n:03d}-{name}"))
        return out, rows

    def release(self, *tables: DataFrame) -> None:
        """Deletes tables that ``save`` has returned."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for table in tables:
            path = hadoop(next(p for t, p in self._paths if t is table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def drawn(df: DataFrame, n_ranges: int) -> DataFrame:
    """A sample from which ``n_ranges`` ranges are cut: a bounded number of rows, whatever the input.

    It only places the borders; every row is then dealt out by them.
    """
    want, rows = SAMPLE_PER_RANGE * n_ranges, df.count()
    return df if rows <= want else df.sample(min(1.0, 1.2 * want / rows), seed=7)


def cut_points(keys: Sequence[tuple], weights: Sequence[float], n_ranges: int) -> list[tuple]:
    """Keys at which new ranges begin, so that ranges weigh alike. Each is a key of the sample."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    total, points, seen = sum(weights), [], 0.0
    for i in order:
        if len(points) < n_ranges - 1 and seen >= total * (len(points) + 1) / n_ranges and (not points or keys[i] > points[-1]):
            points.append(keys[i])
        seen += weights[i]
    return points


def position(points: list[Column], at_most: Callable[[Column], Column]) -> Column:
    """How many of the sorted ``points`` are at most the row's key: two short scans of the square root of their number."""
    if not points:
        return F.lit(0)
    step = math.isqrt(len(points)) + 1
    coarse = points[step - 1 :: step]
    block = F.size(F.filter(F.array(*coarse), at_most)) if coarse else F.lit(0)
    return block * step + F.size(F.filter(F.slice(F.array(*points), block * step + 1, step), at_most))

