"""The finished graph as partitioned parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The parts of a graph that are written.
PARTS = ("metadata", "summary", "layers", "nodes", "edges", "impact", "diagnostics")


def write_graph(tables: dict[str, DataFrame], path: str, tenant: str) -> None:
    """Write every part below ``path``, replacing only the partition of ``tenant``."""
    unknown = set(tables) - set(PARTS)
    if unknown:
        raise ValueError(f"not parts of a graph: {sorted(unknown)}")
    for name, df in tables.items():
        (
            df.withColumn("tenant", F.lit(tenant))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("tenant")
            .parquet(f"{path}/{name}")
        )


def read_graph(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A written part, all tenants; names of tenants stay text also where they look like numbers."""
    fields = spark.read.parquet(f"{path}/{part}").schema.fields
    schema = StructType([StructField("tenant", StringType()) if f.name == "tenant" else f for f in fields])
    return spark.read.schema(schema).parquet(f"{path}/{part}")
