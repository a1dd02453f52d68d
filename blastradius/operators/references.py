"""Table names found in queries, resolved to project nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blastradius.functions.norm import dotted


def table_ref_resolve(refs: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds ``node`` to refs (cat, db, tbl, raw_code); a bare table name is dropped.

    Full name first; without a catalog the schema and table, where only one node
    answers; else a name written into the query text, else a name not found.
    """
    full = relations.groupBy(dotted(F.col("db"), F.col("sch"), F.col("name")).alias("key3")).agg(F.min("id").alias("by_full"))
    pair = (
        relations.groupBy(dotted(F.col("sch"), F.col("name")).alias("key2"))
        .agg(F.min("id").alias("by_pair"), F.max("id").alias("last"))
        .where(F.col("by_pair") == F.col("last"))
        .drop("last")
    )
    cat, db = F.coalesce("cat", F.lit("")), F.coalesce("db", F.lit(""))
    name = F.concat_ws(".", cat, db, F.col("tbl"))
    code = F.lower("raw_code")
    spelled = [name, F.ltrim(name, F.lit(".")), F.lower(F.concat_ws(".", db, F.col("tbl"))), F.lower("tbl")]
    written = F.lit(False)
    for s in spelled:
        written = written | ((s != "") & F.contains(code, s))
    return (
        refs.where((cat != "") | (db != ""))
        .withColumn("key3", F.lower(name))
        .withColumn("key2", F.when((cat == "") & (db != ""), F.lower(F.concat_ws(".", db, F.col("tbl")))))
        .join(full, "key3", "left")
        .join(pair, "key2", "left")
        .select(
            *refs.columns,
            F.coalesce(
                "by_full",
                "by_pair",
                F.concat(F.when(written, "_HARDCODED_REF___").otherwise("_NOT_FOUND___"), F.lower(name)),
            ).alias("node"),
        )
    )


def parent_schemas(parents: DataFrame, catalog: DataFrame, derived: DataFrame) -> DataFrame:
    """model, parent, origin, columns: where a parent's columns are taken from.

    Catalog nodes, then catalog sources, then columns derived for the parent; a
    parent found in none of them has origin ``missing``.
    """

    def counted(df: DataFrame, origin: str) -> DataFrame:
        return df.groupBy(F.col("node_id").alias("parent")).agg(F.count(F.lit(1)).alias(origin))

    out = parents.select("model", "parent").distinct()
    tables = {
        "nodes": catalog.where(F.col("part") == "nodes"),
        "sources": catalog.where(F.col("part") == "sources"),
        "derived": derived.select(F.col("node").alias("node_id")),
    }
    for origin, df in tables.items():
        out = out.join(counted(df, origin), "parent", "left")
    picked = F.lit("missing")
    for origin in reversed(list(tables)):
        picked = F.when(F.col(origin).isNotNull(), origin).otherwise(picked)
    return out.select(
        "model", "parent", picked.alias("origin"), F.coalesce(*tables, F.lit(0)).cast("bigint").alias("columns")
    )
