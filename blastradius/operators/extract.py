"""Tables of references, steps and sources read from formula, query and model text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blastradius.functions import text as T
from blastradius.functions.norm import CASE_SENSITIVE_QUOTES, gateway_needed, source_key


def rows_of(df: DataFrame, keys: list[str], found) -> DataFrame:
    """One row per element of an array of structs next to its keys."""
    return df.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*")


def values_of(df: DataFrame, keys: list[str], found, name: str) -> DataFrame:
    return df.select(*keys, F.explode(found).alias(name))


def formula_refs(df: DataFrame, keys: list[str], formula: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Column refs (tbl, col), measure refs (measure), table refs (ref_table) per formula."""
    cleaned = df.withColumn("cleaned", T.clean_formula(F.col(formula)))
    text = F.col("cleaned")
    return (
        rows_of(cleaned, keys, T.column_refs(text)),
        values_of(cleaned, keys, T.measure_refs(text), "measure"),
        values_of(cleaned, keys, T.table_refs(text), "ref_table"),
    )


def parameter_test(df: DataFrame) -> DataFrame:
    """id, is_parameter: a marker column, or rows in a computed or untyped partition."""
    computed = F.coalesce(F.col("source_type"), F.lit("calculated")) == "calculated"
    tuples = F.size(T.parameter_rows(F.col("body"))) > 0
    return df.select("id", (F.col("has_marker") | (computed & tuples)).alias("is_parameter"))


def connectors(queries: DataFrame, shared: DataFrame) -> DataFrame:
    """tbl and the sources its query opens; a database is also parameterized where the query names a declared parameter anywhere."""
    declared = shared.where(T.parameter_value(F.col("expr")).isNotNull()).select(F.col("name").alias("param"))
    named = values_of(queries, ["tbl"], T.parameter_names(F.col("m")), "param").join(declared, "param", "left_semi")
    named = named.select("tbl").distinct().withColumn("names_one", F.lit(True))
    rows = rows_of(queries, ["tbl"], T.connectors(F.col("m"))).join(named, "tbl", "left")
    anywhere = (F.col("kind") == "SQL Server") & F.coalesce("names_one", F.lit(False))
    return rows.withColumn("parameterized", F.col("parameterized") | anywhere).drop("names_one")


def table_sources(queries: DataFrame, shared: DataFrame) -> DataFrame:
    """tbl, source_key and the source's parts, one row per table and source.

    A query that opens nothing itself takes the sources of the shared query it
    starts from.
    """
    # Texts are parsed once and before any filter, and what is joined are rows without texts; those
    # that need no shared query have keys of their own, so that they don't meet in one task.
    opened = queries.select("tbl", "ord", T.shared_ref(F.col("m")).alias("ref"), F.explode_outer(T.connectors(F.col("m"))).alias("x")).select(
        "tbl", "ord", "x", (F.col("x").isNull() & F.col("ref").isNotNull()).alias("passes_on"), F.coalesce("ref", "tbl").alias("name")
    )
    bases = shared.select(F.lit(True).alias("passes_on"), "name", F.explode(T.connectors(F.col("expr"))).alias("base"))
    return (
        opened.join(bases, ["passes_on", "name"], "left")
        .select("tbl", "ord", F.coalesce("x", "base").alias("x"))
        .where(F.col("x").isNotNull())
        .select("tbl", "ord", "x.*")
        .withColumn("source_key", source_key(*[F.col(c) for c in ("kind", "server", "database", "url", "path")]))
        .groupBy("tbl", "source_key")
        .agg(F.min(F.struct("ord", "kind", "server", "database", "url", "path", "parameterized")).alias("s"))
        .select("tbl", "source_key", "s.*")
    )


def distinct_sources(sources: DataFrame, shared: DataFrame) -> DataFrame:
    """First source per key, parameter names replaced by their values, with the gateway verdict."""
    values = shared.select("name", T.parameter_value(F.col("expr")).alias("value")).where(F.col("value").isNotNull())
    first = sources.groupBy("source_key").agg(F.min(F.struct("ord", "kind", "server", "database", "url", "path")).alias("s"))
    out = first.select("source_key", "s.kind", "s.server", "s.database", "s.url", "s.path")
    for slot in ("server", "database", "url", "path"):
        out = out.join(
            values.select(F.col("name").alias(slot), F.col("value").alias(f"{slot}_resolved")), slot, "left"
        )
    server = F.coalesce("server_resolved", "server")
    return out.select(
        "source_key",
        "kind",
        server.alias("server"),
        F.coalesce("database_resolved", "database").alias("database"),
        F.coalesce("url_resolved", "url").alias("url"),
        F.coalesce("path_resolved", "path").alias("path"),
        gateway_needed(F.col("kind"), server, F.col("path")).alias("gateway"),
    )


def physical_tables(queries: DataFrame, lineage: DataFrame) -> DataFrame:
    """tbl, sch, phys_table, path: the relation every BI table loads from.

    ``lineage`` (name, sch, tbl, path) holds the relation each shared query ends at.
    """
    own = queries.select("tbl", T.shared_ref(F.col("m")).alias("name"), T.navigation(F.col("m")).alias("nav"))
    base = lineage.select("name", F.struct("sch", "tbl", "path").alias("base"))
    nav = F.coalesce("base", "nav")
    return (
        own.join(base, "name", "left")
        .select("tbl", nav["sch"].alias("sch"), nav["tbl"].alias("phys_table"), nav["path"].alias("path"))
        .where(F.col("phys_table").isNotNull())
    )


def relationship_blocks(files: DataFrame) -> DataFrame:
    """doc, id, ends, cardinality, active of every relationship in indented model text."""
    block = F.col("block")
    cut = files.select("doc", F.explode(T.blocks(F.col("body"), "relationship")).alias("block"))
    ends = cut.select(
        "doc",
        T.header_name(block, "relationship").alias("id"),
        T.endpoint(T.property_of(block, "fromColumn")).alias("a"),
        T.endpoint(T.property_of(block, "toColumn")).alias("b"),
        F.coalesce(T.property_of(block, "fromCardinality"), F.lit("many")).alias("m"),
        F.coalesce(T.property_of(block, "toCardinality"), F.lit("one")).alias("n"),
        T.property_of(block, "crossFilteringBehavior").alias("cross_filter"),
        (F.coalesce(T.property_of(block, "isActive"), F.lit("true")) != "false").alias("active"),
    )
    return ends.select(
        "doc",
        "id",
        F.col("a.tbl").alias("from_table"),
        F.col("a.col").alias("from_column"),
        F.col("b.tbl").alias("to_table"),
        F.col("b.col").alias("to_column"),
        F.concat_ws(":", "m", "n").alias("cardinality"),
        "cross_filter",
        "active",
    )


def model_relationships(blocks: DataFrame) -> DataFrame:
    """Relationships in the shape the graph operators read."""
    return blocks.select("from_table", "from_column", "to_table", "to_column", "active")


def resolve_column_case(reads: DataFrame, quoted: DataFrame, dialect: str) -> DataFrame:
    """src, sc: a read column in its declared case where its node quotes it, else lower case.

    ``quoted`` (id, col) lists the quoted columns; only some dialects heed the quotes.
    """
    low = F.lower(F.regexp_replace(F.col("sc"), '^["`]+|["`]+$', ""))
    if dialect not in CASE_SENSITIVE_QUOTES:
        return reads.select("src", low.alias("sc"))
    declared = quoted.groupBy(F.col("id").alias("src"), F.lower("col").alias("low")).agg(F.min("col").alias("declared"))
    return reads.select("src", low.alias("low")).join(declared, ["src", "low"], "left").select(
        "src", F.coalesce("declared", "low").alias("sc")
    )
