"""Mapping rows and derived relation names, matched to warehouse nodes and BI columns.

"First" always means the lowest value of an explicit order column.  First-of-key
steps are min-aggregations joined back, which combine before the shuffle, so that
a key shared by a large part of the rows never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blastradius.functions.norm import dotted, filled, index_table, norm, relation_key

# Columns of the mapping sheet, their headings, and which must be filled.
MAPPING_COLUMNS = (
    ("from_database", "From Database", True),
    ("from_schema", "From Schema", True),
    ("from_table", "From Table", True),
    ("from_column", "From Column", False),
    ("to_table", "To Table", True),
    ("to_column", "To Column", False),
)
LEVELS = ("database.schema.table", "schema.table", "table")


# --- Mapping rows -----------------------------------------------------------------


def mapping_errors(mapping: DataFrame) -> DataFrame:
    """row_no, message for rows that cannot be read."""
    missing = F.array_join(
        F.array_compact(
            F.array(*[F.when(~filled(F.col(c)), head) for c, head, required in MAPPING_COLUMNS if required])
        ),
        ", ",
    )
    one_sided = filled(F.col("from_column")) != filled(F.col("to_column"))
    message = F.when(missing != "", F.concat(F.lit("missing "), missing)).when(
        one_sided,
        "From Column and To Column must both be filled (column-level row) or both blank (table-level row)",
    )
    return mapping.select("row_no", message.alias("message")).where(F.col("message").isNotNull())


def _readable(mapping: DataFrame) -> DataFrame:
    required = [filled(F.col(c)) for c, _, must in MAPPING_COLUMNS if must]
    ok = filled(F.col("from_column")) == filled(F.col("to_column"))
    for r in required:
        ok = ok & r
    return mapping.where(ok)


def _with_first(mapping: DataFrame) -> DataFrame:
    """Readable rows with the first row of the same mapping."""
    keyed = _readable(mapping).select(
        "*",
        F.struct(
            relation_key(F.col("from_database"), F.col("from_schema"), F.col("from_table")).alias("rel"),
            norm(F.col("from_column")).alias("fc"),
            norm(F.col("to_table")).alias("tt"),
            norm(F.col("to_column")).alias("tc"),
        ).alias("key"),
    )
    first = keyed.groupBy("key").agg(F.min("row_no").alias("first_row"))
    return keyed.join(first, "key")


def mapping_warnings(mapping: DataFrame) -> DataFrame:
    """row_no, message for rows that repeat an earlier one."""
    return (
        _with_first(mapping)
        .where(F.col("row_no") > F.col("first_row"))
        .select("row_no", F.concat(F.lit("duplicate of row "), F.col("first_row"), F.lit(" — ignored")).alias("message"))
    )


def mapping_rows(mapping: DataFrame) -> DataFrame:
    """Rows in force, with ``level`` (column or table) and ``from_key``."""
    return (
        _with_first(mapping)
        .where(F.col("row_no") == F.col("first_row"))
        .select(
            *[c for c in mapping.columns],
            F.when(filled(F.col("from_column")), "column").otherwise("table").alias("level"),
            F.col("key.rel").alias("from_key"),
        )
    )


# --- Relations ----------------------------------------------------------------------


def relation_index(relations: DataFrame) -> DataFrame:
    """Models and sources under three keys, from full to bare name."""
    table = index_table(F.col("relation"), F.col("name"))
    return relations.where(F.col("kind").isin("model", "source")).select(
        "ord",
        "id",
        "name",
        relation_key(F.col("db"), F.col("sch"), table).alias("key3"),
        dotted(F.col("sch"), table).alias("key2"),
        norm(table).alias("key1"),
    )


def resolve_relation(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Adds id, name, match_level, ambiguous to ``requests`` (db, sch, tbl); null where nothing matches.

    Falls back from the full key to the schema and table and to the table alone;
    each level takes the first node under its key.
    """

    def level(key: str, n: int) -> DataFrame:
        first = F.struct("ord", "id", "name")
        return (
            index.where(~F.col(key).isin("", ".."))
            .groupBy(F.col(key).alias(f"k{n}"))
            .agg(F.min(first).alias(f"hit{n}"), F.count(F.lit(1)).alias(f"n{n}"))
        )

    has_table = filled(F.col("tbl"))
    has_schema = has_table & filled(F.col("sch"))
    keyed = requests.select(
        "*",
        F.when(
            has_schema & filled(F.col("db")), relation_key(F.col("db"), F.col("sch"), F.col("tbl"))
        ).alias("k3"),
        F.when(has_schema, dotted(F.col("sch"), F.col("tbl"))).alias("k2"),
        F.when(has_table, norm(F.col("tbl"))).alias("k1"),
    )
    joined = keyed
    for n, key in ((3, "key3"), (2, "key2"), (1, "key1")):
        joined = joined.join(level(key, n), f"k{n}", "left")
    hit = F.coalesce("hit3", "hit2", "hit1")
    count = F.when(F.col("hit3").isNotNull(), F.col("n3")).when(F.col("hit2").isNotNull(), F.col("n2")).otherwise(F.col("n1"))
    at = F.when(F.col("hit3").isNotNull(), LEVELS[0]).when(F.col("hit2").isNotNull(), LEVELS[1]).when(
        F.col("hit1").isNotNull(), LEVELS[2]
    )
    return joined.select(
        *requests.columns,
        hit["id"].alias("id"),
        hit["name"].alias("name"),
        at.alias("match_level"),
        (count > 1).alias("ambiguous"),
    )


def schema_table_unique(relations: DataFrame) -> DataFrame:
    """schema.table keys that only one node answers to."""
    return (
        relations.select(dotted(F.col("sch"), F.col("name")).alias("schema_table"), "id")
        .groupBy("schema_table")
        .agg(F.min("id").alias("id"), F.max("id").alias("last"))
        .where(F.col("id") == F.col("last"))
        .select("schema_table", "id")
    )


# --- Links ----------------------------------------------------------------------------


class Boundary:
    """One match of mapping rows and physical columns against both sides."""

    def __init__(
        self,
        mapping: DataFrame,
        physical: DataFrame,
        index: DataFrame,
        relation_columns: DataFrame,
        model_tables: DataFrame,
        model_columns: DataFrame,
        save=lambda df, name: df,
    ):
        self.tables = model_tables.select(F.col("tbl").alias("target"), norm(F.col("tbl")).alias("tkey"), "has_source")
        self.source_columns = relation_columns.groupBy("id", norm(F.col("col")).alias("ckey")).agg(
            F.min("col").alias("source_column")
        )
        self.target_columns = model_columns.groupBy(norm(F.col("tbl")).alias("tkey"), norm(F.col("col")).alias("ckey")).agg(
            F.min("col").alias("target_column")
        )
        rows = mapping_rows(mapping).select(
            "*", F.col("from_database").alias("db"), F.col("from_schema").alias("sch"), F.col("from_table").alias("tbl")
        )
        self.rows = save(
            resolve_relation(rows, index)
            .withColumn("tkey", norm(F.col("to_table")))
            .join(self.tables.drop("has_source"), "tkey", "left"),
            "mapping-resolved",
        )
        self.physical = save(
            resolve_relation(
                physical.withColumn("tkey", norm(F.col("model_table"))).join(
                    self.claimed().where(F.col("ckey").isNull()), "tkey", "left_anti"
                ),
                index,
            ),
            "physical-resolved",
        )

    def _usable(self) -> DataFrame:
        return self.rows.where(F.col("id").isNotNull() & F.col("target").isNotNull())

    def claimed(self) -> DataFrame:
        """tkey, ckey (null for the whole table): what resolved rows name, found or not."""
        return (
            self._usable()
            .select("tkey", F.when(F.col("level") == "column", norm(F.col("to_column"))).alias("ckey"))
            .distinct()
        )

    def declared_column_links(self) -> DataFrame:
        rows = self._usable().where(F.col("level") == "column").select(
            "id", "tkey", "target", "row_no", norm(F.col("from_column")).alias("fkey"), norm(F.col("to_column")).alias("ckey")
        )
        return (
            rows.join(self.target_columns, ["tkey", "ckey"])
            .join(self.source_columns.withColumnRenamed("ckey", "fkey"), ["id", "fkey"])
            .select("id", "source_column", "target", "target_column", "row_no")
        )

    def declared_table_links(self) -> DataFrame:
        rows = self._usable().where(F.col("level") == "table").select("id", "tkey", "target", "row_no")
        return (
            rows.join(self.source_columns, "id")
            .join(self.target_columns, ["tkey", "ckey"])
            .select("id", "source_column", "target", "target_column", "row_no")
        )

    def derived_links(self) -> DataFrame:
        """Matches by relation name, where no row claims the table or the column."""
        found = self.physical.where(F.col("id").isNotNull()).select(
            "id", "tkey", "match_level", "ord", norm(F.col("col")).alias("fkey"), norm(F.col("model_column")).alias("ckey")
        )
        taken = self.claimed().where(F.col("ckey").isNotNull())
        return (
            found.join(taken, ["tkey", "ckey"], "left_anti")
            .join(self.source_columns.withColumnRenamed("ckey", "fkey"), ["id", "fkey"])
            .join(self.tables.drop("has_source"), "tkey")
            .join(self.target_columns, ["tkey", "ckey"])
            .select("id", "source_column", "target", "target_column", "match_level", "ord")
        )

    def cross_links(self) -> DataFrame:
        """One link per pair of columns; a declared one before a derived one, then the first."""
        declared = self.declared_column_links().unionByName(self.declared_table_links()).select(
            "id", "source_column", "target", "target_column",
            F.struct(
                F.lit(0).alias("rank"),
                F.col("row_no").cast("bigint").alias("ord"),
                F.lit("mapping-row").alias("match_level"),
            ).alias("why"),
        )
        derived = self.derived_links().select(
            "id", "source_column", "target", "target_column",
            F.struct(F.lit(1).alias("rank"), F.col("ord").cast("bigint").alias("ord"), "match_level").alias("why"),
        )
        first = declared.unionByName(derived).groupBy("id", "source_column", "target", "target_column").agg(F.min("why").alias("why"))
        return first.select(
            F.col("id").alias("source"),
            "source_column",
            "target",
            "target_column",
            F.when(F.col("why.rank") == 0, "declared").otherwise("derived").alias("provenance"),
            "why.match_level",
            F.when(F.col("why.rank") == 0, F.col("why.ord")).alias("mapping_row"),
        )

    # --- What did not match ---

    def unresolved_rows(self) -> DataFrame:
        """row_no, reason for rows that are read but lead nowhere."""
        usable = self._usable()
        linked = self.declared_column_links().unionByName(self.declared_table_links()).select("row_no").distinct()
        unlinked = usable.join(linked, "row_no", "left_anti")
        no_model = F.concat_ws("", F.lit("no dbt model builds "), F.concat_ws(".", "from_database", "from_schema", "from_table"))
        no_table = F.concat(F.lit('semantic model has no table named "'), F.col("to_table"), F.lit('"'))
        no_column = F.concat(F.lit("column not found on one side ("), F.col("from_column"), F.lit(" -> "), F.col("to_column"), F.lit(")"))
        no_match = F.concat(
            F.lit("table-level row matched 0 columns by name between "), F.col("name"), F.lit(' and "'), F.col("target"), F.lit('"')
        )
        return (
            self.rows.where(F.col("id").isNull() | F.col("target").isNull())
            .select("row_no", F.when(F.col("id").isNull(), no_model).otherwise(no_table).alias("reason"))
            .unionByName(unlinked.select("row_no", F.when(F.col("level") == "column", no_column).otherwise(no_match).alias("reason")))
        )

    def ambiguous(self) -> DataFrame:
        """origin, ord, relation, match_level: every match that more than one node answers to."""

        def out(df: DataFrame, origin: Column, ord_: str, relation: Column) -> DataFrame:
            return df.where("ambiguous").select(
                origin.alias("origin"), F.col(ord_).cast("bigint").alias("ord"), relation.alias("relation"), "match_level"
            )

        parts = [F.when(F.col(c) != "", F.col(c)) for c in ("db", "sch", "tbl")]
        return out(
            self.rows,
            F.concat(F.lit("mapping row "), F.col("row_no")),
            "row_no",
            F.concat_ws(".", "from_database", "from_schema", "from_table"),
        ).unionByName(
            out(self.physical, F.concat(F.lit("auto match for "), F.col("model_table")), "ord", F.concat_ws(".", *parts))
        )

    def tables_without_source(self) -> DataFrame:
        return (
            self.tables.where(~F.col("has_source"))
            .join(self.claimed().where(F.col("ckey").isNull()), "tkey", "left_anti")
            .select(F.col("target").alias("tbl"))
        )


def multi_source_columns(links: DataFrame, index: DataFrame) -> DataFrame:
    """Columns declared to come from several places, one row per source."""
    declared = links.where(F.col("provenance") == "declared")
    several = (
        declared.groupBy("target", "target_column").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") > 1)
    )
    names = index.select(F.col("id").alias("source"), "name")
    return (
        declared.join(several, ["target", "target_column"])
        .join(names, "source")
        .select(
            F.col("target").alias("tbl"),
            F.col("target_column").alias("col"),
            F.concat("name", F.lit("["), "source_column", F.lit("]")).alias("source"),
            "mapping_row",
            "sources",
        )
    )
