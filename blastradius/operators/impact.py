"""Blast radius per node and per column, and what join keys add to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blastradius.functions.norm import band_rank, impact_band, norm
from blastradius.operators.closure import KIND_CODES, StateGraph, closure, column_name, union_all
from blastradius.workspace import Workspace, dealt

COUNTS = {
    "measures": "measure",
    "visuals": "visual",
    "tables": "pbiTable",
    "models": "model",
    "pages": "page",
}


def reached_nodes(graph: StateGraph, columns: DataFrame, kinds: list[str]) -> DataFrame:
    """id, col, reached, exact: nodes of some kinds downstream of every node and declared column.

    ``exact`` holds where a path names the column all along; a node's own reach is
    always exact.
    """
    return (
        graph.reach().pairs({KIND_CODES[k] for k in kinds}, graph.scopes(columns))
        .select("id", "col", F.col("below").alias("reached"), (F.col("col").isNull() | (F.col("w") == 1)).alias("exact"))
    )


def impact(
    ws: Workspace, nodes: DataFrame, edges: DataFrame, columns: DataFrame, graph: StateGraph | None = None
) -> DataFrame:
    """id, col (null for the node itself), counts, visuals_exact, band.

    One row per node and per declared column, zero rows included.
    """
    graph = graph or StateGraph(ws, nodes, edges, columns)
    of = {n: F.col("kind") == KIND_CODES[k] for n, k in COUNTS.items()}
    counts = graph.reach().tally().groupBy("origin").agg(
        *[F.sum(F.when(is_kind, F.col("reached"))).alias(n) for n, is_kind in of.items()],
        F.sum(F.when(of["visuals"], F.col("exact"))).alias("exact"),
    )
    out = graph.scopes(columns).join(counts, "origin", "left").select(
        "id",
        "col",
        *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in COUNTS],
        F.coalesce(F.when(F.col("col").isNull(), F.col("visuals")).otherwise(F.col("exact")), F.lit(0))
        .cast("bigint")
        .alias("visuals_exact"),
    )
    return ws.save(out.withColumn("band", impact_band(F.col("visuals"))), "impact")


# --- Join keys ------------------------------------------------------------------


def relationship_sides(relationships: DataFrame) -> DataFrame:
    """Every relationship listed on both of its endpoint columns."""
    sides = [("from", "to"), ("to", "from")]
    return union_all(
        [
            relationships.select(
                F.col(f"{a}_table").alias("table_id"),
                F.col(f"{a}_column").alias("col"),
                F.col(f"{b}_table").alias("other_table"),
                F.col(f"{b}_column").alias("other_column"),
                F.coalesce("active", F.lit(True)).alias("active"),
            )
            for a, b in sides
        ]
    )


def key_relationships(relationships: DataFrame) -> DataFrame:
    """tkey, ckey, rel, active: the relationships each key column carries.

    Both sides name the same join, so a relationship is its sorted pair of ends.
    """

    def end(table: str, col: str) -> Column:
        return F.concat(norm(F.col(table)), F.lit("["), norm(F.col(col)), F.lit("]"))

    a, b = end("table_id", "col"), end("other_table", "other_column")
    return (
        relationship_sides(relationships)
        .select(
            norm(F.col("table_id")).alias("tkey"),
            norm(F.col("col")).alias("ckey"),
            F.concat_ws("~", F.least(a, b), F.greatest(a, b)).alias("rel"),
            "active",
        )
        .groupBy("tkey", "ckey", "rel")
        .agg(F.max("active").alias("active"))
    )


def key_feeders(
    relationships: DataFrame, depends_on: DataFrame, links: DataFrame, columns: DataFrame
) -> DataFrame:
    """side, id, col, key_table, key_column: what feeds a join key, one step back.

    A key is fed by the columns it is computed from, and by the warehouse columns
    linked to it or to one of those; the walk goes no further.
    """
    keys = (
        relationships.select(F.col("from_table").alias("t"), F.col("from_column").alias("c"))
        .unionByName(relationships.select(F.col("to_table").alias("t"), F.col("to_column").alias("c")))
        .select(norm(F.col("t")).alias("tkey"), norm(F.col("c")).alias("ckey"))
        .distinct()
    )
    declared = columns.select(
        "id", "col", norm(F.col("id")).alias("tkey"), norm(F.col("col")).alias("ckey")
    )
    key_columns = declared.join(dealt(keys), ["tkey", "ckey"])
    itself = key_columns.select("tkey", "ckey", F.col("id").alias("key_table"), F.col("col").alias("key_column"))
    computed_from = depends_on.select(
        norm(F.col("table_id")).alias("tkey"),
        norm(F.col("col")).alias("ckey"),
        norm(F.col("dep_table")).alias("dt"),
        norm(F.col("dep_col")).alias("dc"),
    )
    derived = computed_from.join(dealt(itself), ["tkey", "ckey"]).select(
        F.col("dt").alias("tkey"), F.col("dc").alias("ckey"), "key_table", "key_column"
    )
    serves = itself.unionByName(derived).distinct()
    report = (
        declared.join(dealt(serves), ["tkey", "ckey"])
        .join(dealt(keys), ["tkey", "ckey"], "left_anti")
        .select(F.lit("report").alias("side"), "id", "col", "key_table", "key_column")
    )
    warehouse = (
        links.select(
            norm(F.col("dst")).alias("tkey"),
            norm(F.col("tc")).alias("ckey"),
            F.col("src").alias("id"),
            norm(F.col("sc")).alias("low"),
        )
        .join(dealt(serves), ["tkey", "ckey"])
        .select("id", "low", "key_table", "key_column")
        .distinct()
        .join(dealt(declared.select("id", "col", F.col("ckey").alias("low"))), ["id", "low"])
        .select(F.lit("warehouse").alias("side"), "id", "col", "key_table", "key_column")
    )
    return report.unionByName(warehouse).distinct()


def _tally(held: DataFrame) -> DataFrame:
    """Distinct relationships per column and per node of (id, col, rel, active)."""
    per_column = held.groupBy("id", "col", "rel").agg(F.max("active").alias("active"))
    per_node = per_column.groupBy("id", "rel").agg(F.max("active").alias("active"))
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(~F.col("active")).alias("inactive")]
    return (
        per_column.groupBy("id", "col")
        .agg(*counts)
        .unionByName(
            per_node.groupBy("id").agg(*counts).select("id", F.lit(None).cast("string").alias("col"), "n", "inactive")
        )
    )


def relationship_reach(relationships: DataFrame, feeders: DataFrame, columns: DataFrame) -> DataFrame:
    """Relationships held or fed directly, per column and (col null) per node."""
    rels = key_relationships(relationships)
    own = (
        columns.select("id", "col", norm(F.col("id")).alias("tkey"), norm(F.col("col")).alias("ckey"))
        .join(dealt(rels), ["tkey", "ckey"])
        .select("id", "col", "rel", "active")
    )
    fed = (
        feeders.select(
            "id", "col", norm(F.col("key_table")).alias("tkey"), norm(F.col("key_column")).alias("ckey")
        )
        .join(dealt(rels), ["tkey", "ckey"])
        .select("id", "col", "rel", "active")
    )
    return _tally(own.unionByName(fed)).select(
        "id", "col", F.col("n").alias("relationships"), F.col("inactive").alias("relationships_inactive")
    )


def join_reach(
    ws: Workspace, edges: DataFrame, relationships: DataFrame, columns: DataFrame, direct: DataFrame
) -> DataFrame:
    """Relationships a column ends up in further downstream, where none is held directly.

    Walked backwards from the few key columns, only over edges that name a column
    on both sides.
    """
    at = F.struct(norm(F.col("src")).alias("t"), norm(F.col("sc")).alias("c"))
    to = F.struct(norm(F.col("dst")).alias("t"), norm(F.col("tc")).alias("c"))
    back = edges.where(column_name(F.col("sc")).isNotNull() & column_name(F.col("tc")).isNotNull())
    back = ws.save(back.select(to.alias("src"), at.alias("dst")).distinct(), "named-edges")
    rels = key_relationships(relationships)
    declared = columns.select("id", "col", F.struct(norm(F.col("id")).alias("t"), norm(F.col("col")).alias("c")).alias("v"))
    keys = (
        rels.select(F.struct(F.col("tkey").alias("t"), F.col("ckey").alias("c")).alias("v"))
        .distinct()
        .join(dealt(declared.select("v")), "v", "left_semi")
        .select(F.col("v").alias("origin"), "v")
    )
    found = closure(ws, back, keys, name="join-reach", written=True).select("origin", "v").distinct()
    held = (
        found.select(F.col("origin.t").alias("tkey"), F.col("origin.c").alias("ckey"), "v")
        .join(dealt(rels), ["tkey", "ckey"])
        .join(dealt(declared), "v")
        .select("id", "col", "rel", "active")
    )
    none_held = direct.select("id", F.coalesce("col", F.lit("")).alias("scope"))
    return (
        _tally(held)
        .withColumn("scope", F.coalesce("col", F.lit("")))
        .join(dealt(none_held), ["id", "scope"], "left_anti")
        .select(
            "id",
            "col",
            F.col("n").alias("relationships_downstream"),
            F.col("inactive").alias("relationships_downstream_inactive"),
        )
    )


def band_floor(impact_table: DataFrame, direct: DataFrame, downstream: DataFrame) -> DataFrame:
    """The band with its floor: medium where a key is held or fed, low where one is reached."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("scope", F.coalesce("col", F.lit(""))).drop("col")

    joined = (
        impact_table.withColumn("scope", F.coalesce("col", F.lit("")))
        .join(dealt(keyed(direct)), ["id", "scope"], "left")
        .join(dealt(keyed(downstream)), ["id", "scope"], "left")
        .withColumn("relationships", F.coalesce("relationships", F.lit(0)).cast("bigint"))
        .withColumn("relationships_downstream", F.coalesce("relationships_downstream", F.lit(0)).cast("bigint"))
    )
    wanted = F.when(F.col("relationships") > 0, "medium").when(F.col("relationships_downstream") > 0, "low")
    lifted = wanted.isNotNull() & (band_rank(F.col("band")) < band_rank(wanted))
    reason = (
        F.when(F.col("relationships") == 1, "holds a join key")
        .when(F.col("relationships") > 1, F.format_string("holds %d join keys", "relationships"))
        .otherwise("feeds a join key downstream")
    )
    return joined.select(
        "id",
        "col",
        "visuals",
        "relationships",
        "relationships_downstream",
        F.when(lifted, wanted).otherwise(F.col("band")).alias("band"),
        F.when(lifted, F.col("band")).alias("band_raised_from"),
        F.when(lifted, reason).alias("band_reason"),
    )


def has_lineage(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared columns, marked where an edge of the warehouse side or across names them."""
    named = edges.where(F.col("kind").isin("dbt", "dbt_to_pbi"))
    ends = (
        named.select(F.col("src").alias("id"), norm(F.col("sc")).alias("low"))
        .unionByName(named.select(F.col("dst").alias("id"), norm(F.col("tc")).alias("low")))
        .where(F.col("low") != "")
        .distinct()
        .withColumn("linked", F.lit(True))
    )
    return (
        columns.withColumn("low", norm(F.col("col")))
        .join(dealt(ends), ["id", "low"], "left")
        .select("id", "col", F.coalesce("linked", F.lit(False)).alias("has_lineage"))
    )
