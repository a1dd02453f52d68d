"""Search over nodes and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_index(nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per node and per column: id, col, label, hint, facet, layer, tags, aliases.

    Tags are the node's, for its columns too.  Aliases are other names a row is found
    by: the node's own ``aliases`` and, for a column, those of ``columns``.
    """
    none = F.array().cast("array<string>")
    tags = F.coalesce("tags", none).alias("tags")
    own = F.col("kind")
    report = F.col("origin") == "pbi"
    node_facet = (
        F.when(report & own.isin("measure", "visual", "page"), own).when(report, "pbiTable").otherwise("dbtModel")
    )
    column_facet = (
        F.when(report & own.isin("measure", "visual", "page"), own).when(report, "pbiColumn").otherwise("dbtColumn")
    )
    rows = nodes.select(
        "id",
        F.lit(None).cast("string").alias("col"),
        F.col("name").alias("label"),
        F.when(own == "measure", F.coalesce("home_table", F.lit("")))
        .otherwise(F.coalesce("relation", "layer"))
        .alias("hint"),
        node_facet.alias("facet"),
        "layer",
        tags,
        F.coalesce("aliases", none).alias("aliases"),
    )
    own_names = columns.select("id", "col", F.coalesce("aliases", none).alias("aliases"))
    cols = own_names.join(nodes.drop("aliases"), "id").select(
        "id", "col", F.col("col").alias("label"), F.col("name").alias("hint"), column_facet.alias("facet"), "layer", tags, "aliases"
    )
    return rows.unionByName(cols)


def search_rank(
    index: DataFrame,
    needle: str,
    facets: list[str] | None = None,
    layers: list[str] | None = None,
    tags: list[str] | None = None,
    top: int | None = None,
) -> DataFrame:
    """Rows that match, best first: a prefix before a substring, a name before an alias.

    Facets, layers and tags all restrict; of the tags any one will do.  Without a
    needle every row left is of the same band; a request that asks for nothing finds
    nothing.  With ``top``, the best so many rows, found without sorting the others.
    """
    text = needle.strip().lower()
    rows = index if text or facets or layers or tags else index.where(F.lit(False))
    if facets:
        rows = rows.where(F.col("facet").isin(*facets))
    if layers:
        rows = rows.where(F.col("layer").isin(*layers))
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    hay = F.lower("label")
    starts = F.filter("aliases", lambda a: F.startswith(F.lower(a), F.lit(text)))
    within = F.filter("aliases", lambda a: F.contains(F.lower(a), F.lit(text)))
    if text:
        band = (
            F.when(F.startswith(hay, F.lit(text)), 0)
            .when(F.size(starts) > 0, 1)
            .when(F.contains(hay, F.lit(text)), 2)
            .when(F.size(within) > 0, 3)
        )
    else:
        band = F.lit(1)
    alias = F.when(F.col("band") == 1, F.try_element_at(starts, F.lit(1))).when(
        F.col("band") == 3, F.try_element_at(within, F.lit(1))
    )
    ranked = (
        rows.withColumn("band", band)
        .where(F.col("band").isNotNull())
        .select("*", F.length("label").alias("label_length"), (alias if text else F.lit(None).cast("string")).alias("matched_alias"))
        .orderBy("band", "label_length", "label", "id", "col")
    )
    return ranked if top is None else ranked.limit(top)
