"""Readers of project and report artifacts (JSON text, one document per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blastradius.functions.norm import blank_to_null, layer_of, relation_of, rename_of
from blastradius.functions.text import literal_title


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc, body: whole files below ``path`` (a glob is fine)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("doc"), F.col("value").alias("body")
    )


def parse_failures(docs: DataFrame, *parts: str) -> DataFrame:
    """doc, reason: documents whose text is no whole JSON object, and top-level parts that a document lacks.

    Readers give no rows for either.  A null text is no JSON object.
    """
    keys = F.json_object_keys("body")
    lacks = F.concat(*[F.when(F.array_contains(keys, p), F.array()).otherwise(F.array(F.lit(f"no {p}"))) for p in parts])
    return docs.select("doc", F.explode(F.when(keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(lacks)).alias("reason"))


# Fields read from the documents; all others are skipped while parsing.
NODE = (
    "struct<resource_type:string, name:string, identifier:string, database:string, schema:string, path:string, "
    "description:string, tags:array<string>, source_name:string, compiled_code:string, attached_node:string, "
    "column_name:string, test_metadata:struct<name:string>, config:struct<materialized:string, severity:string>, "
    "columns:map<string, struct<data_type:string, description:string, quote:boolean>>>"
)
MANIFEST = f"nodes map<string, {NODE}>, sources map<string, {NODE}>, exposures map<string, {NODE}>"
COLUMNS = "map<string, struct<columns:map<string, struct<type:string, `index`:int>>>>"
CATALOG = f"nodes {COLUMNS}, sources {COLUMNS}"

# Resource types that are no nodes of the graph, and that are not listed at all.
NOT_NODES = ("test", "macro", "operation", "analysis")
NOT_LISTED = ("macro", "operation")


def manifest_entries(docs: DataFrame, *parts: str) -> DataFrame:
    """doc, node_id, node of the named parts of all manifests."""
    parsed = docs.select("doc", F.from_json("body", MANIFEST).alias("m"))
    none = F.array().cast(f"array<struct<key:string, value:{NODE}>>")
    entries = F.concat(*[F.coalesce(F.map_entries(F.col("m")[part]), none) for part in parts])
    return parsed.select("doc", F.explode(entries).alias("e")).select(
        "doc", F.col("e.key").alias("node_id"), F.col("e.value").alias("node")
    )


def manifest_nodes(docs: DataFrame) -> DataFrame:
    """One row per model-like node and source, with its number of tests."""
    n = F.col("node")
    tests = test_index(docs).groupBy("doc", F.col("node_id")).agg(F.count(F.lit(1)).alias("test_count"))
    kept = manifest_entries(docs, "nodes", "sources").where(
        ~F.coalesce(n["resource_type"], F.lit("")).isin(*NOT_NODES)
    )
    return kept.join(tests, ["doc", "node_id"], "left").select(
        "doc",
        F.concat(F.lit("dbt:"), "node_id").alias("id"),
        F.when(n["resource_type"] == "source", "source").otherwise("model").alias("kind"),
        F.coalesce(blank_to_null(n["name"]), F.substring_index("node_id", ".", -1)).alias("name"),
        layer_of(n["resource_type"], n["path"]).alias("layer"),
        n["resource_type"].alias("resource_type"),
        n["config"]["materialized"].alias("materialized"),
        n["database"].alias("database"),
        n["schema"].alias("schema"),
        relation_of(n["database"], n["schema"], n["identifier"], n["name"]).alias("relation"),
        blank_to_null(n["description"]).alias("description"),
        n["source_name"].alias("source_name"),
        F.coalesce("test_count", F.lit(0)).cast("bigint").alias("test_count"),
    )


def test_index(docs: DataFrame) -> DataFrame:
    """doc, node_id, col, test, severity of every attached test; ``__model__`` stands for the node."""
    n = F.col("node")
    return (
        manifest_entries(docs, "nodes")
        .where((n["resource_type"] == "test") & (F.coalesce(n["attached_node"], F.lit("")) != ""))
        .select(
            "doc",
            n["attached_node"].alias("node_id"),
            F.coalesce(blank_to_null(n["column_name"]), F.lit("__model__")).alias("col"),
            F.coalesce(blank_to_null(n["test_metadata"]["name"]), n["name"]).alias("test"),
            F.coalesce(n["config"]["severity"], F.lit("error")).alias("severity"),
        )
    )


def manifest_columns(docs: DataFrame) -> DataFrame:
    return (
        manifest_entries(docs, "nodes", "sources")
        .select("doc", "node_id", F.explode("node.columns").alias("col", "meta"))
        .select("doc", "node_id", "col", "meta.data_type", "meta.description", "meta.quote")
    )


def catalog_columns(docs: DataFrame) -> DataFrame:
    """doc, node_id, part, col, type, ordinal of all catalogs."""
    parsed = docs.select("doc", F.from_json("body", CATALOG).alias("c"))
    parts = [
        parsed.select("doc", F.lit(part).alias("part"), F.explode(f"c.{part}").alias("node_id", "entry"))
        for part in ("nodes", "sources")
    ]
    return (
        parts[0]
        .unionByName(parts[1])
        .select("doc", "part", "node_id", F.explode("entry.columns").alias("col", "meta"))
        .select("doc", "part", "node_id", "col", "meta.type", F.col("meta.index").alias("ordinal"))
    )


def column_union(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns of either; documentation from the manifest, types filled from the catalog.

    The catalog speaks only for nodes the manifests know.  Order within a node:
    ordinal with nulls last, then name.
    """
    docs = manifest_columns(manifest)
    known = manifest_entries(manifest, "nodes", "sources").select("doc", "node_id")
    stored = catalog_columns(catalog).join(known, ["doc", "node_id"], "left_semi").drop("part")
    return docs.join(stored, ["doc", "node_id", "col"], "full_outer").select(
        "node_id",
        "col",
        F.coalesce(blank_to_null(F.col("data_type")), "type").alias("data_type"),
        blank_to_null(F.col("description")).alias("description"),
        "ordinal",
    )


# --- Report definitions -------------------------------------------------------------------

_FIELD = (
    "struct<Column:struct<Expression:struct<SourceRef:struct<Entity:string>>, Property:string>, "
    "Measure:struct<Expression:struct<SourceRef:struct<Entity:string>>, Property:string>, "
    "Hierarchy:struct<Expression:struct<SourceRef:struct<Entity:string>>, Hierarchy:string>>"
)
_LITERAL = "struct<expr:struct<Literal:struct<Value:string>>>"
VISUAL = (
    "name string, visual struct<visualType:string, "
    f"visualContainerObjects:struct<title:array<struct<properties:struct<text:{_LITERAL}>>>, general:array<struct<properties:struct<title:{_LITERAL}>>>>, "
    f"query:struct<queryState:map<string, struct<projections:array<struct<field:{_FIELD}, displayName:string>>, "
    f"fieldParameters:array<struct<parameterExpr:{_FIELD}, `index`:int>>>>, sortDefinition:struct<sort:array<struct<field:{_FIELD}>>>>>, "
    f"filterConfig struct<filters:array<struct<field:{_FIELD}>>>"
)


def _use(field: Column, role: Column, shown: Column) -> Column:
    """{type, tbl, field, role, shown} of one field reference."""

    def one(kind: str, ref: str, name: str) -> Column:
        return F.when(
            field[ref].isNotNull(),
            F.struct(
                F.lit(kind).alias("type"),
                field[ref]["Expression"]["SourceRef"]["Entity"].alias("tbl"),
                field[ref][name].alias("field"),
                role.alias("role"),
                shown.alias("shown"),
            ),
        )

    return F.coalesce(
        one("column", "Column", "Property"), one("measure", "Measure", "Property"), one("hierarchy", "Hierarchy", "Hierarchy")
    )


def _all_uses(v: Column) -> Column:
    nothing = F.lit(None).cast("string")

    def some(xs: Column) -> Column:
        return F.coalesce(xs, F.array())

    state = F.map_entries(v["visual"]["query"]["queryState"])
    wells = F.flatten(
        F.transform(
            state,
            lambda e: F.concat(
                some(F.transform(e["value"]["projections"], lambda p: _use(p["field"], e["key"], p["displayName"]))),
                some(F.transform(e["value"]["fieldParameters"], lambda p: _use(p["parameterExpr"], e["key"], nothing))),
            ),
        )
    )
    sorts = F.transform(v["visual"]["query"]["sortDefinition"]["sort"], lambda s: _use(s["field"], F.lit("sort"), nothing))
    filters = F.transform(v["filterConfig"]["filters"], lambda s: _use(s["field"], F.lit("filter"), nothing))
    return F.concat(some(wells), some(sorts), some(filters))


def visual_fields(definitions: DataFrame) -> DataFrame:
    """visual, type, tbl, field, role, display: fields of every visual, once each.

    The first reference gives the role; the first real rename among all references
    gives the label, so that order between them does not matter.
    """
    parsed = definitions.select("visual", F.from_json("body", VISUAL).alias("v"))
    uses = parsed.select("visual", F.posexplode(_all_uses(F.col("v"))).alias("pos", "u")).select("visual", "pos", "u.*")
    complete = uses.where((F.col("tbl") != "") & (F.col("field") != ""))
    label = rename_of(F.col("shown"), F.col("field"))
    return complete.groupBy("visual", "type", "tbl", "field").agg(
        F.min_by("role", "pos").alias("role"),
        F.min_by(label, F.when(label.isNotNull(), F.col("pos"))).alias("display"),
        F.count(label).alias("renames"),
    )


def parameter_selections(definitions: DataFrame) -> DataFrame:
    """visual, param, selected: row of each field parameter a visual was saved on."""
    state = F.map_values(F.from_json("body", VISUAL)["visual"]["query"]["queryState"])
    rows = definitions.select("visual", F.explode(F.flatten(F.filter(state["fieldParameters"], lambda x: x.isNotNull()))).alias("p"))
    ref = F.col("p.parameterExpr")
    return rows.select(
        "visual",
        F.coalesce(ref["Column"]["Expression"]["SourceRef"]["Entity"], ref["Measure"]["Expression"]["SourceRef"]["Entity"]).alias("param"),
        F.col("p.index").alias("selected"),
    ).where(F.col("param").isNotNull() & F.col("selected").isNotNull())


def visual_titles(definitions: DataFrame) -> DataFrame:
    """visual, title: its own title, its general title, or its type."""
    v = F.from_json("body", VISUAL)["visual"]
    objects = v["visualContainerObjects"]
    title = F.try_element_at(objects["title"], F.lit(1))["properties"]["text"]["expr"]["Literal"]["Value"]
    general = F.try_element_at(objects["general"], F.lit(1))["properties"]["title"]["expr"]["Literal"]["Value"]
    return definitions.select(
        "visual",
        F.coalesce(
            literal_title(blank_to_null(title)), literal_title(blank_to_null(general)), v["visualType"], F.lit("unknown")
        ).alias("title"),
    )


PAGES = "pageOrder array<string>, landingPageName string"
PAGE = "name string, displayName string, width int, height int, visibility string"
LAST = 9007199254740991


def page_scan(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """Pages with the place their author gave them; a page the report does not order comes last."""
    order = reports.select("report", F.from_json("body", PAGES).alias("r"))
    page = F.col("p")
    key = F.coalesce(blank_to_null(page["name"]), F.col("page_id"))
    place = F.array_position(F.coalesce("r.pageOrder", F.array().cast("array<string>")), key)
    return (
        pages.select("report", "page_id", F.from_json("body", PAGE).alias("p"))
        .join(order, "report", "left")
        .select(
            "report",
            "page_id",
            F.coalesce(blank_to_null(page["displayName"]), F.col("page_id")).alias("name"),
            F.coalesce(page["width"], F.lit(1280)).alias("width"),
            F.coalesce(page["height"], F.lit(720)).alias("height"),
            F.coalesce((page["visibility"] != "") & (page["visibility"] != "AlwaysVisible"), F.lit(False)).alias("hidden"),
            F.when(place > 0, place - 1).otherwise(F.lit(LAST)).cast("bigint").alias("place"),
            F.coalesce(key == F.col("r.landingPageName"), F.lit(False)).alias("is_landing"),
        )
    )


def page_order(pages: DataFrame) -> DataFrame:
    return pages.orderBy("report", "place", "name", "page_id")
