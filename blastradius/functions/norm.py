"""Scalar rules on names, keys and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of a name (Unicode white
# space, line ends and the byte-order mark).
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def norm(c: Column) -> Column:
    """Identity of a name: trimmed, lower case, null as empty."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def filled(c: Column) -> Column:
    """True where a cell holds something (neither null nor empty)."""
    return F.coalesce(c, F.lit("")) != ""


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def relation_key(*parts: Column) -> Column:
    """Case-insensitive dotted key; at most one quote mark goes at either end of a part."""
    return F.concat_ws(".", *[F.regexp_replace(norm(p), r'^[`"\[]|[`"\]]$', "") for p in parts])


def dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *[norm(p) for p in parts])


def layer_of(resource_type: Column, path: Column) -> Column:
    """Folder path of a node without its file name; sources form a layer of their own."""
    parts = F.filter(
        F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"),
        lambda p: p != "",
    )
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return (
        F.when(resource_type == "source", "sources")
        .when(folder != "", folder)
        .otherwise("models")
    )


def relation_of(database: Column, schema: Column, identifier: Column, name: Column) -> Column:
    ident = F.coalesce(blank_to_null(identifier), blank_to_null(name))
    return F.concat_ws(".", blank_to_null(database), blank_to_null(schema), ident)


def index_table(relation: Column, name: Column) -> Column:
    """Table name a node is indexed under: the last part of its relation, else its name."""
    last = F.substring_index(F.coalesce(relation, F.lit("")), ".", -1)
    return F.coalesce(blank_to_null(last), name)


def field_id_parts(field_id: Column) -> tuple[Column, Column, Column]:
    """``kind:Table.Field`` to (kind, table, field); the last dot separates."""
    has_kind = F.instr(field_id, ":") > 0
    kind = F.when(has_kind, F.substring_index(field_id, ":", 1))
    rest = F.when(has_kind, F.regexp_replace(field_id, r"(?s)^[^:]*:", "")).otherwise(field_id)
    has_dot = F.instr(rest, ".") > 0
    table = F.when(has_dot, F.regexp_replace(rest, r"(?s)\.[^.]*$", ""))
    field = F.when(has_dot, F.substring_index(rest, ".", -1)).otherwise(blank_to_null(rest))
    return kind, table, field


def visual_id_parts(visual_id: Column) -> tuple[Column, Column]:
    """``visual:Page|Name`` to (page, name); the first bar separates."""
    prefixed = F.startswith(visual_id, F.lit("visual:"))
    rest = F.when(prefixed, F.substring(visual_id, 8, 1 << 30)).otherwise(visual_id)
    bar = F.instr(rest, "|") > 0
    page = F.when(prefixed & bar, F.substring_index(rest, "|", 1))
    name = F.when(bar, F.regexp_replace(rest, r"(?s)^[^|]*\|", "")).otherwise(rest)
    return page, name


def clean_column_name(c: Column) -> Column:
    """Column name without wrapping quotes, ``::type`` suffix and one leading dollar sign."""
    bare = F.btrim(F.btrim(F.btrim(c, F.lit('"')), F.lit("'")), F.lit("`"))
    return F.regexp_replace(F.regexp_replace(bare, r"::\s*\w+$", ""), r"^\$", "")


def clean_relation_name(c: Column) -> Column:
    return F.translate(c, '"`', "")


def rename_of(shown: Column, field: Column) -> Column:
    """The label a field is shown under, null when it only repeats the field name."""
    label = strip(F.coalesce(shown, F.lit("")))
    return F.when((label != "") & (F.lower(label) != norm(field)), label)


# Visual counts from which a band applies, highest first.
BANDS = (("high", 10), ("medium", 3), ("low", 1))
BAND_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}


def impact_band(visuals: Column) -> Column:
    out = F.lit(None)
    for name, least in BANDS:
        out = F.when(visuals >= least, name) if name == "high" else out.when(visuals >= least, name)
    return out.otherwise("none")


def band_rank(band: Column) -> Column:
    out = None
    for name, rank in BAND_RANK.items():
        out = F.when(band == name, rank) if out is None else out.when(band == name, rank)
    return out


# How far a derived column is from its source, least to most changed.
LINEAGE_TYPES = ("pass-through", "rename", "transformation")


def lineage_type(is_plain: Column, is_aliased: Column, source: Column, target: Column) -> Column:
    """Class of one select item: a bare column, an aliased column, or anything else."""
    return (
        F.when(is_plain & (~is_aliased | (source == target)), LINEAGE_TYPES[0])
        .when(is_plain, LINEAGE_TYPES[1])
        .otherwise(LINEAGE_TYPES[2])
    )


def lineage_rank(kind: Column) -> Column:
    return (
        F.when(kind == LINEAGE_TYPES[2], 2).when(kind == LINEAGE_TYPES[1], 1).otherwise(0)
    )


def lineage_name(rank: Column) -> Column:
    return F.when(rank == 2, LINEAGE_TYPES[2]).when(rank == 1, LINEAGE_TYPES[1]).otherwise(LINEAGE_TYPES[0])


def source_key(kind: Column, server: Column, database: Column, url: Column, path: Column) -> Column:
    return F.lower(F.concat_ws("|", kind, *[blank_to_null(p) for p in (server, database, url, path)]))


# Connector names by where they run, and host names that mark a
# cloud service.
ON_PREMISES = ("SQL Server", "Oracle", "Teradata", "SAP HANA", "ODBC", "Analysis Services")
FILE_BASED = ("Excel", "CSV")
CLOUD = (
    "Azure Blob Storage", "Dataverse", "Snowflake", "Google BigQuery", "Power BI Dataflow",
    "OData", "SharePoint Tables", "SharePoint Files", "Fabric Lakehouse", "Fabric Warehouse",
    "Azure Data Explorer", "Databricks", "Web", "MySQL", "PostgreSQL",
)
CLOUD_HOST = (
    r"(?i)\.database\.windows\.net|\.sql\.azuresynapse\.net|\.datawarehouse\.fabric\.microsoft\.com"
    r"|\.pbidedicated\.windows\.net|\.asazure\.windows\.net"
)
CLOUD_FILE = r"(?i)sharepoint|onedrive"


def gateway_needed(kind: Column, server: Column, path: Column) -> Column:
    """True on premises, false in the cloud, null where the connector is not known."""
    return (
        F.when(kind.isin(*ON_PREMISES), ~F.coalesce(server, F.lit("")).rlike(CLOUD_HOST))
        .when(kind.isin(*FILE_BASED), ~F.coalesce(path, F.lit("")).rlike(CLOUD_FILE))
        .when(kind.isin(*CLOUD), F.lit(False))
    )


# Dialects in which a quoted column keeps its declared case.
CASE_SENSITIVE_QUOTES = ("snowflake", "postgres", "oracle", "clickhouse", "starrocks")
