"""Queries that read artifacts: mapping sheets, project documents, report definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from blastradius.functions.norm import blank_to_null
from blastradius.operators import references as R
from blastradius.operators import rollup as U
from blastradius.plans.registry import Context, query
from blastradius.sources import artifacts as A
from blastradius.sources import mapping_csv as S

# --- Mapping sheets ---------------------------------------------------------------------

SHEET = r"""
fx_lines as (select doc, list_filter(regexp_split_to_array(body, '\r?\n'), lambda x: trim(x) <> '') as lines from fx_mapping_csv),
fx_heads as (select doc, lines, list_transform(string_split(lines[1], ','), lambda x: regexp_replace(lower(trim(x)), '[\s_]+', ' ', 'g')) as heads from fx_lines),
fx_line as (select doc, heads, unnest(lines[2:]) as line, unnest(generate_series(2, len(lines))) as row_no from fx_heads),
fx_cells as (select doc, row_no, heads, list_transform(regexp_extract_all(line, '(?:^|,)(\s*"(?:[^"]|"")*"\s*|[^,"]*)', 1),
  lambda x: trim(replace(case when trim(x) like '"%"' then trim(x)[2:-2] else trim(x) end, '""', '"'))) as cs from fx_line)"""


def sheet_cell(name: str, head: str) -> str:
    return f"coalesce(case when list_position(heads, '{head}') > 0 then cs[list_position(heads, '{head}')] end, '') as {name}"


@query(
    "mapping_scan",
    SHEET + " /*main*/ select doc, row_no, " + ", ".join(sheet_cell(k, h.lower()) for k, h, _ in S.MAPPING_COLUMNS) + " from fx_cells",
)
def mapping_scan(c: Context):
    """Rows of all mapping sheets."""
    return S.mapping_scan(c.mapping_csv)


@query(
    "mapping_scan_errors",
    SHEET + """ /*main*/ select doc, missing from (select doc, concat_ws(', ', case when list_position(heads, 'from database') is null then 'From Database' end,
case when list_position(heads, 'from schema') is null then 'From Schema' end, case when list_position(heads, 'from table') is null then 'From Table' end,
case when list_position(heads, 'to table') is null then 'To Table' end) as missing from fx_heads) t where missing <> ''""",
)
def mapping_scan_errors(c: Context):
    """Sheets that lack a required heading."""
    return S.mapping_scan_errors(c.mapping_csv)


# --- Projects -------------------------------------------------------------------------------

ENTRIES = """
fx_node as (select m.doc, 'nodes' as part, k.key as node_id, k.value as v from fx_manifest_json m, json_each(m.body, '$.nodes') k
  union all select m.doc, 'sources', k.key, k.value from fx_manifest_json m, json_each(m.body, '$.sources') k
  union all select m.doc, 'exposures', k.key, k.value from fx_manifest_json m, json_each(m.body, '$.exposures') k),
fx_test as (select doc, v->>'attached_node' as node_id, coalesce(v->>'column_name', '__model__') as col, coalesce(v->>'$.test_metadata.name', v->>'name') as test,
  coalesce(v->>'$.config.severity', 'error') as severity from fx_node where part = 'nodes' and v->>'resource_type' = 'test' and v->>'attached_node' is not null),
fx_mnode as (select doc, 'dbt:'||node_id as id, case when v->>'resource_type' = 'source' then 'source' else 'model' end as kind, v->>'name' as name,
    case when v->>'resource_type' = 'source' then 'sources' when v->>'path' like '%/%' then regexp_replace(v->>'path', '/[^/]*$', '') else 'models' end as layer,
    v->>'resource_type' as resource_type, v->>'$.config.materialized' as materialized, v->>'database' as database, v->>'schema' as schema,
    concat_ws('.', v->>'database', v->>'schema', coalesce(v->>'identifier', v->>'name')) as relation, nullif(v->>'description', '') as description, v->>'source_name' as source_name,
    (select count(*) from fx_test t where t.doc = n.doc and t.node_id = n.node_id) as test_count
  from fx_node n where part in ('nodes', 'sources') and v->>'resource_type' not in ('test', 'macro', 'operation', 'analysis'))"""
CATALOG = """
fx_cat as (select c.doc, 'nodes' as part, k.key as node_id, j.key as col, j.value->>'type' as type, cast(j.value->>'index' as int) as ordinal
    from fx_catalog_json c, json_each(c.body, '$.nodes') k, json_each(k.value, '$.columns') j
  union all select c.doc, 'sources', k.key, j.key, j.value->>'type', cast(j.value->>'index' as int) from fx_catalog_json c, json_each(c.body, '$.sources') k, json_each(k.value, '$.columns') j)"""


def project_nodes(c: Context):
    return c.shared("project_nodes", lambda c: c.ws.save(A.manifest_nodes(c.manifest_json), "manifest-nodes"))


@query("manifest_nodes", ENTRIES + " /*main*/ select * from fx_mnode")
def manifest_nodes(c: Context):
    """Nodes of all projects."""
    return project_nodes(c)


@query(
    "parse_failures",
    """/*main*/ select doc, case when not json_valid(body) or json_type(body) <> 'OBJECT' then 'not a JSON object' else 'no '||part end as reason
from (select doc, coalesce(body, '') as body, unnest(['nodes', 'sources']) as part from fx_delivered_json) t
where case when not json_valid(body) or json_type(body) <> 'OBJECT' then part = 'nodes' else not list_contains(json_keys(body), part) end""",
)
def parse_failures(c: Context):
    """Delivered manifests that can't be read whole."""
    return A.parse_failures(c.delivered_json, "nodes", "sources")


@query("catalog_columns", CATALOG + " /*main*/ select doc, part, node_id, col, type, ordinal from fx_cat")
def catalog_columns(c: Context):
    """Columns the warehouse catalogs hold."""
    return A.catalog_columns(c.catalog_json)


@query("test_index", ENTRIES + " /*main*/ select doc, node_id, col, test, severity from fx_test")
def test_index(c: Context):
    """Tests by node and column."""
    return A.test_index(c.manifest_json)


@query(
    "column_union",
    ENTRIES + "," + CATALOG + """,
fx_mcol as (select n.doc, n.node_id, j.key as col, j.value->>'data_type' as data_type, j.value->>'description' as description
  from fx_node n, json_each(n.v, '$.columns') j where n.part in ('nodes', 'sources')) /*main*/
select coalesce(m.node_id, k.node_id) as node_id, coalesce(m.col, k.col) as col, coalesce(nullif(m.data_type, ''), k.type) as data_type, nullif(m.description, '') as description, k.ordinal
from fx_mcol m full join (select * from fx_cat c where exists (select 1 from fx_node n where n.doc = c.doc and n.node_id = c.node_id and n.part <> 'exposures')) k
  on k.doc = m.doc and k.node_id = m.node_id and k.col = m.col""",
)
def column_union(c: Context):
    """Columns of project documentation and catalog together."""
    return A.column_union(c.manifest_json, c.catalog_json)


@query(
    "project_validation",
    ENTRIES + "," + CATALOG + """ /*main*/ select doc, count(*) as models, count(case when coalesce(v->>'compiled_code', '') = '' then 1 end) as missing_compiled,
count(case when not held and v->>'$.config.materialized' = 'ephemeral' then 1 end) as ephemeral_missing, count(case when not held and v->>'$.config.materialized' <> 'ephemeral' then 1 end) as catalog_missing
from (select n.*, exists (select 1 from fx_cat c where c.doc = n.doc and c.node_id = n.node_id and c.part = 'nodes') as held from fx_node n where n.part = 'nodes' and v->>'resource_type' = 'model') t group by 1""",
)
def project_validation(c: Context):
    """Models without compiled text and models the catalog lacks, per project."""
    n = F.col("node")
    nodes = A.manifest_entries(c.manifest_json, "nodes").select(
        "doc",
        "node_id",
        n["resource_type"].alias("resource_type"),
        blank_to_null(n["compiled_code"]).isNotNull().alias("compiled"),
        n["config"]["materialized"].alias("materialized"),
    )
    return U.project_validation(nodes, A.catalog_columns(c.catalog_json).where(F.col("part") == "nodes"))


def declared(c: Context):
    n = F.col("node")
    entries = A.manifest_entries(c.manifest_json, "nodes", "sources", "exposures")
    return entries.select(n["resource_type"].alias("resource_type"), n["name"].alias("name")).where(
        F.col("resource_type").isNotNull() & ~F.col("resource_type").isin(*A.NOT_LISTED)
    )


@query(
    "resource_tree",
    ENTRIES + """ /*main*/ select resource, case resource when 'analysis' then 'analyses' else resource||'s' end as label, coalesce(n, 0) as nodes, coalesce(d, 0) as declared, coalesce(n, 0) = 0 as is_empty,
cast(case resource when 'model' then 0 when 'source' then 1 when 'snapshot' then 2 when 'seed' then 3 when 'exposure' then 4 when 'analysis' then 5 when 'test' then 6 else 99 end as int) as place
from (select v->>'resource_type' as resource, count(*) as d from fx_node group by 1) a full join (select resource_type as resource, count(*) as n from fx_mnode group by 1) b using (resource)""",
)
def resource_tree(c: Context):
    """Resource types in the graph and those only declared."""
    return U.resource_tree(project_nodes(c), declared(c))


@query(
    "declared_names",
    ENTRIES + " /*main*/ select v->>'resource_type' as resource, v->>'name' as name from fx_node n where not exists (select 1 from fx_mnode m where m.resource_type = n.v->>'resource_type')",
)
def declared_names(c: Context):
    """Names declared under types without a node in the graph."""
    return U.declared_names(project_nodes(c), declared(c))


@query(
    "source_groups",
    ENTRIES + " /*main*/ select coalesce(source_name, schema, 'ungrouped') as source_name, count(*) as nodes from fx_mnode where kind = 'source' group by 1",
)
def source_groups(c: Context):
    """Sources by declared name, else schema."""
    return U.source_groups(project_nodes(c))


@query(
    "parent_schema",
    CATALOG + """ /*main*/ select model, parent, case when n is not null then 'nodes' when s is not null then 'sources' when d is not null then 'derived' else 'missing' end as origin,
cast(coalesce(n, s, d, 0) as bigint) as columns from (select distinct model, parent,
  (select nullif(count(*), 0) from fx_cat c where c.node_id = p.parent and c.part = 'nodes') as n, (select nullif(count(*), 0) from fx_cat c where c.node_id = p.parent and c.part = 'sources') as s,
  (select nullif(count(*), 0) from fx_derived_columns d where d.node = p.parent) as d from fx_parents p) t""",
)
def parent_schema(c: Context):
    """Where the columns of every parent are taken from."""
    return R.parent_schemas(c.parents, A.catalog_columns(c.catalog_json), c.derived_columns)


RELKEYS = """
fx_full as (select lower(db||'.'||sch||'.'||name) as key3, min(id) as id from fx_relations group by 1),
fx_pair as (select lower(sch||'.'||name) as key2, min(id) as id from fx_relations group by 1 having count(distinct id) = 1)"""


@query(
    "table_ref_resolve",
    RELKEYS + """ /*main*/ select r.id, r.cat, r.db, r.tbl, r.raw_code, coalesce(f.id, p.id,
  case when contains(lower(raw_code), cat||'.'||r.db||'.'||tbl) or contains(lower(raw_code), lower(r.db||'.'||tbl)) or contains(lower(raw_code), lower(tbl)) then '_HARDCODED_REF___' else '_NOT_FOUND___' end
    ||lower(cat||'.'||r.db||'.'||tbl)) as node
from fx_table_refs r left join fx_full f on f.key3 = lower(cat||'.'||r.db||'.'||tbl) left join fx_pair p on cat = '' and r.db <> '' and p.key2 = lower(r.db||'.'||tbl) where cat <> '' or r.db <> ''""",
)
def table_ref_resolve(c: Context):
    """Table references of queries matched to project nodes."""
    return R.table_ref_resolve(c.table_refs, c.relations)


# --- Reports ------------------------------------------------------------------------------------

USES = """
fx_well as (select v.visual, k.key as role, k.value as w, k.rowid as wr from fx_visual_json v, json_each(v.body, '$.visual.query.queryState') k),
fx_raw as (select visual, role, p.value->'field' as f, p.value->>'displayName' as shown, wr * 1000 + p.rowid * 2 as pos from fx_well, json_each(w, '$.projections') p
  union all select visual, role, p.value->'parameterExpr', null, wr * 1000 + 500 + p.rowid from fx_well, json_each(w, '$.fieldParameters') p
  union all select v.visual, 'sort', p.value->'field', null, 1000000000 + p.rowid from fx_visual_json v, json_each(v.body, '$.visual.query.sortDefinition.sort') p
  union all select v.visual, 'filter', p.value->'field', null, 2000000000 + p.rowid from fx_visual_json v, json_each(v.body, '$.filterConfig.filters') p),
fx_uses as (select visual, role, shown, pos, case when (f->'Column') is not null then 'column' when (f->'Measure') is not null then 'measure' else 'hierarchy' end as type,
    coalesce(f->>'$.Column.Expression.SourceRef.Entity', f->>'$.Measure.Expression.SourceRef.Entity', f->>'$.Hierarchy.Expression.SourceRef.Entity') as tbl,
    coalesce(f->>'$.Column.Property', f->>'$.Measure.Property', f->>'$.Hierarchy.Hierarchy') as field from fx_raw),
fx_label as (select *, case when trim(coalesce(shown, '')) <> '' and lower(trim(shown)) <> lower(trim(field)) then trim(shown) end as label from fx_uses where tbl is not null and field is not null)"""


@query(
    "visual_fields",
    USES + """ /*main*/ select visual, type, tbl, field, arg_min(role, pos) as role, arg_min(label, pos) filter (where label is not null) as display, count(label) as renames
from fx_label group by 1, 2, 3, 4""",
)
def visual_fields(c: Context):
    """Fields of every visual definition."""
    return A.visual_fields(c.visual_json)


@query(
    "parameter_selections",
    """select visual, p.value->>'$.parameterExpr.Column.Expression.SourceRef.Entity' as param, cast(p.value->>'index' as int) as selected
from (select v.visual, k.value as w from fx_visual_json v, json_each(v.body, '$.visual.query.queryState') k) t, json_each(w, '$.fieldParameters') p""",
)
def parameter_selections(c: Context):
    """Row of each field parameter a visual was saved on."""
    return A.parameter_selections(c.visual_json)


@query(
    "visual_title",
    """select visual, coalesce(trim(body->>'$.visual.visualContainerObjects.title[0].properties.text.expr.Literal.Value', ''''),
trim(body->>'$.visual.visualContainerObjects.general[0].properties.title.expr.Literal.Value', ''''), body->>'$.visual.visualType') as title from fx_visual_json""",
)
def visual_title(c: Context):
    """Title of every visual."""
    return A.visual_titles(c.visual_json)


PAGES = f"""
fx_page as (select p.report, p.page_id, coalesce(nullif(p.body->>'displayName', ''), p.page_id) as name, cast(coalesce(p.body->>'width', '1280') as int) as width,
    cast(coalesce(p.body->>'height', '720') as int) as height, coalesce(p.body->>'visibility' <> 'AlwaysVisible', false) as hidden,
    coalesce(list_position(cast(r.body->'pageOrder' as varchar[]), coalesce(p.body->>'name', p.page_id)) - 1, {A.LAST}) as place,
    coalesce(p.body->>'name', p.page_id) = r.body->>'landingPageName' as is_landing
  from fx_page_json p join fx_pages_json r on r.report = p.report)"""


def report_pages(c: Context):
    return A.page_scan(c.page_json, c.pages_json)


@query("page_scan", PAGES + " /*main*/ select report, page_id, name, width, height, hidden, cast(place as bigint) as place, is_landing from fx_page")
def page_scan(c: Context):
    """Pages of all reports."""
    return report_pages(c)


@query("page_order", PAGES + " /*main*/ select report, name, cast(place as bigint) as place from fx_page order by report, place, name")
def page_order(c: Context):
    """Pages in the order their author gave them."""
    return A.page_order(report_pages(c)).select("report", "name", "place")
