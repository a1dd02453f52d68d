"""Queries that read formula, query and model text."""

from __future__ import annotations

from pyspark.sql import functions as F

from blastradius.functions import norm as N
from blastradius.functions import text as T
from blastradius.operators import extract as X
from blastradius.plans.registry import Context, query

# --- Formulas (checks) ------------------------------------------------------------------


def cleaned(x: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace({x}, '(?s)/\*.*?\*/', '', 'g'), '//[^\r\n]*', '', 'g'), '"[^"]*"', '""', 'g')"""


COLUMN_PATTERN = r"(?:''([^'']+)''|(\w+))\[([^\]]+)\]"
MEASURE_PATTERN = r"(?:^|[^\w''.])\[([^\]]+)\]"
TABLE_PATTERN = T.TABLE_CALL.replace("'", "''")


def column_ref_sql(keys: str, source: str, text: str) -> str:
    groups = ", ".join(f"unnest(regexp_extract_all(x, '{COLUMN_PATTERN}', {n})) as g{n}" for n in (1, 2, 3))
    return f"""select distinct {keys}, coalesce(nullif(g1, ''), g2) as tbl, trim(g3) as col from (select {keys}, {groups} from (select {keys}, {cleaned(text)} as x from {source}) a) b"""


def measure_ref_sql(keys: str, source: str, text: str) -> str:
    return f"""select distinct {keys}, trim(m) as measure from (select {keys}, unnest(regexp_extract_all({cleaned(text)}, '{MEASURE_PATTERN}', 1)) as m from {source}) a"""


def table_ref_sql(keys: str, source: str, text: str) -> str:
    groups = ", ".join(f"unnest(regexp_extract_all(x, '{TABLE_PATTERN}', {n})) as g{n}" for n in (1, 2))
    return f"""select distinct {keys}, coalesce(nullif(g1, ''), g2) as ref_table from (select {keys}, {groups} from (select {keys}, {cleaned(text)} as x from {source}) a) b"""


def refs(c: Context):
    """Column, measure and table refs of all measure formulas."""
    return X.formula_refs(c.formulas, ["name", "home"], "expr")


@query("formula_clean", f"select name, {cleaned('expr')} as cleaned from fx_formulas")
def formula_clean(c: Context):
    """Formulas without comments and string contents."""
    return c.formulas.select("name", T.clean_formula(F.col("expr")).alias("cleaned"))


@query("dax_column_refs", column_ref_sql("name, home", "fx_formulas", "expr"))
def dax_column_refs(c: Context):
    """Columns every measure formula reads."""
    return refs(c)[0]


@query("dax_measure_refs", measure_ref_sql("name, home", "fx_formulas", "expr"))
def dax_measure_refs(c: Context):
    """Measures every measure formula reads."""
    return refs(c)[1]


@query("dax_table_refs", table_ref_sql("name, home", "fx_formulas", "expr"))
def dax_table_refs(c: Context):
    """Tables every measure formula passes to table functions."""
    return refs(c)[2]


ROW_PATTERN = (
    r'''(?i)\(\s*"((?:[^"]|"")*)"\s*,\s*NAMEOF\s*\(\s*(?:'([^']+)'|([^'\[\s,()]+))?\s*\[([^\]]+)\]\s*\)(?:\s*,\s*(-?\d+))?(?:\s*,\s*"((?:[^"]|"")*)")?'''
).replace("'", "''")
NAMEOF = (
    "select id, "
    + ", ".join(f"unnest(regexp_extract_all(coalesce(body, ''), '{ROW_PATTERN}', {n})) as g{n}" for n in range(1, 7))
    + " from fx_parameter_text"
)


@query(
    "nameof_rows",
    f"""select id, replace(g1, '""', '"') as caption, coalesce(nullif(g2, ''), nullif(g3, '')) as target_table, g4 as target_name,
cast(nullif(g5, '') as int) as item_order, nullif(replace(g6, '""', '"'), '') as grp from ({NAMEOF}) t""",
)
def nameof_rows(c: Context):
    """Rows of all field parameters."""
    return X.rows_of(c.parameter_text, ["id"], T.parameter_rows(F.col("body")))


@query(
    "parameter_test",
    f"""select p.id, has_marker or (coalesce(source_type, 'calculated') = 'calculated' and exists (select 1 from ({NAMEOF}) r where r.id = p.id)) as is_parameter from fx_parameter_text p""",
)
def parameter_test(c: Context):
    """Which tables are field parameters."""
    return X.parameter_test(c.parameter_text)


# --- Query steps -----------------------------------------------------------------------------

NAV = rf"""
fx_nav as (select tbl, m, regexp_extract(m, '{T.SCHEMA_ITEM}', 2) as t1, regexp_extract(m, '{T.SCHEMA_ITEM}', 1) as s1,
  regexp_extract(m, '{T.ITEM_SCHEMA}', 1) as t2, regexp_extract(m, '{T.ITEM_SCHEMA}', 2) as s2, regexp_extract_all(m, '{T.NAME_STEP}', 1) as chain from fx_m_queries),
fx_navigation as (select tbl, nullif(case when t1 <> '' then s1 else s2 end, '') as sch, coalesce(nullif(t1, ''), nullif(t2, ''), chain[-1]) as phys_table,
  case when t1 = '' and t2 = '' then array_to_string(chain, '/') else '' end as path, case when t1 = '' and t2 = '' then chain else [] end as steps from fx_nav)"""


def nav(c: Context):
    return c.m_queries.select("tbl", T.navigation(F.col("m")).alias("nav"))


@query("m_navigation", NAV + " /*main*/ select tbl, sch, phys_table, path from fx_navigation")
def m_navigation(c: Context):
    """Warehouse relation every query navigates to."""
    return nav(c).select(
        "tbl", F.col("nav.sch").alias("sch"), F.col("nav.tbl").alias("phys_table"), F.array_join("nav.path", "/").alias("path")
    )


@query(
    "nav_from_end",
    NAV + " /*main*/ select tbl, steps[-3] as db, coalesce(sch, steps[-2]) as sch, phys_table from fx_navigation where phys_table is not null",
)
def nav_from_end(c: Context):
    """Navigation read from its end into database, schema and table."""
    ends = nav(c).select("tbl", "nav", T.from_the_end(F.col("nav.path"), F.col("nav.sch")).alias("e"))
    return ends.where(F.col("nav.tbl").isNotNull()).select(
        "tbl", "e.db", "e.sch", F.col("nav.tbl").alias("phys_table")
    )


RENAME_SQL = r"""
fx_ren as (select distinct tbl, a as source_name, b as model_name from (select tbl, unnest(regexp_extract_all(seg, '\{\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\}', 1)) as a,
  unnest(regexp_extract_all(seg, '\{\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\}', 2)) as b
  from (select tbl, regexp_extract(unnest(string_split(m, 'Table.RenameColumns')[2:]), '(?s)^.*?\}\s*\}') as seg from fx_m_queries) s) t)"""


def m_rename_rows(c: Context):
    return X.rows_of(c.m_queries, ["tbl"], T.renames(F.col("m")))


@query("m_renames", RENAME_SQL + " /*main*/ select tbl, source_name, model_name from fx_ren")
def m_renames(c: Context):
    """Pairs of old and new column names."""
    return m_rename_rows(c)


@query(
    "m_projection",
    r"""select tbl, col from (select tbl, m, unnest(regexp_extract_all(regexp_extract(string_split(m, 'Table.SelectColumns')[-1], '(?s)^[^,]*,[^{]*\{([^}]*)\}', 1), '"([^"]+)"', 1)) as col
from fx_m_queries where m like '%Table.SelectColumns%') t where not list_contains(regexp_extract_all(regexp_extract(m, '(?s)Table\.RemoveColumns[^,]*,[^{]*\{([^}]*)\}', 1), '"([^"]+)"', 1), col)""",
)
def m_projection(c: Context):
    """Columns left after the last select step."""
    return X.values_of(c.m_queries, ["tbl"], T.final_projection(F.col("m")), "col")


ADDED = r"""
fx_add as (select tbl, regexp_extract(seg, '^\s*\([^,]*,\s*"([^"]*)"', 1) as col, regexp_extract(seg, '^\s*\([^,]*,\s*"[^"]*"\s*,([^\n]*)', 1) as body
  from (select tbl, unnest(string_split(m, 'Table.AddColumn')[2:]) as seg from fx_m_queries) s),
fx_reads as (select distinct tbl, col, trim(coalesce(nullif(a, ''), b)) as reads from (select tbl, col,
  unnest(regexp_extract_all(body, '\[\s*(?:#"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_ .]*?))\s*\]', 1)) as a,
  unnest(regexp_extract_all(body, '\[\s*(?:#"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_ .]*?))\s*\]', 2)) as b from fx_add) t)"""


@query("m_added_columns", ADDED + " /*main*/ select tbl, col, reads from fx_reads")
def m_added_columns(c: Context):
    """Computed columns and the fields each reads."""
    rows = X.rows_of(c.m_queries, ["tbl"], T.added_columns(F.col("m")))
    return rows.select("tbl", "col", F.explode("reads").alias("reads"))


STEPS = r"""
fx_joins as (select tbl, trim(unnest(regexp_extract_all(m, 'Table\.NestedJoin\s*\(\s*([^,\n]+),\s*\{([^}]*)\}\s*,\s*([^,\n]+),\s*\{([^}]*)\}', 1))) as l,
  unnest(regexp_extract_all(m, 'Table\.NestedJoin\s*\(\s*([^,\n]+),\s*\{([^}]*)\}\s*,\s*([^,\n]+),\s*\{([^}]*)\}', 2)) as lk,
  trim(unnest(regexp_extract_all(m, 'Table\.NestedJoin\s*\(\s*([^,\n]+),\s*\{([^}]*)\}\s*,\s*([^,\n]+),\s*\{([^}]*)\}', 3))) as r,
  unnest(regexp_extract_all(m, 'Table\.NestedJoin\s*\(\s*([^,\n]+),\s*\{([^}]*)\}\s*,\s*([^,\n]+),\s*\{([^}]*)\}', 4)) as rk from fx_m_queries),
fx_steps as (select tbl, 'NestedJoin' as operation, l as step from fx_joins union select tbl, 'NestedJoin', r from fx_joins
  union select tbl, 'Combine', trim(s) from (select tbl, unnest(string_split(l, ',')) as s from (select tbl, unnest(regexp_extract_all(m, 'Table\.Combine\s*\(\s*\{([^}]+)\}', 1)) as l from fx_m_queries) p) q)"""


def steps(c: Context):
    return X.rows_of(c.m_queries, ["tbl"], T.merge_inputs(F.col("m")))


@query("m_merge_inputs", STEPS + " /*main*/ select tbl, operation, step from fx_steps")
def m_merge_inputs(c: Context):
    """Steps merged or appended."""
    return steps(c)


@query(
    "m_merge_keys",
    STEPS + """ /*main*/ select tbl, l as left_step, array_to_string(regexp_extract_all(lk, '"([^"]+)"', 1), ',') as left_keys, r as right_step,
array_to_string(regexp_extract_all(rk, '"([^"]+)"', 1), ',') as right_keys from fx_joins""",
)
def m_merge_keys(c: Context):
    """Key columns of every merge."""
    return X.rows_of(c.m_queries, ["tbl"], T.merge_keys(F.col("m")))


@query(
    "sql_table_refs",
    rf"""select distinct id, ref_table from (select id, replace(replace(replace(replace(unnest(regexp_extract_all(sql, '{T.SQL_TABLE}', 2)), '`', ''), '"', ''), '[', ''), ']', '') as ref_table from fx_sql_text) t
where ref_table <> '' and upper(ref_table) not in {T.NOT_A_TABLE}""",
)
def sql_table_refs(c: Context):
    """Tables a passed-through SQL text reads."""
    return X.values_of(c.sql_text, ["id"], T.sql_table_refs(F.col("sql")), "ref_table")


def connector_sql(text: str, keys: str, source: str) -> str:
    """One pass per connector over the text, as the check of the single combined pass."""
    parts = []
    for name, kind, takes, least in T.CONNECTORS:
        fn = name.replace(".", r"\.")
        file = r"\s*File\.Contents\s*\(" if name in T.FILE_CALLS else ""
        arg = r'(#?"[^"]*")'
        one = rf"\s*{arg}" if least else rf"\s*{arg}?"
        two = rf"\s*,\s*{arg}" if least == 2 else rf"(?:\s*,\s*{arg})?"
        pattern = rf"{fn}\s*\({file}{one}{two}"
        slots = takes.split()

        def slot(s: str, g: str, on: bool) -> str:
            return f"nullif(replace(replace({g}, '#', ''), '\"', ''), '') as {s}" if on else f"null as {s}"

        by_name = " or ".join(["false"] + [f"coalesce({g}, '') like '#%'" for g, n in (("g1", 1), ("g2", 2)) if len(slots) >= n])
        parts.append(
            f"select {keys}, '{kind}' as kind, {slot('server', 'g1', 'server' in slots)}, {slot('database', 'g2', 'database' in slots)}, "
            f"{slot('url', 'g1', 'url' in slots)}, {slot('path', 'g1', 'path' in slots)}, ({by_name}) as parameterized from "
            f"(select {keys}, unnest(regexp_extract_all({text}, '{pattern}', 1)) as g1, unnest(regexp_extract_all({text}, '{pattern}', 2)) as g2 from {source}) q"
        )
    return " union all ".join(parts)


CONNECTED = f"""
fx_conn as ({connector_sql("m", "tbl, ord", "fx_m_queries")}),
fx_sconn as ({connector_sql("expr", "name", "fx_shared_exprs")})"""


@query(
    "connectors",
    CONNECTED + r""" /*main*/ select tbl, kind, server, database, url, path, parameterized or (kind = 'SQL Server' and tbl in (
select q.tbl from (select tbl, unnest(regexp_extract_all(m, '#"([^"]+)"', 1)) as p from fx_m_queries) q
join fx_shared_exprs s on s.name = q.p where regexp_matches(s.expr, 'IsParameterQuery\s*=\s*true'))) as parameterized from fx_conn""",
)
def connectors(c: Context):
    """Sources every query opens."""
    return X.connectors(c.m_queries, c.shared_exprs)


@query(
    "native_queries",
    r"""select tbl, regexp_extract(m, 'Value\.NativeQuery\s*\(((?:[^,()"]|\([^()]*\)|"[^"]*")*)', 1) as connection,
regexp_extract(m, 'Value\.NativeQuery\s*\((?:[^,()"]|\([^()]*\)|"[^"]*")*,\s*"([^"]*)"', 1) as sql from fx_m_queries where m like '%Value.NativeQuery%'""",
)
def native_queries(c: Context):
    """SQL texts passed through to a source."""
    return X.rows_of(c.m_queries, ["tbl"], T.native_queries(F.col("m")))


FIRST_STEP_RE2 = T.FIRST_STEP.removesuffix(r"(?![ \t]*\()")
SHARED = rf"""
fx_refs as (select tbl, ord, m, coalesce(nullif(regexp_extract(m, '{FIRST_STEP_RE2}', 1), ''), nullif(regexp_extract(m, '{FIRST_STEP_RE2}', 2), '')) as ref from fx_m_queries),
fx_srefs as (select name, expr, coalesce(nullif(regexp_extract(expr, '{FIRST_STEP_RE2}', 1), ''), nullif(regexp_extract(expr, '{FIRST_STEP_RE2}', 2), '')) as ref from fx_shared_exprs)"""


@query("shared_refs", SHARED + " /*main*/ select r.tbl, s.name as ref from fx_refs r join fx_shared_exprs s on s.name = r.ref")
def shared_refs(c: Context):
    """Shared query each query starts from."""
    named = c.m_queries.select("tbl", T.shared_ref(F.col("m")).alias("ref"))
    return named.join(c.shared_exprs.select(F.col("name").alias("ref")), "ref", "left_semi").select("tbl", "ref")


@query(
    "parameter_refs",
    r"""select distinct q.tbl, s.name as param from (select tbl, unnest(regexp_extract_all(m, '#"([^"]+)"', 1)) as p from fx_m_queries) q
join fx_shared_exprs s on s.name = q.p where regexp_matches(s.expr, 'IsParameterQuery\s*=\s*true')""",
)
def parameter_refs(c: Context):
    """Declared parameters each query names."""
    declared = c.shared_exprs.where(T.parameter_value(F.col("expr")).isNotNull()).select(F.col("name").alias("param"))
    return X.values_of(c.m_queries, ["tbl"], T.parameter_names(F.col("m")), "param").join(declared, "param", "left_semi").select("tbl", "param")


SOURCE_KEY = "lower(concat_ws('|', kind, server, database, url, path))"
SOURCES = (
    CONNECTED + "," + SHARED + f""",
fx_src as (select tbl, ord, kind, server, database, url, path from fx_conn
  union all select r.tbl, r.ord, k.kind, k.server, k.database, k.url, k.path from fx_refs r join fx_sconn k on k.name = r.ref
  where not exists (select 1 from fx_conn o where o.tbl = r.tbl)),
fx_tsrc as (select distinct tbl, {SOURCE_KEY} as source_key, ord, kind, server, database, url, path from fx_src)"""
)


def sources(c: Context):
    return c.shared("table_sources", lambda c: c.ws.save(X.table_sources(c.m_queries, c.shared_exprs), "table-sources"))


@query("table_sources", SOURCES + " /*main*/ select tbl, source_key from fx_tsrc")
def table_sources(c: Context):
    """Edges from BI tables to the sources their queries open."""
    return sources(c).select("tbl", "source_key")


@query(
    "distinct_sources",
    SOURCES + r""",
fx_par as (select name, regexp_extract(expr, '"([^"]+)"\s*meta\s*\[', 1) as value from fx_shared_exprs where regexp_matches(expr, 'IsParameterQuery\s*=\s*true')),
fx_one as (select * from fx_tsrc qualify row_number() over (partition by source_key order by ord) = 1) /*main*/
select source_key, kind, coalesce(p.value, server) as server, database, url, path,
case when kind in ('SQL Server', 'Oracle', 'Teradata', 'SAP HANA', 'ODBC', 'Analysis Services') then not coalesce(p.value, server, '') like '%.database.windows.net%'
  when kind in ('Excel', 'CSV') then not regexp_matches(lower(coalesce(path, '')), 'sharepoint|onedrive') else false end as gateway
from fx_one o left join fx_par p on p.name = o.server""",
)
def distinct_sources(c: Context):
    """Each source once, parameters filled in, with the gateway verdict."""
    return X.distinct_sources(sources(c), c.shared_exprs)


@query(
    "step_kinds",
    r"""select tbl, kind, count(*) as steps from (select tbl, case when regexp_matches(s, '(?i)^(Sql\.|GoogleBigQuery\.|Snowflake\.|Excel\.|Value\.NativeQuery)') then 'Source'
when regexp_matches(s, '^\w+\s*\{\s*\[') then 'Navigation' when s like 'Table.SelectColumns%' or s like 'Table.RemoveColumns%' then 'Projection' when s like 'Table.RenameColumns%' then 'Rename'
when s like 'Table.SelectRows%' then 'Filter' when s like 'Table.NestedJoin%' or s like 'Table.Combine%' then 'Join' when s like 'Table.AddColumn%' then 'AddColumn' else 'Custom' end as kind
from (select tbl, unnest(regexp_extract_all(m, '\n  \w+ = ([^\n]*)', 1)) as s from fx_m_queries) a) b group by 1, 2""",
)
def step_kinds(c: Context):
    """Steps of every query by kind."""
    texts = X.values_of(c.m_queries, ["tbl"], T.all_of(F.col("m"), r"\n  \w+ = ([^\n]*)"), "step")
    return texts.groupBy("tbl", T.step_kind(F.col("step")).alias("kind")).agg(F.count(F.lit(1)).alias("steps"))


# --- Model text ----------------------------------------------------------------------------------


@query(
    "endpoint_split",
    """select id, q as ref, case when q like '%.%' then case when q like '''%' then p_type||' T' else p_type end end as tbl, case when q like '%''' then p_name||'.x' else p_name end as col
from (select p_partkey as id, p_type, p_name, unnest([''''||p_type||' T''.'||p_name, p_type||'.'''||p_name||'.x''', ''''||p_type||' T''.'''||p_name||'.x''', p_name]) as q from part) t""",
)
def endpoint_split(c: Context):
    """Table and column of references with either side quoted."""
    table, name = F.col("p_type"), F.col("p_name")
    quoted = F.concat(F.lit("'"), table, F.lit(" T'."))
    inner = F.concat(F.lit("'"), name, F.lit(".x'"))
    made = F.array(F.concat(quoted, name), F.concat(table, F.lit("."), inner), F.concat(quoted, inner), name)
    refs = c.part.select(F.col("p_partkey").alias("id"), F.explode(made).alias("ref"))
    return refs.select("id", "ref", T.endpoint(F.col("ref")).alias("e")).select("id", "ref", "e.tbl", "e.col")


@query(
    "line_blocks",
    """select s_suppkey as doc, 'r'||s_suppkey as id, 'A b.c' as from_table, 'c '||s_nationkey as from_column, 'D' as to_table, s_name as to_column,
case when s_suppkey%3=0 then 'one:one' else 'many:one' end as cardinality, case when s_suppkey%3=0 then 'bothDirections' end as cross_filter, s_suppkey%2<>0 as active from supplier
union all select s_suppkey, 'q '||s_suppkey, 'X', 'y'||s_nationkey, null, 'plain', 'many:one', null, true from supplier""",
)
def line_blocks(c: Context):
    """Relationships read from indented model text."""
    return X.relationship_blocks(c.model_text)


# --- Names -------------------------------------------------------------------------------------------


@query(
    "layer_of",
    r"""select p_partkey as id, case when p_size%8=0 then 'sources' when p_size%5=0 then 'models' when p_size%3=0 then lower(p_type)||'/'||p_brand else lower(p_type) end as layer from part""",
)
def layer_of(c: Context):
    """Folder layer of a node path, either slash, empty parts dropped."""
    size = F.col("p_size")
    kind = F.when(size % 8 == 0, "source").otherwise("model")
    path = (
        F.when(size % 5 == 0, F.concat(F.col("p_name"), F.lit(".sql")))
        .when(size % 3 == 0, F.concat(F.lower("p_type"), F.lit("\\"), F.col("p_brand"), F.lit("//m.sql")))
        .otherwise(F.concat(F.lit("/"), F.lower("p_type"), F.lit("/m.sql")))
    )
    return c.part.select(F.col("p_partkey").alias("id"), N.layer_of(kind, path).alias("layer"))


@query(
    "relation_of",
    """select p_partkey as id, concat_ws('.', nullif(case when p_size%3=0 then '' else p_brand end, ''), case when p_size%4<>0 then p_type end, case when p_size%2=0 then 'ident' else p_name end) as relation from part""",
)
def relation_of(c: Context):
    """Dotted relation of the parts that are filled."""
    size = F.col("p_size")
    return c.part.select(
        F.col("p_partkey").alias("id"),
        N.relation_of(
            F.when(size % 3 == 0, "").otherwise(F.col("p_brand")),
            F.when(size % 4 != 0, F.col("p_type")),
            F.when(size % 2 == 0, "ident").otherwise(""),
            F.col("p_name"),
        ).alias("relation"),
    )


FIELD_IDS = """select p_partkey as id, case p_size%4 when 0 then 'measure:T.'||p_type||'.'||p_name when 1 then p_type||'.'||p_name when 2 then 'column:'||p_name else p_name end as field_id from part"""


@query(
    "field_id_split",
    f"""select id, field_id, case when field_id like '%:%' then split_part(field_id, ':', 1) end as kind,
nullif(regexp_extract(regexp_replace(field_id, '^[^:]*:', ''), '^(.*)\\.[^.]*$', 1), '') as tbl, split_part(regexp_replace(field_id, '^[^:]*:', ''), '.', -1) as field from ({FIELD_IDS}) t""",
)
def field_id_split(c: Context):
    """Kind, table and field of a field id."""
    df = c.sql(FIELD_IDS)
    kind, table, field = N.field_id_parts(F.col("field_id"))
    return df.select("id", "field_id", kind.alias("kind"), table.alias("tbl"), field.alias("field"))


VISUAL_IDS = """select p_partkey as id, case p_size%3 when 0 then 'visual:'||p_type||'|'||p_name||'|x' when 1 then 'visual:'||p_name else p_type||'|'||p_name end as visual_id from part"""


@query(
    "visual_id_split",
    f"""select id, case when visual_id like 'visual:%|%' then regexp_extract(visual_id, '^visual:([^|]*)\\|', 1) end as page,
case when visual_id like '%|%' then regexp_extract(visual_id, '^[^|]*\\|(.*)$', 1) else replace(visual_id, 'visual:', '') end as visual from ({VISUAL_IDS}) t""",
)
def visual_id_split(c: Context):
    """Page and name of a visual id."""
    df = c.sql(VISUAL_IDS)
    page, name = N.visual_id_parts(F.col("visual_id"))
    return df.select("id", page.alias("page"), name.alias("visual"))


@query(
    "column_cleanup",
    """select p_partkey as id, case when p_size%3=0 then p_name when p_size%3=1 then p_name else p_type end as col from part""",
)
def column_cleanup(c: Context):
    """Column names freed of quotes, casts and a leading dollar sign."""
    size, name = F.col("p_size"), F.col("p_name")
    raw = (
        F.when(size % 3 == 0, F.concat(F.lit('"'), name, F.lit('"')))
        .when(size % 3 == 1, F.concat(F.lit("$"), name, F.lit(":: varchar")))
        .otherwise(F.concat(F.lit("`"), F.col("p_type"), F.lit("`")))
    )
    return c.part.select(F.col("p_partkey").alias("id"), N.clean_column_name(raw).alias("col"))


@query("relation_cleanup", """select p_partkey as id, p_brand||'.'||p_type||'.'||p_name as relation from part""")
def relation_cleanup(c: Context):
    """Relation names without quotes and backticks."""
    raw = F.concat(F.lit('"'), F.col("p_brand"), F.lit('".`'), F.col("p_type"), F.lit("`."), F.col("p_name"))
    return c.part.select(F.col("p_partkey").alias("id"), N.clean_relation_name(raw).alias("relation"))


@query(
    "renames",
    """select visual, field, trim(display) as shown_as from fx_field_use where trim(coalesce(display, '')) <> '' and lower(trim(display)) <> lower(trim(field))""",
)
def renames(c: Context):
    """Labels that differ from the field they show."""
    label = N.rename_of(F.col("display"), F.col("field"))
    return c.field_use.select("visual", "field", label.alias("shown_as")).where(F.col("shown_as").isNotNull())


@query(
    "quoted_columns",
    """select e.src, coalesce(q.col, lower(e.sc)) as sc from fx_edges e left join (select id, col from fx_cols where col = upper(col) and id like 'mod:%') q on q.id = e.src and lower(q.col) = lower(e.sc) where e.kind = 'dbt' and e.sc is not null""",
)
def quoted_columns(c: Context):
    """Read columns in their declared case where the node quotes them, else lower case."""
    quoted = c.cols.where((F.col("col") == F.upper("col")) & F.startswith("id", F.lit("mod:")))
    reads = c.given("edges").where((F.col("kind") == "dbt") & F.col("sc").isNotNull())
    return X.resolve_column_case(reads, quoted, "snowflake")
