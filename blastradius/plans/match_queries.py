"""Queries on the boundary: mapping rows, relation matching, links and what did not link."""

from __future__ import annotations

from pyspark.sql import functions as F

from blastradius.functions import norm as N
from blastradius.operators import match as M
from blastradius.plans.registry import Context, query


def bare(x: str) -> str:
    """SQL of one part of a relation key."""
    return f"""regexp_replace(lower(trim(coalesce({x}, ''))), '^[`"\\[]|[`"\\]]$', '', 'g')"""


def key3(a: str, b: str, c: str) -> str:
    return f"{bare(a)}||'.'||{bare(b)}||'.'||{bare(c)}"


CLEAN = f"""
fx_map0 as (select *, concat_ws(', ', case when from_database = '' then 'From Database' end, case when from_schema = '' then 'From Schema' end,
    case when from_table = '' then 'From Table' end, case when to_table = '' then 'To Table' end) as missing from fx_mapping),
fx_map1 as (select *, min(row_no) over (partition by {key3('from_database', 'from_schema', 'from_table')}, lower(trim(from_column)), lower(trim(to_table)), lower(trim(to_column))) as first_row
  from fx_map0 where missing = '' and (from_column = '') = (to_column = '')),
fx_rows as (select *, case when from_column <> '' then 'column' else 'table' end as level, {key3('from_database', 'from_schema', 'from_table')} as from_key
  from fx_map1 where row_no = first_row)"""
INDEX = f"""
fx_index as (select ord, id, name, {key3('db', 'sch', 't')} as key3, lower(trim(sch))||'.'||lower(trim(t)) as key2, lower(trim(t)) as key1
  from (select *, case when relation is null then name else split_part(relation, '.', -1) end as t from fx_relations where kind in ('model', 'source')) q)"""


def resolved(name: str, source: str, key: str) -> str:
    """SQL of the degrading match for rows ``source`` (db, sch, tbl) identified by ``key``."""
    tries = " union all ".join(
        f"select r.{key} as rk, {n} as lvl, i.ord, i.id, i.name from {source} r join fx_index i on i.key{k} = {expr} where {cond}"
        for n, k, expr, cond in (
            (1, 3, key3("r.db", "r.sch", "r.tbl"), "r.db <> '' and r.sch <> '' and r.tbl <> ''"),
            (2, 2, "lower(trim(r.sch))||'.'||lower(trim(r.tbl))", "r.sch <> '' and r.tbl <> ''"),
            (3, 1, "lower(trim(r.tbl))", "r.tbl <> ''"),
        )
    )
    return f"""
{name}_try as ({tries}),
{name}_hit as (select rk, lvl, arg_min(id, ord) as id, arg_min(name, ord) as name, count(*) > 1 as ambiguous from {name}_try t
  where lvl = (select min(lvl) from {name}_try b where b.rk = t.rk) group by 1, 2),
{name} as (select r.*, h.id, h.name, case h.lvl when 1 then 'database.schema.table' when 2 then 'schema.table' when 3 then 'table' end as match_level, h.ambiguous
  from {source} r left join {name}_hit h on h.rk = r.{key})"""


MATCH = (
    CLEAN + "," + INDEX + """,
fx_rows_in as (select *, from_database as db, from_schema as sch, from_table as tbl from fx_rows),"""
    + resolved("fx_rowsr", "fx_rows_in", "row_no")
    + """,
fx_rowst as (select r.*, t.tbl as target from fx_rowsr r left join fx_model_tables t on lower(t.tbl) = lower(trim(r.to_table))),
fx_usable as (select * from fx_rowst where id is not null and target is not null),
fx_claimed as (select distinct lower(target) as tkey, case when level = 'column' then lower(to_column) end as ckey from fx_usable),
fx_physfree as (select p.* from fx_physical p where not exists (select 1 from fx_claimed c where c.tkey = lower(p.model_table) and c.ckey is null)),"""
    + resolved("fx_physr", "fx_physfree", "ord")
    + """,
fx_dcl as (select u.id, s.col as source_column, u.target, m.col as target_column, u.row_no from fx_usable u
  join fx_relation_cols s on s.id = u.id and lower(s.col) = lower(u.from_column)
  join fx_model_cols m on m.tbl = u.target and lower(m.col) = lower(u.to_column) where u.level = 'column'),
fx_dtl as (select u.id, s.col as source_column, u.target, m.col as target_column, u.row_no from fx_usable u
  join fx_relation_cols s on s.id = u.id join fx_model_cols m on m.tbl = u.target and lower(m.col) = lower(s.col) where u.level = 'table'),
fx_drv as (select p.id, s.col as source_column, m.tbl as target, m.col as target_column, p.match_level, p.ord from fx_physr p
  join fx_relation_cols s on s.id = p.id and lower(s.col) = lower(p.col)
  join fx_model_cols m on lower(m.tbl) = lower(p.model_table) and lower(m.col) = lower(p.model_column)
  where not exists (select 1 from fx_claimed c where c.tkey = lower(m.tbl) and c.ckey = lower(m.col))),
fx_any as (select id, source_column, target, target_column, 'declared' as provenance, 'mapping-row' as match_level, cast(row_no as bigint) as mapping_row, 0 as rk, row_no as ord from fx_dcl
  union all select id, source_column, target, target_column, 'declared', 'mapping-row', row_no, 0, row_no from fx_dtl
  union all select id, source_column, target, target_column, 'derived', match_level, null, 1, ord from fx_drv),
fx_links as (select id as source, source_column, target, target_column, provenance, match_level, mapping_row from fx_any
  qualify row_number() over (partition by id, lower(source_column), target, lower(target_column) order by rk, ord) = 1)"""
)


def index(c: Context):
    return c.shared("index", lambda c: c.ws.save(M.relation_index(c.relations), "relation-index"))


def boundary(c: Context) -> M.Boundary:
    return c.shared(
        "boundary",
        lambda c: M.Boundary(
            c.mapping, c.physical, index(c), c.relation_cols, c.model_tables, c.model_cols, c.ws.save
        ),
    )


def cross(c: Context):
    return c.shared("cross_links", lambda c: c.ws.save(boundary(c).cross_links(), "cross-links"))


@query(
    "relation_key",
    f"select req, {key3('db', 'sch', 'tbl')} as key3 from fx_requests",
)
def relation_key(c: Context):
    """Full relation key of every look-up."""
    return c.requests.select("req", N.relation_key(F.col("db"), F.col("sch"), F.col("tbl")).alias("key3"))


@query("norm", "select req, lower(trim(coalesce(db, ''))) as db, lower(trim(coalesce(sch, ''))) as sch, lower(trim(coalesce(tbl, ''))) as tbl from fx_requests")
def norm(c: Context):
    """Trimmed lower-case names."""
    return c.requests.select("req", *[N.norm(F.col(x)).alias(x) for x in ("db", "sch", "tbl")])


@query("relation_index", INDEX + " /*main*/ select ord, id, name, key3, key2, key1 from fx_index")
def relation_index(c: Context):
    """Models and sources under their three keys."""
    return index(c)


@query("relation_table", "select id, case when relation is null then name else split_part(relation, '.', -1) end as tbl from fx_relations")
def relation_table(c: Context):
    """Table name each node is indexed under."""
    return c.relations.select("id", N.index_table(F.col("relation"), F.col("name")).alias("tbl"))


@query(
    "resolve_relation",
    INDEX + "," + resolved("fx_res", "fx_requests", "req") + " /*main*/ select req, db, sch, tbl, id, name, match_level, ambiguous from fx_res",
)
def resolve_relation(c: Context):
    """Every look-up matched at the best level it allows."""
    return M.resolve_relation(c.requests, index(c))


@query(
    "schema_table_unique",
    "select lower(trim(sch))||'.'||lower(trim(name)) as schema_table, min(id) as id from fx_relations group by 1 having count(distinct id) = 1",
)
def schema_table_unique(c: Context):
    """Two-part names that only one node answers to."""
    return M.schema_table_unique(c.relations)


@query("mapping_rows", CLEAN + " /*main*/ select row_no, from_database, from_schema, from_table, from_column, to_table, to_column, level, from_key from fx_rows")
def mapping_rows(c: Context):
    """Mapping rows in force."""
    return M.mapping_rows(c.mapping)


@query(
    "diag_mapping_errors",
    CLEAN + """ /*main*/ select row_no, case when missing <> '' then 'missing '||missing
  else 'From Column and To Column must both be filled (column-level row) or both blank (table-level row)' end as message
from fx_map0 where missing <> '' or (from_column = '') <> (to_column = '')""",
)
def diag_mapping_errors(c: Context):
    """Mapping rows that cannot be read."""
    return M.mapping_errors(c.mapping)


@query(
    "diag_mapping_warnings",
    CLEAN + " /*main*/ select row_no, 'duplicate of row '||first_row||' — ignored' as message from fx_map1 where row_no > first_row",
)
def diag_mapping_warnings(c: Context):
    """Mapping rows that repeat an earlier one."""
    return M.mapping_warnings(c.mapping)


@query("declared_column_links", MATCH + " /*main*/ select id, source_column, target, target_column, row_no from fx_dcl")
def declared_column_links(c: Context):
    """Links from mapping rows that name both columns."""
    return boundary(c).declared_column_links()


@query("declared_table_links", MATCH + " /*main*/ select id, source_column, target, target_column, row_no from fx_dtl")
def declared_table_links(c: Context):
    """Links by equal column name from mapping rows that name two tables."""
    return boundary(c).declared_table_links()


@query("claims", MATCH + " /*main*/ select tkey, ckey from fx_claimed")
def claims(c: Context):
    """Tables and columns that mapping rows close to automatic matching."""
    return boundary(c).claimed()


@query("derived_links", MATCH + " /*main*/ select id, source_column, target, target_column, match_level, ord from fx_drv")
def derived_links(c: Context):
    """Links found by relation name where no row claims the target."""
    return boundary(c).derived_links()


@query("cross_links", MATCH + " /*main*/ select * from fx_links")
def cross_links(c: Context):
    """All links across the boundary, declared before derived."""
    return cross(c)


@query(
    "diag_unresolved_rows",
    MATCH + """ /*main*/ select row_no, case when id is null then 'no dbt model builds '||from_database||'.'||from_schema||'.'||from_table
  else 'semantic model has no table named "'||to_table||'"' end as reason from fx_rowst where id is null or target is null
union all select row_no, case when level = 'column' then 'column not found on one side ('||from_column||' -> '||to_column||')'
  else 'table-level row matched 0 columns by name between '||name||' and "'||target||'"' end from fx_usable u
where not exists (select 1 from fx_dcl d where d.row_no = u.row_no) and not exists (select 1 from fx_dtl d where d.row_no = u.row_no)""",
)
def diag_unresolved_rows(c: Context):
    """Mapping rows that lead nowhere, with the reason."""
    return boundary(c).unresolved_rows()


@query(
    "diag_ambiguous",
    MATCH + """ /*main*/ select 'mapping row '||row_no as origin, row_no as ord, from_database||'.'||from_schema||'.'||from_table as relation, match_level from fx_rowst where ambiguous
union all select 'auto match for '||model_table, ord, concat_ws('.', db, sch, tbl), match_level from fx_physr where ambiguous""",
)
def diag_ambiguous(c: Context):
    """Matches that more than one node answers to."""
    return boundary(c).ambiguous()


@query(
    "diag_tables_without_source",
    MATCH + " /*main*/ select tbl from fx_model_tables t where not has_source and not exists (select 1 from fx_claimed c where c.ckey is null and c.tkey = lower(t.tbl))",
)
def diag_tables_without_source(c: Context):
    """BI tables with no physical source and no mapping row that claims them."""
    return boundary(c).tables_without_source()


MULTI = MATCH + """,
fx_multi as (select l.target as tbl, l.target_column as col, i.name||'['||l.source_column||']' as source, l.mapping_row,
    count(*) over (partition by l.target, lower(l.target_column)) as sources
  from fx_links l join fx_index i on i.id = l.source where l.provenance = 'declared')"""


@query("multi_source_columns", MULTI + " /*main*/ select tbl, col, sources, min(mapping_row) as first_row from fx_multi where sources > 1 group by 1, 2, 3")
def multi_source_columns(c: Context):
    """Columns declared to come from more than one place."""
    found = M.multi_source_columns(cross(c), index(c))
    return found.groupBy("tbl", "col", "sources").agg(F.min("mapping_row").alias("first_row"))


@query("diag_multi_source", MULTI + " /*main*/ select tbl, col, source, mapping_row, sources from fx_multi where sources > 1")
def diag_multi_source(c: Context):
    """Every declared source of a column that has several."""
    return M.multi_source_columns(cross(c), index(c))
