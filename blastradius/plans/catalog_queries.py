"""Queries on the BI model: its edges, fields, parameters, and who uses what."""

from __future__ import annotations

from pyspark.sql import functions as F

from blastradius.operators import catalog as K
from blastradius.operators import extract as X
from blastradius.plans.registry import Context, query
from blastradius.plans.text_queries import (
    FIRST_STEP_RE2,
    NAV,
    SOURCES,
    STEPS,
    column_ref_sql,
    measure_ref_sql,
    sources,
    steps,
    table_ref_sql,
)
from blastradius.functions import text as T

HOMES = """
fx_homes as (select name as measure, arg_max(home, ord) as measure_home from fx_formulas group by 1)"""
REFS = HOMES + f""",
fx_cref as ({column_ref_sql("name, home", "fx_formulas", "expr")}),
fx_mref as (select r.name, r.home, r.measure, h.measure_home from ({measure_ref_sql("name, home", "fx_formulas", "expr")}) r join fx_homes h on h.measure = r.measure),
fx_tref as ({table_ref_sql("name, home", "fx_formulas", "expr")}),
fx_chain as (select distinct name, measure from fx_mref union select c.name, r.measure from fx_chain c join fx_mref r on r.name = c.measure),
fx_own as (select name, tbl from fx_cref union select name, ref_table from fx_tref),
fx_data as (select name, tbl from fx_own union select c.name, o.tbl from fx_chain c join fx_own o on o.name = c.measure)"""
CHAINED = "recursive" + REFS


def formulas(c: Context) -> K.Formulas:
    return c.shared("formulas_parsed", lambda c: K.Formulas(c.ws, c.formulas))


@query("measure_lookup", HOMES + " /*main*/ select measure, measure_home from fx_homes")
def measure_lookup(c: Context):
    """Home table of every measure name."""
    return K.measure_homes(c.formulas)


@query("measure_chain", CHAINED + " /*main*/ select c.name, c.measure, h.measure_home from fx_chain c join fx_homes h on h.measure = c.measure")
def measure_chain(c: Context):
    """Every measure a measure is computed from, through any number of others."""
    return formulas(c).chain()


@query(
    "measure_edges",
    CHAINED + """ /*main*/ select 'measure:'||home||'.'||name as from_id, 'column:'||tbl||'.'||col as to_id, 'references_column' as type from fx_cref
union all select 'measure:'||home||'.'||name, 'measure:'||measure_home||'.'||measure, 'depends_on_measure' from fx_mref
union all select 'measure:'||home||'.'||name, 'table:'||ref_table, 'references_table' from fx_tref
union all select 'measure:'||f.home||'.'||f.name, 'table:'||d.tbl, 'defined_in_table' from fx_formulas f join fx_data d on d.name = f.name
union all select 'measure:'||home||'.'||name, 'table:'||home, 'defined_in_table' from fx_formulas f where not exists (select 1 from fx_data d where d.name = f.name)""",
)
def measure_edges(c: Context):
    """Edges from measures to columns, measures and tables."""
    return formulas(c).edges()


@query(
    "calculated_edges",
    HOMES + f""",
fx_calc as (select tbl as own, col as own_col, expr from fx_bi_columns where expr is not null),
fx_part as (select tbl as own, body from fx_calc_partitions where source_type = 'calculated') /*main*/
select 'column:'||own||'.'||own_col as from_id, 'column:'||tbl||'.'||col as to_id, 'references_column' as type from ({column_ref_sql("own, own_col", "fx_calc", "expr")}) a
union all select 'column:'||own||'.'||own_col, 'measure:'||h.measure_home||'.'||b.measure, 'depends_on_measure' from ({measure_ref_sql("own, own_col", "fx_calc", "expr")}) b join fx_homes h on h.measure = b.measure
union all select 'column:'||own||'.'||own_col, 'table:'||ref_table, 'references_table' from ({table_ref_sql("own, own_col", "fx_calc", "expr")}) d
union all select distinct 'table:'||own, 'table:'||t, 'derived_from_table' from (
  select own, tbl as t from ({column_ref_sql("own", "fx_part", "body")}) e union select own, ref_table from ({table_ref_sql("own", "fx_part", "body")}) f) g
  where t <> own and exists (select 1 from fx_bi_tables x where x.tbl = g.t)""",
)
def calculated_edges(c: Context):
    """Edges of computed columns and computed tables."""
    return K.calculated_edges(c.bi_columns, K.measure_homes(c.formulas), c.calc_partitions, c.bi_tables)


@query(
    "merge_edges",
    STEPS + """ /*main*/ select distinct tbl, o as other from (select tbl, regexp_replace(step, '^#"(.+)"$', '\\1') as o from fx_steps) s
where o <> tbl and exists (select 1 from fx_bi_tables t where t.tbl = o)""",
)
def merge_edges(c: Context):
    """Tables whose query merges or appends another table."""
    return K.merge_edges(steps(c), c.bi_tables)


LINEAGE = "recursive" + NAV + rf""",
fx_sref as (select a.name, b.name as ref, a.expr from fx_shared_exprs a left join fx_shared_exprs b
  on b.name = coalesce(nullif(regexp_extract(a.expr, '{FIRST_STEP_RE2}', 1), ''), nullif(regexp_extract(a.expr, '{FIRST_STEP_RE2}', 2), ''))),
fx_send as (select name, name as at_name, ref, expr from fx_sref union select e.name, s.name, s.ref, s.expr from fx_send e join fx_sref s on s.name = e.ref),
fx_slin as (select name, nullif(regexp_extract(expr, '{T.SCHEMA_ITEM}', 1), '') as sch, nullif(regexp_extract(expr, '{T.SCHEMA_ITEM}', 2), '') as phys_table from fx_send where ref is null),
fx_qref as (select tbl, coalesce(nullif(regexp_extract(m, '{FIRST_STEP_RE2}', 1), ''), nullif(regexp_extract(m, '{FIRST_STEP_RE2}', 2), '')) as ref from fx_m_queries),
fx_phys as (select tbl, sch, phys_table, path from (select q.tbl, case when s.name is not null then s.sch else n.sch end as sch, case when s.name is not null then s.phys_table else n.phys_table end as phys_table,
  case when s.name is not null then '' else n.path end as path
  from fx_qref q join fx_navigation n on n.tbl = q.tbl left join fx_slin s on s.name = q.ref) p where phys_table is not null)"""


LAST_RENAME = r"""
fx_pairs as (select tbl, regexp_extract_all(seg, '\{\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\}', 1) as a, regexp_extract_all(seg, '\{\s*"([^"]+)"\s*,\s*"([^"]+)"\s*\}', 2) as b
  from (select tbl, regexp_extract(unnest(string_split(m, 'Table.RenameColumns')[2:]), '(?s)^.*?[}][[:space:]]*[}]') as seg from fx_m_queries) s),
fx_lastren as (select tbl, model_name, arg_max(source_name, pos) as source_name from (
  select tbl, unnest(a) as source_name, unnest(b) as model_name, unnest(generate_series(1, len(a))) as pos from fx_pairs) t group by 1, 2)"""


def physical(c: Context):
    def build(c):
        lineage = K.shared_lineage(c.ws, c.shared_exprs)
        return c.ws.save(X.physical_tables(c.m_queries, lineage), "physical-tables")

    return c.shared("physical_tables", build)


@query("physical_tables", LINEAGE + " /*main*/ select tbl, sch, phys_table, path from fx_phys")
def physical_tables(c: Context):
    """Relation every BI table loads from, through shared queries."""
    return physical(c).withColumn("path", F.array_join("path", "/"))


@query(
    "physical_columns",
    LINEAGE + "," + LAST_RENAME + """ /*main*/ select b.tbl, b.col, p.sch, p.phys_table, coalesce(r.source_name, b.col) as phys_col
from fx_bi_columns b join fx_phys p on p.tbl = b.tbl left join fx_lastren r on r.tbl = b.tbl and r.model_name = b.col where b.expr is null""",
)
def physical_columns(c: Context):
    """Warehouse column behind every BI column that is not computed."""
    return K.physical_columns(c.bi_columns, physical(c), c.m_queries)


# --- Fields --------------------------------------------------------------------------------

RESOLVED = """
fx_mk as (select lower(home) as tkey, lower(name) as fkey, home, name from fx_formulas),
fx_ck as (select lower(tbl) as tkey, lower(col) as fkey, tbl as ctbl, col as ccol from fx_bi_columns),
fx_used as (select distinct visual, page, type, tbl, field from fx_field_use),
fx_res as (select u.*, case when type = 'measure' then (case when m.name is not null then 'measure' end) when k.ccol is not null then 'column' end as node_kind,
    case when type = 'measure' then m.home else k.ctbl end as node_table, case when type = 'measure' then m.name else k.ccol end as node_name
  from fx_used u left join fx_mk m on m.tkey = lower(u.tbl) and m.fkey = lower(u.field) left join fx_ck k on k.tkey = lower(u.tbl) and k.fkey = lower(u.field))"""


@query("field_resolve", RESOLVED + " /*main*/ select * from fx_res")
def field_resolve(c: Context):
    """Model field behind every field of a visual, whatever its spelling."""
    uses = c.field_use.select("visual", "page", "type", "tbl", "field").distinct()
    return K.field_resolve(uses, c.formulas, c.bi_columns)


BROKEN = RESOLVED + """,
fx_exp as (select tbl from fx_calc_items union select param from fx_parameter_items),
fx_broken as (select visual, page, tbl||'['||field||']' as field, type as kind, 'the '||type||' does not exist in the semantic model' as reason from fx_res r
  where type <> 'hierarchy' and node_kind is null and not exists (select 1 from fx_exp e where e.tbl = r.tbl)
  union all select distinct visual, page, tbl, 'table', 'the table does not exist in the semantic model' from fx_used u
  where type = 'hierarchy' and not exists (select 1 from fx_exp e where e.tbl = u.tbl) and not exists (select 1 from fx_bi_tables t where lower(t.tbl) = lower(u.tbl)))"""


def broken(c: Context):
    expanded = c.calc_items.select("tbl").unionByName(c.parameter_items.select(F.col("param").alias("tbl"))).distinct()
    return K.broken_refs(c.field_use, c.formulas, c.bi_columns, c.bi_tables, expanded)


@query("broken_refs", BROKEN + " /*main*/ select kind, count(*) as refs, count(distinct visual) as visuals from fx_broken group by 1")
def broken_refs(c: Context):
    """Broken references by kind."""
    return broken(c).groupBy("kind").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("visual").alias("visuals"))


@query("diag_broken_refs", BROKEN + " /*main*/ select * from fx_broken")
def diag_broken_refs(c: Context):
    """Uses of fields the model does not hold."""
    return broken(c)


ITEMS = """
fx_pi as (select i.*, case when k.col is not null then 'column' when i.target_table is null and n.name is not null then 'measure' when m.name is not null then 'measure' end as target_kind,
    coalesce(k.tbl, case when i.target_table is null then n.home else m.home end) as node_table, coalesce(k.col, case when i.target_table is null then n.name else m.name end) as node_name
  from fx_parameter_items i left join fx_bi_columns k on lower(k.tbl) = lower(i.target_table) and lower(k.col) = lower(i.target_name)
  left join fx_formulas m on lower(m.home) = lower(i.target_table) and lower(m.name) = lower(i.target_name)
  left join fx_formulas n on i.target_table is null and lower(n.name) = lower(i.target_name))"""


def items(c: Context):
    return c.shared(
        "parameter_items_resolved",
        lambda c: c.ws.save(K.parameter_items(c.parameter_items, c.formulas, c.bi_columns), "parameter-items"),
    )


@query("parameter_items", ITEMS + " /*main*/ select * from fx_pi")
def parameter_items(c: Context):
    """Rows of field parameters with the field each one names."""
    return items(c)


READS = "case when target_table is null then '['||target_name||']' else target_table||'['||target_name||']' end"


@query(
    "diag_parameters",
    ITEMS + f" /*main*/ select param, caption as shown_as, {READS} as reads, target_kind as kind from fx_pi",
)
def diag_parameters(c: Context):
    """Every field a parameter can swap in."""
    return items(c).select(
        "param", F.col("caption").alias("shown_as"), reads().alias("reads"), F.col("target_kind").alias("kind")
    )


def reads():
    field = F.concat(F.lit("["), F.col("target_name"), F.lit("]"))
    return F.concat(F.coalesce("target_table", F.lit("")), field)


@query(
    "diag_parameters_broken",
    ITEMS + f" /*main*/ select param, caption as shown_as, {READS} as reads, 'the model has no such field' as reason from fx_pi where target_kind is null",
)
def diag_parameters_broken(c: Context):
    """Rows of parameters that name a field that is gone."""
    return (
        items(c)
        .where(F.col("target_kind").isNull())
        .select("param", F.col("caption").alias("shown_as"), reads().alias("reads"), F.lit("the model has no such field").alias("reason"))
    )


@query(
    "parameter_edges",
    ITEMS + " /*main*/ select distinct target_kind, node_table, node_name, param as target, param as target_column from fx_pi where target_kind is not null",
)
def parameter_edges(c: Context):
    """From offered fields to the parameter that offers them."""
    return K.parameter_edges(items(c))


@query(
    "parameter_visuals",
    ITEMS + """ /*main*/ select distinct i.target_kind, i.node_table, i.node_name, u.visual, i.param as via_parameter from fx_pi i join fx_field_use u on u.tbl = i.param where i.target_kind is not null""",
)
def parameter_visuals(c: Context):
    """From offered fields to the visuals on the parameter."""
    return K.parameter_visuals(items(c), c.field_use)


@query(
    "shown_rows",
    "select s.visual, s.param, i.caption as shown from fx_selections s join fx_parameter_items i on i.param = s.param and i.item_order = s.selected",
)
def shown_rows(c: Context):
    """Row of a parameter each visual was saved on."""
    return K.shown_rows(c.selections, c.parameter_items)


@query(
    "page_edges",
    """select distinct e.src, e.sc, p.src as page from fx_edges e join fx_edges p on p.dst = e.dst and p.kind = 'page_to_visual' where e.kind in ('measure_to_visual', 'column_to_visual')""",
)
def page_edges(c: Context):
    """Data edges of visuals repeated to their pages."""
    on_page = c.edges.where(F.col("kind") == "page_to_visual").select(F.col("dst").alias("visual"), F.col("src").alias("page"))
    return K.page_edges(c.edges.where(F.col("kind").isin("measure_to_visual", "column_to_visual")), on_page.distinct())


@query(
    "modifies_measure",
    ITEMS + """,
fx_vm as (select distinct visual, tbl as measure_table, field as measure from fx_field_use where type = 'measure'
  union select u.visual, i.node_table, i.node_name from fx_field_use u join fx_pi i on i.param = u.tbl and i.target_kind = 'measure' where u.type = 'column') /*main*/
select distinct i.tbl, i.item, m.measure_table, m.measure from fx_field_use u join fx_calc_items i on i.tbl = u.tbl join fx_vm m on m.visual = u.visual where u.type = 'column'""",
)
def modifies_measure(c: Context):
    """Calculation items and the measures they change on some visual."""
    return K.modifies_measure(c.field_use, c.calc_items, items(c))


@query(
    "field_usage",
    "select type, tbl, field, count(*) as uses, count(distinct (page, visual)) as visuals, count(distinct page) as pages from fx_field_use group by 1, 2, 3",
)
def field_usage(c: Context):
    """Uses of every field."""
    return K.field_usage(c.field_use)


@query("table_usage", "select distinct tbl, page, visual from fx_field_use")
def table_usage(c: Context):
    """Visuals that use any field of a table."""
    return K.usage_of_tables(c.field_use)


@query(
    "top_measures",
    """select tbl, field, count(distinct visual) as visuals, count(distinct page) as pages from fx_field_use where type = 'measure' group by 1, 2
order by 3 desc, 4 desc, 1, 2 limit 5""",
)
def top_measures(c: Context):
    """The five measures on the most visuals."""
    return K.top_measures(c.field_use)


SHOWN = "trim(coalesce(display, '')) <> '' and lower(trim(display)) <> lower(trim(field))"


@query(
    "diag_field_renames",
    f"select distinct page, visual, type, tbl, field, trim(display) as shown_as, role from fx_field_use where {SHOWN}",
)
def diag_field_renames(c: Context):
    """Fields shown under another name."""
    return K.field_renames(c.field_use)


@query(
    "alias_index",
    RESOLVED + "," + ITEMS + f""" /*main*/
select r.node_kind, r.node_table, r.node_name, trim(u.display) as alias, 'visual' as origin, cast(null as varchar) as parameter, count(distinct (u.page, u.visual)) as visuals
from fx_field_use u join fx_res r on r.visual = u.visual and r.page = u.page and r.type = u.type and r.tbl = u.tbl and r.field = u.field
where r.node_kind is not null and trim(coalesce(u.display, '')) <> '' and lower(trim(u.display)) <> lower(trim(u.field)) group by 1, 2, 3, 4, 5, 6
union all select i.target_kind, i.node_table, i.node_name, trim(i.caption), 'parameter', i.param, count(distinct case when u.visual is not null then (u.page, u.visual) end)
from fx_pi i left join fx_field_use u on u.tbl = i.param where i.target_kind is not null and trim(i.caption) <> '' and lower(trim(i.caption)) <> lower(trim(i.node_name)) group by 1, 2, 3, 4, 5, 6""",
)
def alias_index(c: Context):
    """Labels each field is read under, by origin."""
    return K.alias_index(c.field_use, c.formulas, c.bi_columns, items(c))


# --- Impact inside the model -------------------------------------------------------------------

MV = """,
fx_shown as (select distinct h.measure as usr, u.page, u.visual from fx_field_use u join fx_homes h on h.measure = u.field and h.measure_home = u.tbl where u.type = 'measure'),
fx_via as (select h.measure, h.measure as usr, -1 as ord from fx_homes h
  union all select distinct r.measure, r.name, f.ord from fx_mref r join fx_formulas f on f.name = r.name where r.name <> r.measure),
fx_mv as (select v.measure, s.page, s.visual, case when min(v.ord) >= 0 then arg_min(v.usr, v.ord) end as via from fx_via v join fx_shown s on s.usr = v.usr group by 1, 2, 3)"""


def by_measure(c: Context):
    return c.shared("measure_visuals", lambda c: c.ws.save(K.measure_visuals(formulas(c), c.field_use), "measure-visuals"))


@query("measure_impact", CHAINED + MV + " /*main*/ select measure, page, visual, via from fx_mv")
def measure_impact(c: Context):
    """Visuals a measure reaches, itself or through a measure built on it."""
    return by_measure(c)


@query(
    "measure_dependents",
    CHAINED + " /*main*/ select distinct r.measure, r.name as dependent, h.measure_home as dependent_home from fx_mref r join fx_homes h on h.measure = r.name",
)
def measure_dependents(c: Context):
    """Measures built directly on a measure."""
    return K.measure_dependents(formulas(c))


@query(
    "column_impact",
    CHAINED + MV + """,
fx_cv as (select distinct u.tbl, u.field as col, u.page, u.visual, -1 as ord, cast(null as varchar) as who from fx_field_use u join fx_bi_columns b on b.tbl = u.tbl and b.col = u.field where u.type = 'column'
  union all select r.tbl, r.col, m.page, m.visual, f.ord, r.name from fx_cref r join fx_bi_columns b on b.tbl = r.tbl and b.col = r.col join fx_formulas f on f.name = r.name join fx_mv m on m.measure = r.name) /*main*/
select tbl, col, page, visual, case when min(ord) >= 0 then arg_min(who, ord) end as via from fx_cv group by 1, 2, 3, 4""",
)
def column_impact(c: Context):
    """Visuals a column reaches, itself or through a measure that reads it."""
    return K.column_visuals(formulas(c), c.field_use, c.bi_columns, by_measure(c))


CONSUMERS = REFS + "," + SOURCES.lstrip() + """,
fx_tm as (select distinct r.name, r.home, r.tbl from fx_cref r join fx_bi_columns b on b.tbl = r.tbl and b.col = r.col
  union select f.name, f.home, d.tbl from fx_formulas f join fx_data d on d.name = f.name
  union select name, home, ref_table from fx_tref
  union select name, home, home from fx_formulas f where not exists (select 1 from fx_data d where d.name = f.name)),
fx_st as (select distinct source_key, tbl from fx_tsrc),
fx_sm as (select distinct s.source_key, m.name, m.home from fx_st s join fx_tm m on m.tbl = s.tbl),
fx_um as (select distinct u.tbl as home, u.field as name, u.page, u.visual from fx_field_use u join fx_formulas f on f.home = u.tbl and f.name = u.field where u.type = 'measure'),
fx_ut as (select distinct u.tbl, u.page, u.visual from fx_field_use u join fx_bi_columns b on b.tbl = u.tbl and b.col = u.field where u.type = 'column' union select home, page, visual from fx_um),
fx_sv as (select s.source_key, u.page, u.visual from fx_st s join fx_ut u on u.tbl = s.tbl union select s.source_key, u.page, u.visual from fx_sm s join fx_um u on u.home = s.home and u.name = s.name)"""


def consumers(c: Context) -> K.Consumers:
    return c.shared(
        "consumers", lambda c: K.Consumers(c.ws, formulas(c), c.field_use, c.bi_columns, sources(c))
    )


@query(
    "source_consumers",
    "recursive" + CONSUMERS + """ /*main*/ select t.source_key, t.tables, coalesce(m.measures, 0) as measures, coalesce(v.visuals, 0) as visuals, coalesce(v.pages, 0) as pages
from (select source_key, count(*) as tables from fx_st group by 1) t left join (select source_key, count(*) as measures from fx_sm group by 1) m on m.source_key = t.source_key
left join (select source_key, count(*) as visuals, count(distinct page) as pages from fx_sv group by 1) v on v.source_key = t.source_key""",
)
def source_consumers(c: Context):
    """Tables, measures, visuals and pages built on every source."""
    return consumers(c).counts()


PHYS_CONSUMERS = LINEAGE + "," + CONSUMERS.lstrip() + """,
fx_at as (select p.tbl, p.sch, p.phys_table, s.source_key from fx_phys p join fx_st s on s.tbl = p.tbl),
fx_pk as (select distinct sch, phys_table, (select min(tbl) from fx_at b where b.phys_table = a.phys_table and b.sch is not distinct from a.sch) as model_table from fx_at a),
fx_ld as (select distinct k.sch, k.phys_table, k.model_table, a.source_key from fx_pk k join fx_at a on lower(a.phys_table) = lower(k.phys_table) and (k.sch is null or a.sch is null or lower(a.sch) = lower(k.sch))),
fx_pc as (select sch, phys_table, model_table, (select count(distinct (v.page, v.visual)) from fx_ld l join fx_sv v on v.source_key = l.source_key where l.phys_table = k.phys_table and l.sch is not distinct from k.sch) as visuals,
  (select count(distinct (m.home, m.name)) from fx_ld l join fx_sm m on m.source_key = l.source_key where l.phys_table = k.phys_table and l.sch is not distinct from k.sch) as measures from fx_pk k)"""


@query("physical_consumers", PHYS_CONSUMERS + " /*main*/ select sch, phys_table, model_table, visuals, measures from fx_pc")
def physical_consumers(c: Context):
    """Visuals and measures over all sources of a physical table."""
    return consumers(c).physical(physical(c))


@query(
    "top_sources",
    PHYS_CONSUMERS + " /*main*/ select sch, phys_table, model_table, visuals, measures from fx_pc order by visuals desc, measures desc, sch nulls first, phys_table limit 5",
)
def top_sources(c: Context):
    """The five physical tables that the most visuals stand on."""
    return K.top_sources(consumers(c).physical(physical(c)))


@query(
    "visual_lineage",
    "recursive" + CONSUMERS + "," + ITEMS + """,
fx_params as (select distinct param as tbl from fx_parameter_items),
fx_grp as (select distinct tbl from fx_calc_items),
fx_lm as (select distinct visual, tbl, field as name from fx_field_use where type = 'measure'),
fx_lc as (select distinct visual, tbl, field as col from fx_field_use where type <> 'measure'),
fx_plain as (select * from fx_lc c where not exists (select 1 from fx_grp g where g.tbl = c.tbl) and not exists (select 1 from fx_params p where p.tbl = c.tbl)),
fx_lch as (select distinct m.visual, k.measure, h.measure_home from fx_lm m join fx_chain k on k.name = m.name join fx_homes h on h.measure = k.measure),
fx_ing as (select distinct visual, tbl from fx_lc c where exists (select 1 from fx_grp g where g.tbl = c.tbl)),
fx_onp as (select distinct visual, tbl from fx_lc c where exists (select 1 from fx_params p where p.tbl = c.tbl)),
fx_lt as (select visual, tbl from fx_lm m where not exists (select 1 from fx_params p where p.tbl = m.tbl)
  union select m.visual, d.tbl from fx_lm m join fx_data d on d.name = m.name
  union select visual, measure_home from fx_lch h where not exists (select 1 from fx_params p where p.tbl = h.measure_home)
  union select visual, tbl from fx_plain union select visual, tbl from fx_ing
  union select o.visual, i.node_table from fx_onp o join fx_pi i on i.param = o.tbl and i.target_kind = 'column'
  union select o.visual, d.tbl from fx_onp o join fx_pi i on i.param = o.tbl and i.target_kind = 'measure' join fx_data d on d.name = i.node_name) /*main*/
select visual, 'measure' as kind, tbl||'['||name||']' as name from fx_lm
union select visual, 'chained measure', measure_home||'['||measure||']' from fx_lch
union select visual, 'column', tbl||'['||col||']' from fx_plain
union select g.visual, 'calculation item', g.tbl||'['||i.item||']' from fx_ing g join fx_calc_items i on i.tbl = g.tbl
union select o.visual, 'parameter item', i.node_table||'['||i.node_name||']' from fx_onp o join fx_pi i on i.param = o.tbl and i.target_kind is not null
union select visual, 'table', tbl from fx_lt
union select l.visual, 'source', s.source_key from fx_lt l join fx_st s on s.tbl = l.tbl""",
)
def visual_lineage(c: Context):
    """Everything a visual is built from, down to its sources."""
    params = c.parameter_items.select(F.col("param").alias("tbl")).distinct()
    return K.visual_lineage(c.ws, formulas(c), c.field_use, c.calc_items, items(c), params, sources(c))


@query(
    "field_lineage",
    "recursive" + CONSUMERS + """,
fx_flt as (select name, home as tbl from fx_formulas union select name, tbl from fx_own
  union select c.name, h.measure_home from fx_chain c join fx_homes h on h.measure = c.measure) /*main*/
select name, 'table' as kind, tbl as item from fx_flt union select l.name, 'source', s.source_key from fx_flt l join fx_st s on s.tbl = l.tbl""",
)
def field_lineage(c: Context):
    """Tables and sources every measure stands on."""
    return K.field_lineage(formulas(c), sources(c))


@query(
    "expression_consumers",
    r"""recursive
fx_tok as (select name as src, unnest(regexp_extract_all(expr, '\w+')) as tok from fx_shared_exprs),
fx_xs as (select distinct t.src, s.name as dst from fx_tok t join fx_shared_exprs s on s.name = t.tok),
fx_x1 as (select distinct q.tbl, s.name from (select tbl, unnest(regexp_extract_all(m, '\w+')) as tok from fx_m_queries) q join fx_shared_exprs s on s.name = q.tok),
fx_xc as (select tbl, name from fx_x1 union select c.tbl, x.dst from fx_xc c join fx_xs x on x.src = c.name) /*main*/
select name, tbl from fx_xc""",
)
def expression_consumers(c: Context):
    """Tables that reach a shared query by name."""
    return K.expression_consumers(c.ws, c.m_queries, c.shared_exprs)
