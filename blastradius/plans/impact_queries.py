"""Queries on the merged graph: closures, impact, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from blastradius.functions import norm as N
from blastradius.operators import diagnostics as D
from blastradius.operators import impact as I
from blastradius.operators import walks as W
from blastradius.operators.closure import StateGraph
from blastradius.plans.registry import Context, query
from blastradius.sources.sink import read_graph, write_graph

# Walk of the checks: every node and every declared column as an origin.
WALK = """recursive
fx_e as (select distinct e.src, nullif(lower(trim(e.sc)), '') as sc, e.dst,
    case when n.kind in ('measure', 'visual') then null else nullif(lower(trim(e.tc)), '') end as tc, n.kind as dkind
  from fx_edges e join fx_nodes n on n.id = e.dst where e.kind <> 'page_to_visual'),
fx_walk as (
  select origin, ocol, id, col, ex, kind from (
    select id as origin, cast(null as varchar) as ocol, id, cast(null as varchar) as col, true as ex, 'start' as kind from fx_nodes
    union all select id, lower(col), id, lower(col), true, 'start' from fx_cols) s
  union
  select w.origin, w.ocol, e.dst, e.tc, w.ex and (w.ocol is null or w.col is null or e.sc is not null), e.dkind
  from fx_walk w join fx_e e on e.src = w.id where w.col is null or e.sc is null or w.col = e.sc),
fx_counts as (select origin, ocol,
    count(distinct case when kind = 'measure' then id end) as measures,
    count(distinct case when kind = 'visual' then id end) as visuals,
    count(distinct case when kind = 'visual' and ex then id end) as visuals_exact,
    count(distinct case when kind = 'pbiTable' then id end) as tables,
    count(distinct case when kind = 'model' then id end) as models,
    count(distinct case when kind = 'page' then id end) as pages
  from fx_walk group by 1, 2)"""
BAND = "case when visuals >= 10 then 'high' when visuals >= 3 then 'medium' when visuals >= 1 then 'low' else 'none' end"


def states(c: Context) -> StateGraph:
    return c.shared("state_graph", lambda c: StateGraph(c.ws, c.nodes, c.edges, c.cols))


def impact(c: Context):
    return c.shared("impact", lambda c: I.impact(c.ws, c.nodes, c.edges, c.cols, states(c)))


@query(
    "closure",
    WALK + """ /*main*/ select s.id, s.col, w.id as reached, s.col is null or bool_or(w.ex) as exact
from (select id, cast(null as varchar) as col from fx_nodes union all select id, col from fx_cols) s
join fx_walk w on w.origin = s.id and w.ocol is not distinct from lower(s.col) where w.kind in ('model', 'pbiTable', 'measure') group by 1, 2, 3""",
)
def closure(c: Context):
    """Models, tables and measures downstream of every node and column, and how exactly."""
    return I.reached_nodes(states(c), c.cols, ["model", "pbiTable", "measure"])


@query(
    "impact_bands",
    WALK + f""" /*main*/
select s.id, s.col, c.measures, c.visuals, c.tables, c.models, c.pages, c.visuals_exact, {BAND} as band
from (select id, cast(null as varchar) as col from fx_nodes union all select id, col from fx_cols) s
join fx_counts c on c.origin = s.id and c.ocol is not distinct from lower(s.col)""",
)
def impact_bands(c: Context):
    """Blast radius with its band, for every node and every declared column."""
    return impact(c).select(
        "id", "col", "measures", "visuals", "tables", "models", "pages", "visuals_exact", "band"
    )


@query(
    "impact_node",
    WALK + " /*main*/ select origin as id, measures, visuals, tables, models, pages from fx_counts where ocol is null",
)
def impact_node(c: Context):
    """What lies downstream of every node, by kind."""
    return impact(c).where(F.col("col").isNull()).select("id", "measures", "visuals", "tables", "models", "pages")


@query(
    "impact_column",
    WALK + """ /*main*/
select s.id, s.col, measures, visuals, tables, models, pages from fx_cols s
join fx_counts c on c.origin = s.id and c.ocol = lower(s.col)""",
)
def impact_column(c: Context):
    """What lies downstream of every declared column, by kind."""
    return impact(c).where(F.col("col").isNotNull()).select("id", "col", "measures", "visuals", "tables", "models", "pages")


@query(
    "impact_exact",
    WALK + """ /*main*/
select s.id, s.col, visuals, visuals_exact, visuals - visuals_exact as visuals_widened from fx_cols s
join fx_counts c on c.origin = s.id and c.ocol = lower(s.col)""",
)
def impact_exact(c: Context):
    """How many of the visuals of a column are reached without widening to a table."""
    return (
        impact(c)
        .where(F.col("col").isNotNull())
        .select("id", "col", "visuals", "visuals_exact", (F.col("visuals") - F.col("visuals_exact")).alias("visuals_widened"))
    )


@query(
    "impact_band",
    f"""select o_custkey as custkey, visuals, {BAND} as band from (
select o_custkey, count(*) as visuals from orders group by 1) t""",
)
def impact_band(c: Context):
    """The band of a visual count, here the orders of a customer."""
    counts = c.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("visuals"))
    return counts.withColumn("band", N.impact_band(F.col("visuals")))


# --- Join keys --------------------------------------------------------------------

SIDES = """
fx_sides as (select from_table as table_id, from_column as col, to_table as other_table, to_column as other_column, active from fx_relationships
  union all select to_table, to_column, from_table, from_column, active from fx_relationships)"""
KEYS = SIDES + """,
fx_rels as (select lower(table_id) as t, lower(col) as k,
    least(lower(table_id)||'['||lower(col)||']', lower(other_table)||'['||lower(other_column)||']')||'~'||
    greatest(lower(table_id)||'['||lower(col)||']', lower(other_table)||'['||lower(other_column)||']') as rel, bool_or(active) as active
  from fx_sides group by 1, 2, 3),
fx_keys as (select distinct t, k from fx_rels),
fx_keycols as (select c.id, c.col, lower(c.id) as t, lower(c.col) as k from fx_cols c where exists (select 1 from fx_keys y where y.t = lower(c.id) and y.k = lower(c.col))),
fx_serves as (select t, k, id as key_table, col as key_column from fx_keycols
  union select lower(d.dep_table), lower(d.dep_col), y.id, y.col from fx_depends_on d join fx_keycols y on y.t = lower(d.table_id) and y.k = lower(d.col)),
fx_feeders as (
  select 'report' as side, c.id, c.col, s.key_table, s.key_column from fx_cols c join fx_serves s on s.t = lower(c.id) and s.k = lower(c.col)
    where not exists (select 1 from fx_keys y where y.t = lower(c.id) and y.k = lower(c.col))
  union select 'warehouse', c.id, c.col, s.key_table, s.key_column from fx_edges e
    join fx_serves s on s.t = lower(e.dst) and s.k = lower(e.tc) join fx_cols c on c.id = e.src and lower(c.col) = lower(e.sc)
    where e.kind = 'dbt_to_pbi')"""
DIRECT = KEYS + """,
fx_held as (select c.id, c.col, r.rel, r.active from fx_cols c join fx_rels r on r.t = lower(c.id) and r.k = lower(c.col)
  union select f.id, f.col, r.rel, r.active from fx_feeders f join fx_rels r on r.t = lower(f.key_table) and r.k = lower(f.key_column)),
fx_held1 as (select id, col, rel, bool_or(active) as active from fx_held group by 1, 2, 3),
fx_direct as (select id, col, count(*) as n, count(case when not active then 1 end) as inactive from fx_held1 group by 1, 2
  union all select id, null, count(*), count(case when not active then 1 end) from (select id, rel, bool_or(active) as active from fx_held1 group by 1, 2) q group by 1)"""
DOWNSTREAM = """,
fx_back as (select distinct dst as bt, lower(tc) as bk, src as t, lower(sc) as k from fx_edges where sc is not null and tc is not null),
fx_jr as (select distinct t as ot, k as ok, t, k from fx_keycols union select j.ot, j.ok, b.t, b.k from fx_jr j join fx_back b on b.bt = j.t and b.bk = j.k),
fx_later as (select c.id, c.col, r.rel, bool_or(r.active) as active from fx_jr j join fx_rels r on r.t = j.ot and r.k = j.ok
  join fx_cols c on lower(c.id) = j.t and lower(c.col) = j.k group by 1, 2, 3),
fx_later1 as (select id, col, count(*) as n, count(case when not active then 1 end) as inactive from fx_later group by 1, 2
  union all select id, null, count(*), count(case when not active then 1 end) from (select id, rel, bool_or(active) as active from fx_later group by 1, 2) q group by 1),
fx_downstream as (select l.* from fx_later1 l where not exists (select 1 from fx_direct d where d.id = l.id and d.col is not distinct from l.col))"""
FLOOR = WALK + "," + DIRECT + DOWNSTREAM + f""",
fx_plain as (select s.id, s.col, c.visuals, {BAND} as band
  from (select id, cast(null as varchar) as col from fx_nodes union all select id, col from fx_cols) s
  join fx_counts c on c.origin = s.id and c.ocol is not distinct from lower(s.col)),
fx_want as (select p.*, coalesce(d.n, 0) as relationships, coalesce(w.n, 0) as relationships_downstream,
    case p.band when 'none' then 0 when 'low' then 1 when 'medium' then 2 else 3 end as rk,
    case when d.n > 0 then 2 when w.n > 0 then 1 else 0 end as fl
  from fx_plain p left join fx_direct d on d.id = p.id and d.col is not distinct from p.col
  left join fx_downstream w on w.id = p.id and w.col is not distinct from p.col),
fx_floor as (select id, col, visuals, relationships, relationships_downstream,
    case when fl > rk then (case fl when 2 then 'medium' else 'low' end) else band end as band,
    case when fl > rk then band end as band_raised_from,
    case when fl <= rk then null when relationships = 1 then 'holds a join key' when relationships > 1 then 'holds '||relationships||' join keys'
      else 'feeds a join key downstream' end as band_reason
  from fx_want)"""


@query("relationship_sides", SIDES + " /*main*/ select table_id, col, other_table, other_column, active from fx_sides")
def relationship_sides(c: Context):
    """Every join listed on both of its end columns."""
    return I.relationship_sides(c.relationships)


def links(c: Context):
    return c.given("edges").where(F.col("kind") == "dbt_to_pbi")


def feeders(c: Context):
    return c.shared(
        "feeders", lambda c: c.ws.save(I.key_feeders(c.relationships, c.depends_on, links(c), c.cols), "feeders")
    )


def graph(c: Context) -> W.NodeGraph:
    return c.shared("node_graph", lambda c: W.NodeGraph(c.ws, c.nodes, c.edges))


def visuals_of(c: Context, crossing):
    """Visuals downstream of any crossing node, each once."""
    flow = W.NodeGraph(c.ws, c.nodes, c.edges.where(F.col("kind") != "page_to_visual"))
    return W.downstream_of(flow, crossing.select(F.col("source").alias("id")), "visual")


@query("key_feeders", KEYS + " /*main*/ select side, id, col, key_table, key_column from fx_feeders")
def key_feeders(c: Context):
    """Columns that feed a join key in one derivation step, on either side of the boundary."""
    return feeders(c)


def direct(c: Context):
    return c.shared(
        "direct", lambda c: c.ws.save(I.relationship_reach(c.relationships, feeders(c), c.cols), "direct")
    )


@query("relationship_reach", DIRECT + " /*main*/ select id, col, n as relationships, inactive as relationships_inactive from fx_direct")
def relationship_reach(c: Context):
    """Relationships a column or node holds up or feeds."""
    return direct(c)


def downstream(c: Context):
    return c.shared(
        "downstream",
        lambda c: c.ws.save(I.join_reach(c.ws, c.given("edges"), c.relationships, c.cols, direct(c)), "downstream"),
    )


@query(
    "join_reach",
    "recursive" + DIRECT + DOWNSTREAM + """ /*main*/
select id, col, n as relationships_downstream, inactive as relationships_downstream_inactive from fx_downstream""",
)
def join_reach(c: Context):
    """Relationships reached further downstream, where none is held directly."""
    return downstream(c)


def floored(c: Context):
    return c.shared("floored", lambda c: c.ws.save(I.band_floor(impact(c), direct(c), downstream(c)), "floored"))


@query("band_floor", FLOOR + " /*main*/ select * from fx_floor")
def band_floor(c: Context):
    """Bands after the floor that join keys set, with the band they were raised from."""
    return floored(c)


LINKED = """
fx_ends as (select src as id, lower(sc) as k from fx_edges where kind in ('dbt', 'dbt_to_pbi') and sc is not null
  union select dst, lower(tc) from fx_edges where kind in ('dbt', 'dbt_to_pbi') and tc is not null),
fx_lineage as (select c.id, c.col, exists (select 1 from fx_ends e where e.id = c.id and e.k = lower(c.col)) as has_lineage from fx_cols c)"""


def lineage_marks(c: Context):
    return I.has_lineage(c.cols, c.given("edges"))


@query("has_lineage", LINKED + " /*main*/ select id, col, has_lineage from fx_lineage")
def has_lineage(c: Context):
    """Declared columns marked where column lineage reaches them."""
    return lineage_marks(c)


@query(
    "coverage",
    FLOOR + "," + LINKED + """ /*main*/
select a.linked, a.backed, a.excluded, a.linked * 1000 // a.backed as traced_permille, b.widest_visuals, b.high_columns from
(select count(case when warehouse_backed and has_lineage then 1 end) as linked, count(case when warehouse_backed then 1 end) as backed,
   count(case when not warehouse_backed then 1 end) as excluded
 from fx_bi_cols b join fx_lineage l on l.id = b.id and l.col = b.col) a,
(select max(visuals) as widest_visuals, count(case when band = 'high' then 1 end) as high_columns
 from fx_floor f join fx_nodes n on n.id = f.id where f.col is not null and n.origin = 'dbt') b""",
)
def coverage(c: Context):
    """Share of warehouse-backed BI columns that are traced, and how wide the widest reach is."""
    return D.coverage(c.bi_cols, lineage_marks(c), floored(c), c.nodes)


# --- Diagnostics on the merged graph ------------------------------------------------


@query(
    "diag_columns_unlinked",
    LINKED + """ /*main*/ select b.id as table_id, b.col from fx_bi_cols b join fx_lineage l on l.id = b.id and l.col = b.col
where not b.is_calculated and not l.has_lineage""",
)
def diag_columns_unlinked(c: Context):
    """BI columns that are not computed and that no warehouse column reaches."""
    return D.columns_unlinked(c.bi_cols, lineage_marks(c)).select("table_id", "col")


@query(
    "diag_keys_unlinked",
    LINKED + "," + SIDES + """ /*main*/ select b.id as table_id, b.col, s.other_table||'['||s.other_column||']' as joins,
case when s.active then 'active' else 'inactive' end as state, 'join key with no dbt column behind it' as reason
from fx_bi_cols b join fx_lineage l on l.id = b.id and l.col = b.col join fx_sides s on lower(s.table_id) = lower(b.id) and lower(s.col) = lower(b.col)
where not b.is_calculated and not l.has_lineage and b.warehouse_backed""",
)
def diag_keys_unlinked(c: Context):
    """Join keys of warehouse-backed tables with no warehouse column behind them."""
    return D.keys_unlinked(c.bi_cols, lineage_marks(c), I.relationship_sides(c.relationships))


CONSUMED = """recursive
fx_cons as (select src as id from fx_edges where kind = 'dbt_to_pbi' union select e.src from fx_edges e join fx_cons r on e.dst = r.id where e.kind = 'dbt')"""


@query("consumed_nodes", CONSUMED + " /*main*/ select id from fx_cons")
def consumed_nodes(c: Context):
    """Warehouse nodes the report stands on, directly or through others."""
    return consumed(c)


def consumed(c: Context):
    return c.shared("consumed", lambda c: W.consumed_nodes(c.ws, c.given("edges"), links(c)))


@query(
    "diag_nodes_not_used",
    CONSUMED + " /*main*/ select id, name, kind, layer from fx_nodes n where origin = 'dbt' and not exists (select 1 from fx_cons r where r.id = n.id)",
)
def diag_nodes_not_used(c: Context):
    """Warehouse nodes that no report table stands on."""
    return D.nodes_not_used(c.nodes, consumed(c))


@query(
    "diag_untested_high",
    FLOOR + """ /*main*/ select n.id, n.name, n.layer, f.visuals from fx_nodes n join fx_floor f on f.id = n.id and f.col is null
where n.origin = 'dbt' and n.test_count = 0 and f.band = 'high'""",
)
def diag_untested_high(c: Context):
    """Warehouse nodes of the high band without a test, widest first."""
    return D.untested_high(c.nodes, floored(c))


# --- Walks ------------------------------------------------------------------------------

ARCS = """
fx_arc as (select distinct e.src, e.dst from fx_edges e join fx_nodes a on a.id = e.src join fx_nodes b on b.id = e.dst)"""
HOPS = ARCS + """,
fx_h1 as (select n.id, a.dst as reached, 'down' as direction from fx_nodes n join fx_arc a on a.src = n.id where n.kind = 'model'
  union select n.id, a.src, 'up' from fx_nodes n join fx_arc a on a.dst = n.id where n.kind = 'model'),
fx_h2 as (select id, direction, reached, 1 as hop from fx_h1
  union all select h.id, h.direction, a.dst, 2 from fx_h1 h join fx_arc a on a.src = h.reached where h.direction = 'down'
  union all select h.id, h.direction, a.src, 2 from fx_h1 h join fx_arc a on a.dst = h.reached where h.direction = 'up'),
fx_hops as (select id, direction, reached, min(hop) as hop from fx_h2 where reached <> id group by 1, 2, 3)"""


def hops(c: Context):
    return c.shared(
        "hops", lambda c: c.ws.save(W.walk_hops(graph(c), c.nodes.where(F.col("kind") == "model"), 2), "hops")
    )


@query("walk_hops", HOPS + " /*main*/ select id, direction, reached, hop from fx_hops")
def walk_hops(c: Context):
    """Neighbours of every model within two hops, up and down."""
    return hops(c)


@query(
    "expand_preview",
    HOPS + """ /*main*/ select id, direction, count(*) as added from fx_hops h
where not exists (select 1 from fx_nodes n where n.id = h.reached and n.kind in ('source', 'pbiTable')) group by 1, 2""",
)
def expand_preview(c: Context):
    """Nodes a two-hop expansion would add to a canvas that shows sources and BI tables."""
    return W.expand_preview(hops(c), c.nodes.where(F.col("kind").isin("source", "pbiTable")))


TRACE_DOWN = """recursive
fx_te as (select distinct e.src, nullif(lower(trim(e.sc)), '') as sc, e.dst,
    case when n.kind in ('measure', 'visual', 'page') then null else nullif(lower(trim(e.tc)), '') end as tc
  from fx_edges e join fx_nodes n on n.id = e.dst where e.kind <> 'page_to_visual'),
fx_td as (select id, col, id as pos, lower(col) as c, true as ex, 0 as hop from fx_cols where id like 'src:%'
  union select t.id, t.col, e.dst, e.tc, t.ex and (t.c is null or e.sc is not null), t.hop + 1
  from fx_td t join fx_te e on e.src = t.pos where t.c is null or e.sc is null or e.sc = t.c),
fx_down as (select id, col, pos as reached, min(hop) as hop, count(distinct case when ex then c end) as columns, not bool_or(ex) as inferred
  from fx_td where hop > 0 group by 1, 2, 3)"""


def traced(c: Context, starts, direction: str):
    graph = c.shared(f"trace_graph_{direction}", lambda c: W.trace_graph(c.ws, c.nodes, c.edges, c.cols, direction))
    return W.trace(c.ws, c.nodes, c.edges, c.cols, starts, direction, graph)


def traced_down(c: Context):
    def build(c):
        starts = c.cols.join(c.nodes.where(F.col("kind") == "source").select("id"), "id", "left_semi")
        return c.ws.save(traced(c, starts, "down"), "traced-down")

    return c.shared("traced_down", build)


@query("trace_down", TRACE_DOWN + " /*main*/ select id, col, reached, hop, columns, inferred from fx_down")
def trace_down(c: Context):
    """Everything on the downstream path of every source column."""
    return traced_down(c)


@query(
    "trace_up",
    """recursive
fx_te as (select distinct e.dst, nullif(lower(trim(e.tc)), '') as tc, e.src, nullif(lower(trim(e.sc)), '') as sc
  from fx_edges e join fx_nodes n on n.id = e.src where e.kind <> 'page_to_visual' and n.kind not in ('measure', 'visual', 'page')
  union select e.dst, nullif(lower(trim(e.tc)), ''), e.src, null from fx_edges e join fx_nodes n on n.id = e.src
  where e.kind <> 'page_to_visual' and n.kind in ('measure', 'visual', 'page')),
fx_tu as (select id, id as pos, cast(null as varchar) as c, true as ex, 0 as hop from fx_nodes where kind = 'visual'
  union select t.id, e.src, e.sc, t.ex and (t.c is null or e.tc is not null), t.hop + 1
  from fx_tu t join fx_te e on e.dst = t.pos where t.c is null or e.tc is null or e.tc = t.c),
fx_all as (select * from fx_tu where hop > 0
  union all select t.id, p.src, null, true, t.hop + 1 from fx_tu t join fx_edges p on p.dst = t.pos and p.kind = 'page_to_visual') /*main*/
select id, cast(null as varchar) as col, pos as reached, min(hop) as hop, count(distinct case when ex then c end) as columns, not bool_or(ex) as inferred
from fx_all group by 1, 2, 3""",
)
def trace_up(c: Context):
    """Everything every visual is built from, with its page."""
    starts = c.nodes.where(F.col("kind") == "visual").select("id", F.lit(None).cast("string").alias("col"))
    return traced(c, starts, "up")


@query(
    "trace_page",
    """select src as id, cast(null as varchar) as col, dst as reached, 1 as hop, cast(0 as bigint) as columns, false as inferred
from (select distinct src, dst from fx_edges where kind = 'page_to_visual') t""",
)
def trace_page(c: Context):
    """A selected page lights the visuals it holds and nothing beyond."""
    starts = c.nodes.where(F.col("kind") == "page").select("id", F.lit(None).cast("string").alias("col"))
    return W.trace(c.ws, c.nodes, c.given("edges"), c.cols, starts, "down")


@query(
    "hits_by_page",
    TRACE_DOWN + """ /*main*/ select d.id, d.col, p.src as page, count(*) as visuals from fx_down d
join (select distinct src, dst from fx_edges where kind = 'page_to_visual') p on p.dst = d.reached group by 1, 2, 3""",
)
def hits_by_page(c: Context):
    """Traced visuals per page."""
    return W.hits_by_page(traced_down(c), c.edges)


@query(
    "linked_only",
    "recursive" + ARCS + """,
fx_up as (select src as id from fx_edges where kind = 'dbt_to_pbi' union select a.src from fx_arc a join fx_up u on a.dst = u.id),
fx_dn as (select dst as id from fx_edges where kind = 'dbt_to_pbi' union select a.dst from fx_arc a join fx_dn u on a.src = u.id) /*main*/
select id from fx_up union select id from fx_dn""",
)
def linked_only(c: Context):
    """Nodes on a path that crosses into the report."""
    return W.linked_only(graph(c), links(c))


@query(
    "upstream_depth",
    "recursive" + ARCS + """,
fx_anc as (select n.id, a.src as up from fx_nodes n join fx_arc a on a.dst = n.id where n.kind in ('measure', 'pbiTable')
  union select r.id, a.src from fx_anc r join fx_arc a on a.dst = r.up) /*main*/
select n.id, count(distinct case when u.kind = 'model' then u.id end) as models, count(distinct case when u.kind = 'source' then u.id end) as sources
from fx_nodes n left join fx_anc a on a.id = n.id and a.up <> n.id left join fx_nodes u on u.id = a.up where n.kind in ('measure', 'pbiTable') group by 1""",
)
def upstream_depth(c: Context):
    """How many models and sources every field owner (measure or table) stands on."""
    return W.upstream_depth(graph(c))


@query(
    "page_summary",
    "recursive" + ARCS + """,
fx_held as (select distinct src as page, dst as visual from fx_edges where kind = 'page_to_visual'),
fx_pu as (select h.page, a.src as up from fx_held h join fx_arc a on a.dst = h.visual union select p.page, a.src from fx_pu p join fx_arc a on a.dst = p.up) /*main*/
select n.id, (select count(*) from fx_held h where h.page = n.id) as visuals,
  count(distinct case when u.kind = 'model' then u.id end) as models, count(distinct case when u.kind = 'pbiTable' then u.id end) as tables,
  count(distinct case when u.kind = 'measure' then u.id end) as measures
from fx_nodes n left join fx_pu p on p.page = n.id left join fx_nodes u on u.id = p.up where n.kind = 'page' group by 1""",
)
def page_summary(c: Context):
    """Visuals of every page and what they stand on together."""
    return W.page_summary(graph(c), c.edges)


@query(
    "column_ancestry",
    """recursive
fx_step as (select distinct lower(dst) as id, lower(tc) as col, lower(src) as aid, lower(sc) as acol from fx_edges where kind = 'dbt' and sc is not null and tc is not null),
fx_ca as (select id, col, aid, acol, 1 as hop from fx_step union select r.id, r.col, s.aid, s.acol, r.hop + 1 from fx_ca r join fx_step s on s.id = r.aid and s.col = r.acol),
fx_near as (select id, col, aid, acol, min(hop) as hop from fx_ca group by 1, 2, 3, 4),
fx_from as (select id, col, aid, acol, hop from fx_near union all select distinct id, col, id, col, 0 from fx_step),
fx_via as (select n.id, n.col, n.aid, n.acol, n.hop, min(row(f.aid, f.acol)) as via from fx_near n
  join fx_step s on s.aid = n.aid and s.acol = n.acol join fx_from f on f.id = n.id and f.col = n.col and f.aid = s.id and f.acol = s.col and f.hop + 1 = n.hop
  group by 1, 2, 3, 4, 5) /*main*/
select id, col, aid as ancestor, acol as ancestor_col, hop, via[1] as via_id, via[2] as via_col from fx_via""",
)
def column_ancestry(c: Context):
    """All columns a warehouse column comes from, with the step each is reached through."""
    return W.column_ancestry(c.ws, c.given("edges"))


ITEM_TYPE = """case when is_plain and (not is_aliased or sc = tc) then 'pass-through' when is_plain then 'rename' else 'transformation' end"""


def typed(c: Context):
    kind = N.lineage_type(F.col("is_plain"), F.col("is_aliased"), F.col("sc"), F.col("tc"))
    return c.select_items.withColumn("lineage_type", kind)


@query("lineage_type", f"select src, sc, dst, tc, {ITEM_TYPE} as lineage_type from fx_select_items")
def lineage_type(c: Context):
    """Class of every select item: pass-through, rename or transformation."""
    return typed(c).select("src", "sc", "dst", "tc", "lineage_type")


@query(
    "path_lineage_type",
    f"""recursive
fx_typed as (select src, lower(sc) as sc, dst, lower(tc) as tc, max(case {ITEM_TYPE} when 'transformation' then 2 when 'rename' then 1 else 0 end) as rk from fx_select_items group by 1, 2, 3, 4),
fx_pl as (select * from fx_typed union select p.src, p.sc, t.dst, t.tc, greatest(p.rk, t.rk) from fx_pl p join fx_typed t on t.src = p.dst and t.sc = p.tc) /*main*/
select src, sc, dst, tc, case max(rk) when 2 then 'transformation' when 1 then 'rename' else 'pass-through' end as lineage_type from fx_pl group by 1, 2, 3, 4""",
)
def path_lineage_type(c: Context):
    """Strongest change on any path between two columns."""
    return W.path_lineage_type(c.ws, typed(c))


@query(
    "reveal_counts",
    """select id, kind, direction, count(*) as neighbours from (
select distinct a.id, b.kind, 'out' as direction, b.id as other from fx_edges e join fx_nodes a on a.id = e.src join fx_nodes b on b.id = e.dst
  where (a.kind = 'pbiTable' and b.kind in ('page', 'measure', 'pbiTable')) or (a.kind = 'page' and b.kind = 'visual')
union select a.id, b.kind, 'in', b.id from fx_edges e join fx_nodes a on a.id = e.dst join fx_nodes b on b.id = e.src where a.kind = 'page' and b.kind = 'measure') t
group by 1, 2, 3""",
)
def reveal_counts(c: Context):
    """One-hop neighbours of tables and pages by kind."""
    return W.reveal_counts(c.nodes, c.edges)


@query(
    "layer_flow",
    """select a.layer as src_layer, b.layer as dst_layer, count(*) as edges from fx_edges e join fx_nodes a on a.id = e.src join fx_nodes b on b.id = e.dst
where a.layer <> b.layer group by 1, 2""",
)
def layer_flow(c: Context):
    """Edges between layers."""
    return W.layer_flow(c.nodes, c.edges)


@query(
    "node_filter",
    """select id, kind, layer from fx_nodes where kind in ('source', 'model', 'pbiTable') and (origin = 'pbi'
or (resource_type in ('model', 'seed') and (resource_type <> 'model' or layer in ('marts/supply', 'marts/machinery'))))""",
)
def node_filter(c: Context):
    """Nodes left by kind, resource and layer filters; layers bind models only."""
    kept = W.node_filter(
        c.nodes, ["source", "model", "pbiTable"], ["model", "seed"], ["marts/supply", "marts/machinery"]
    )
    return kept.select("id", "kind", "layer")


# --- Assembling the graph ---------------------------------------------------------------


@query(
    "graph_union",
    """select id, kind, name from fx_nodes where origin = 'pbi'
union all select id, kind, name from fx_nodes where (origin = 'dbt' or kind = 'page') and id not in (select id from fx_nodes where origin = 'pbi')""",
)
def graph_union(c: Context):
    """Warehouse and report nodes in one table; the report wins on a shared id."""
    warehouse = c.nodes.where((F.col("origin") == "dbt") | (F.col("kind") == "page"))
    return W.graph_union(warehouse, c.nodes.where(F.col("origin") == "pbi")).select("id", "kind", "name")


@query(
    "edge_union",
    """select src, dst, sc, tc, kind from fx_edges where kind in ('dbt', 'dbt_to_pbi')
union all select src, dst, sc, tc, kind from fx_edges where kind <> 'dbt'""",
)
def edge_union(c: Context):
    """Warehouse and report edges in one table; both sides name the links between them."""
    warehouse = c.given("edges").where(F.col("kind").isin("dbt", "dbt_to_pbi"))
    return W.edge_union(warehouse, c.given("edges").where(F.col("kind") != "dbt")).select("src", "dst", "sc", "tc", "kind")


@query(
    "graph_sink",
    """select 'whole' as tenant, id, kind, name from fx_nodes
union all select '007' as tenant, id, kind, name from fx_nodes where origin = 'pbi'""",
)
def graph_sink(c: Context):
    """Two graphs written, one of them again, and all read back."""

    def build(c):
        path, nodes = f"{c.ws.root}/graph", c.nodes.select("id", "kind", "name", "origin")
        write_graph({"nodes": nodes}, path, "007")
        write_graph({"nodes": nodes}, path, "whole")
        write_graph({"nodes": nodes.where(F.col("origin") == "pbi")}, path, "007")
        return read_graph(c.spark, path, "nodes").select("tenant", "id", "kind", "name")

    return c.shared("graph-sink", build)


@query(
    "stub_nodes",
    """select id, 'unknown' as kind, split_part(id, '.', -1) as name, 'unknown' as layer from (select src as id from fx_raw_edges union select dst from fx_raw_edges) e
where not exists (select 1 from fx_nodes n where n.id = e.id)""",
)
def stub_nodes(c: Context):
    """Nodes for ids that only edges name."""
    return W.stub_nodes(c.nodes, c.raw_edges)


@query(
    "edge_integrity",
    """select src, dst, kind, 'dangling source' as problem from fx_raw_edges e where not exists (select 1 from fx_nodes n where n.id = e.src)
union all select src, dst, kind, 'dangling target' from fx_raw_edges e where not exists (select 1 from fx_nodes n where n.id = e.dst)
union all select src, dst, kind, 'self' from fx_raw_edges where src = dst""",
)
def edge_integrity(c: Context):
    """Edges with a missing end and edges onto themselves."""
    return W.edge_integrity(c.nodes, c.raw_edges, c.ws)


@query(
    "structural_edges",
    "select src, dst, sc, tc from fx_raw_edges where tc like '\\_\\_%' escape '\\'",
)
def structural_edges(c: Context):
    """Columns read by filters and joins, kept apart from column lineage."""
    return W.structural_edges(c.raw_edges, "__").select("src", "dst", "sc", "tc")


@query(
    "children",
    "select distinct src as parent, sc as parent_col, dst as child, tc as child_col from fx_edges where kind = 'dbt'",
)
def children(c: Context):
    """Parents turned into children."""
    return (
        c.given("edges").where(F.col("kind") == "dbt")
        .select(F.col("src").alias("parent"), F.col("sc").alias("parent_col"), F.col("dst").alias("child"), F.col("tc").alias("child_col"))
        .distinct()
    )
