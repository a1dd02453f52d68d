"""A lineage estate derived by SQL from the TPC-H-like tables.

Every input of the library (nodes, edges, columns, relationships, mapping rows,
formula text, artifacts) is a view over the given tables, so that a query over
the estate reads all of their rows and grows with them.  The text runs unchanged
in Spark and in DuckDB; the checks inline the same views as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# --- The merged graph ----------------------------------------------------------
# sources (regions) feed models (nations, customers, suppliers), those feed BI
# tables, those feed measures and visuals (orders), which sit on pages.  Only
# accounts in credit are loaded into the BI model, so some models end unused.

VIEWS["edges"] = """
select 'src:'||n_regionkey as src, 'mod:n'||n_nationkey as dst, 'k'||(n_nationkey%2) as sc, 'k'||(n_nationkey%3) as tc, 'dbt' as kind from nation
union all select 'mod:n'||c_nationkey, 'mod:c'||c_custkey, case when c_custkey%5<>0 then 'K'||(c_custkey%3) end, case when c_custkey%5<>0 then 'k'||(c_custkey%2) end, 'dbt' from customer
union all select 'mod:n'||s_nationkey, 'mod:s'||s_suppkey, case when s_suppkey%5<>0 then 'K'||(s_suppkey%3) end, case when s_suppkey%5<>0 then 'k'||(s_suppkey%2) end, 'dbt' from supplier
union all select 'mod:c'||c_custkey, 'tab:c'||c_custkey, 'k'||(c_custkey%2), 'k'||(c_custkey%3), 'dbt_to_pbi' from customer where c_acctbal >= 0
union all select 'mod:s'||s_suppkey, 'tab:s'||s_suppkey, 'k'||(s_suppkey%2), 'k'||(s_suppkey%3), 'dbt_to_pbi' from supplier where s_acctbal >= 0
union all select distinct 'tab:s'||l_suppkey, 'mea:'||l_partkey||'.'||l_linenumber, case when l_partkey%7<>0 then 'K'||(l_partkey%3) end, cast(null as varchar(9)), 'column_to_measure' from lineitem
union all select distinct 'mea:'||l_partkey||'.'||l_linenumber, 'vis:'||l_orderkey, cast(null as varchar(9)), cast(null as varchar(9)), 'measure_to_visual' from lineitem
union all select distinct 'mea:'||l_partkey||'.'||l_linenumber, 'pag:'||o_orderpriority, cast(null as varchar(9)), cast(null as varchar(9)), 'measure_to_page' from lineitem join orders on l_orderkey = o_orderkey
union all select 'tab:c'||o_custkey, 'vis:'||o_orderkey, 'K'||(o_orderkey%3), cast(null as varchar(9)), 'column_to_visual' from orders
union all select distinct 'tab:c'||o_custkey, 'pag:'||o_orderpriority, 'K'||(o_orderkey%3), cast(null as varchar(9)), 'column_to_page' from orders
union all select 'pag:'||o_orderpriority, 'vis:'||o_orderkey, cast(null as varchar(9)), cast(null as varchar(9)), 'page_to_visual' from orders
"""

VIEWS["nodes"] = """
select 'src:'||r_regionkey as id, 'source' as kind, r_name as name, 'sources' as layer, 'dbt' as origin, 'source' as resource_type, 0 as test_count from region
union all select 'mod:n'||n_nationkey, 'model', n_name, 'staging/r'||n_regionkey, 'dbt', case when n_nationkey%6=0 then 'seed' else 'model' end, n_nationkey%3 from nation
union all select 'mod:c'||c_custkey, 'model', c_name, 'marts/'||lower(c_mktsegment), 'dbt', case when c_custkey%50=0 then 'snapshot' else 'model' end, cast(c_custkey%3 as int) from customer
union all select 'mod:s'||s_suppkey, 'model', s_name, 'marts/supply', 'dbt', 'model', cast(s_suppkey%2 as int) from supplier
union all select 'tab:c'||c_custkey, 'pbiTable', c_name, 'powerbi', 'pbi', cast(null as varchar(9)), 0 from customer
union all select 'tab:s'||s_suppkey, 'pbiTable', s_name, 'powerbi', 'pbi', cast(null as varchar(9)), 0 from supplier
union all select distinct 'mea:'||l_partkey||'.'||l_linenumber, 'measure', 'Measure '||l_partkey||'.'||l_linenumber, 'powerbi', 'pbi', cast(null as varchar(9)), 0 from lineitem
union all select 'vis:'||o_orderkey, 'visual', 'Order '||o_orderkey, 'powerbi', 'pbi', cast(null as varchar(9)), 0 from orders
union all select distinct 'pag:'||o_orderpriority, 'page', o_orderpriority, 'powerbi', 'pbi', cast(null as varchar(9)), 0 from orders
"""

# Declared columns; the middle one is spelled in upper case.
VIEWS["cols"] = "\nunion all ".join(
    f"select '{prefix}'||{key} as id, '{col}' as col from {table}"
    for prefix, key, table in (
        ("src:", "r_regionkey", "region"),
        ("mod:n", "n_nationkey", "nation"),
        ("mod:c", "c_custkey", "customer"),
        ("mod:s", "s_suppkey", "supplier"),
        ("tab:c", "c_custkey", "customer"),
        ("tab:s", "s_suppkey", "supplier"),
    )
    for col in ("k0", "K1", "k2")
)

# Flags of the BI columns.
VIEWS["bi_cols"] = "\nunion all ".join(
    f"select '{prefix}'||{key} as id, '{col}' as col, {key}%9={n} as is_calculated, {key}%4<>0 as warehouse_backed from {table}"
    for prefix, key, table in (("tab:c", "c_custkey", "customer"), ("tab:s", "s_suppkey", "supplier"))
    for n, col in enumerate(("k0", "K1", "k2"))
)

# Join keys between BI tables: a customer table joins the first supplier each
# order priority of it draws on.
VIEWS["relationships"] = """
select 'tab:c'||o_custkey as from_table, 'K'||(o_custkey%3) as from_column, 'tab:s'||min(l_suppkey) as to_table, 'k'||(min(l_suppkey)%3) as to_column, o_custkey%4<>0 as active
from orders join lineitem on l_orderkey = o_orderkey group by o_custkey, o_orderpriority
"""

# What a computed BI column reads (one derivation step).
VIEWS["depends_on"] = """
select 'tab:c'||c_custkey as table_id, 'k'||(c_custkey%3) as col, 'tab:c'||c_custkey as dep_table, 'K'||((c_custkey+1)%3) as dep_col from customer
union all select 'tab:s'||s_suppkey, 'k'||(s_suppkey%3), 'tab:s'||s_suppkey, 'k'||((s_suppkey+2)%3) from supplier
"""


# Edges as an extractor hands them over: references to relations that no node
# describes, and structural reads (filter and join columns).
VIEWS["raw_edges"] = VIEWS["edges"].rstrip() + """
union all select distinct 'hard.'||lower(p_brand), 'mod:n'||(p_size%25), 'c', 'k0', 'dbt' from part
union all select distinct 'mod:n'||c_nationkey, 'mod:c'||c_custkey, 'k'||(c_custkey%3), case when c_custkey%2=0 then '__filter__' else '__join__' end, 'dbt' from customer
union all select distinct 'mod:s'||s_suppkey, 'mod:s'||s_suppkey, 'k0', '__filter__', 'dbt' from supplier where s_acctbal < 0
"""

# Typed column edges: plain and aliased select items and expressions.
VIEWS["select_items"] = """
select src, sc, dst, tc, length(src)%5 <> 0 as is_plain, length(dst)%2 = 0 as is_aliased from (
select 'src:'||n_regionkey as src, 'k'||(n_nationkey%2) as sc, 'mod:n'||n_nationkey as dst, 'k'||(n_nationkey%3) as tc from nation
union all select 'mod:n'||c_nationkey, 'k'||(c_custkey%3), 'mod:c'||c_custkey, 'k'||(c_custkey%2) from customer
union all select 'mod:n'||s_nationkey, 'k'||(s_suppkey%3), 'mod:s'||s_suppkey, 'k'||(s_suppkey%2) from supplier
union all select 'mod:s'||l_suppkey, 'k'||(l_partkey%2), 'mod:p'||l_partkey, 'k'||(l_linenumber%2) from lineitem) t
"""

# --- The boundary between warehouse and BI model ------------------------------------
# Relations share names (ambiguous matches), requests come quoted, upper case and
# with missing parts, mapping rows carry every defect.

_PART_TABLE = "case when p_size <= 25 then p_name else p_name||' '||p_size end"
_BI_TABLE = "(p_partkey - p_partkey%20)"

VIEWS["relations"] = f"""
select p_partkey as ord, 'part:'||p_partkey as id, case when p_size%7=0 then 'source' when p_size%11=0 then 'unknown' else 'model' end as kind, {_PART_TABLE} as name,
p_brand as db, p_type as sch, case when p_size%9=0 then cast(null as varchar(9)) else p_brand||'.'||p_type||'.'||{_PART_TABLE} end as relation from part
"""
VIEWS["relation_cols"] = "\nunion all ".join(
    f"select 'part:'||p_partkey as id, 'K{n}' as col from part" for n in range(3)
)
VIEWS["requests"] = f"""
select p_partkey as req, case when p_partkey%5=0 then null else '"'||upper(p_brand)||'"' end as db, case when p_partkey%7=0 then '' else ' '||p_type||' ' end as sch,
case when p_partkey%11=0 then 'zz' when p_partkey%13=0 then '' else upper({_PART_TABLE}) end as tbl from part
"""
VIEWS["mapping"] = f"""
select p_partkey+2 as row_no, p_brand as from_database, case when p_partkey%17=0 then '' else p_type end as from_schema,
case when p_partkey%19=0 then p_name||' gone' else {_PART_TABLE} end as from_table, case when {_BI_TABLE}%60=0 then '' else 'k'||(p_size%4) end as from_column,
case when p_size=50 then 'No table '||p_partkey else 'Table '||{_BI_TABLE} end as to_table, case when {_BI_TABLE}%60=0 and p_partkey%13<>0 then '' else 'K'||(p_size%2) end as to_column from part
union all select p_partkey+1000000002, upper(p_brand), p_type, lower({_PART_TABLE}), case when {_BI_TABLE}%60=0 then '' else 'K'||(p_size%4) end,
'TABLE '||{_BI_TABLE}, case when {_BI_TABLE}%60=0 and p_partkey%13<>0 then '' else 'k'||(p_size%2) end from part where p_size >= 45
"""
VIEWS["model_tables"] = f"select distinct 'Table '||{_BI_TABLE} as tbl, {_BI_TABLE}%80<>0 as has_source from part"
VIEWS["model_cols"] = f"select distinct 'Table '||{_BI_TABLE} as tbl, 'k'||(p_size%3) as col from part"
VIEWS["physical"] = f"""
select p_partkey as ord, case when p_size%2=0 then p_brand end as db, case when p_size%5=0 then null else p_type end as sch, {_PART_TABLE} as tbl, 'k'||(p_partkey%4) as col,
'table '||{_BI_TABLE} as model_table, 'K'||(p_partkey%3) as model_column from part
"""

# --- The BI model ---------------------------------------------------------------------
# Tables are customers, measures parts, visuals orders, field uses line items.

_NC = "(select count(*) from customer)"
_NS = "(select count(*) from supplier)"
_NP = "(select 5 * count(*) from supplier)"

VIEWS["formulas"] = f"""
select 'm'||p_partkey as name, 'T'||(p_partkey % {_NC}) as home, p_partkey as ord,
case when p_size%3=0 then '/* [gone] '||p_type||' */ ' else '' end||'DIVIDE('||case when p_size%2=0 then '[m'||cast((p_partkey - p_partkey%3)/3 as bigint)||']' else '1' end||', SUM(''T'||(p_partkey % {_NC})||'''[c'||(p_size%4)||' ])) + COUNTROWS(T'||((p_partkey*7) % {_NC})||') // [x]'
||case when p_size%5=0 then chr(10)||'+ IF("[no]" = "a", [ m'||(p_partkey%10)||'], T'||((p_partkey*3) % {_NC})||'[c1]) + countrows( ''T'||(p_partkey % {_NC})||''' )' else '' end as expr from part
"""
VIEWS["bi_tables"] = "select 'T'||c_custkey as tbl, c_custkey as ord from customer"
VIEWS["bi_columns"] = "\nunion all ".join(
    f"select 'T'||c_custkey as tbl, 'c{n}' as col, {'c_custkey%4=0' if n == 3 else 'false'} as is_calculated, "
    + (
        f"case when c_custkey%4=0 then 'RELATED(T'||((c_custkey*3) % {_NC})||'[c0]) + [m'||c_custkey||']' end as expr from customer"
        if n == 3
        else "cast(null as varchar(9)) as expr from customer"
    )
    for n in range(4)
)
VIEWS["calc_partitions"] = f"""
select 'X'||s_suppkey as tbl, case when s_suppkey%5=0 then 'm' else 'calculated' end as source_type, 'FILTER(T'||s_suppkey||', ''T'||((s_suppkey*2) % {_NC})||'''[c1] > 0) X'||s_suppkey||'[c0]' as body from supplier
"""
# Uses of fields in visuals; some name fields the model does not have, some differ in case.
VIEWS["field_use"] = f"""
select 'v'||l_orderkey as visual, o_orderpriority as page, 'type'||(l_orderkey%4) as visual_type, case when l_linenumber%3=0 then 'column' when l_linenumber=7 then 'hierarchy' else 'measure' end as type,
case when l_linenumber%3=0 then 'T'||o_custkey when l_linenumber=7 then 'T'||(l_suppkey*20) when l_linenumber=2 then 't'||(l_partkey % {_NC}) else 'T'||(l_partkey % {_NC}) end as tbl,
case when l_linenumber%3=0 then 'c'||(l_suppkey%5) when l_linenumber=7 then 'h1' when l_linenumber=5 then 'gone'||l_partkey else 'm'||l_partkey end as field,
case when l_linenumber%2=0 then 'Y' else 'Category' end as role,
case when l_returnflag='A' then 'Label '||(l_partkey%100) when l_returnflag='N' then ' M'||l_partkey||' ' end as display, l_orderkey*100000 + l_linenumber*10000 + l_suppkey%10000 as ord from lineitem join orders on l_orderkey = o_orderkey
union all select 'v'||o_orderkey, o_orderpriority, 'slicer', 'column', 'P'||(o_custkey % {_NP}), 'P'||(o_custkey % {_NP}), 'Rows', cast(null as varchar(9)), o_orderkey*100000 + 90000 from orders where o_orderstatus = 'P'
union all select 'v'||o_orderkey, o_orderpriority, 'slicer', 'column', 'G'||(o_custkey % {_NS}), 'G', 'Rows', cast(null as varchar(9)), o_orderkey*100000 + 95000 from orders where o_orderstatus = 'F'
"""
# Rows of field parameters: columns, table-less measures, other spellings, fields that are gone.
VIEWS["parameter_items"] = f"""
select 'P'||(p_partkey % {_NP}) as param, 'Caption '||p_partkey as caption, case when p_size%3=0 then null when p_size%3=1 then 't'||(p_partkey % {_NC}) else 'T'||(p_partkey % {_NC}) end as target_table,
case when p_size%10=0 then 'gone' when p_size%3=0 then 'M'||p_partkey else 'C'||(p_size%4) end as target_name, cast((p_partkey - p_partkey % {_NP}) / {_NP} as bigint) as item_order from part
"""
VIEWS["selections"] = f"select 'v'||o_orderkey as visual, 'P'||(o_custkey % {_NP}) as param, o_orderkey%5 as selected from orders where o_orderstatus = 'P'"
VIEWS["calc_items"] = "\nunion all ".join(f"select 'G'||s_suppkey as tbl, 'item{n}' as item from supplier" for n in range(3))

# Query text of the BI tables, one source and navigation style per kind of customer.
VIEWS["m_queries"] = f"""
select 'T'||c_custkey as tbl, c_custkey as ord, 'let'||chr(10)||'  Source = '||case c_custkey%7
when 0 then 'Sql.Database("srv'||c_nationkey||'.database.windows.net", "db'||(c_custkey%11)||'"),'||chr(10)||'  Nav = Source{{[Schema="'||lower(c_mktsegment)||'", Item="item'||c_custkey||'"]}}[Data],'
when 1 then 'Snowflake.Databases("acct'||c_nationkey||'", "WH"),'||chr(10)||'  Nav = Source{{ [ Item = "item'||c_custkey||'", Schema = "raw" ] }}[Data],'
when 2 then 'GoogleBigQuery.Database(),'||chr(10)||'  a = Source{{[Name="proj'||c_nationkey||'"]}}[Data],'||chr(10)||'  b = a{{[Name="'||lower(c_mktsegment)||'", Kind="Schema"]}}[Data],'||chr(10)||'  Nav = b{{[Name="item'||c_custkey||'", Kind="Table"]}}[Data],'
when 3 then 'shared_'||(c_custkey % {_NS})||','||chr(10)||'  Nav = Source,'
when 4 then 'Excel.Workbook(File.Contents("C:/data/'||case when c_custkey%2=0 then 'SharePoint/' else '' end||'f'||c_nationkey||'.xlsx"), null, true),'||chr(10)||'  Nav = Source{{[Name="Sheet'||c_custkey||'"]}}[Data],'
when 5 then 'Value.NativeQuery(PostgreSQL.Database("pg'||c_nationkey||'", "sales"), "SELECT a FROM raw.[orders'||c_nationkey||'] o JOIN `items` i ON o.k = i.k WHERE x in (select k from (select 1))", null),'||chr(10)||'  Nav = Source,'
else 'Sql.Database(#"Param'||c_nationkey||'", "db1"),'||chr(10)||'  Nav = Source{{[Schema="dbo", Item="item'||c_custkey||'"]}}[Data],' end
||chr(10)||'  Ren = Table.RenameColumns(Nav, {{{{"src_a", "c0"}}, {{"src_'||(c_custkey%3)||'", "c1"}}}}),'
||chr(10)||'  Sel = Table.SelectColumns(Ren, {{"c0", "c1", "c2", "c'||(c_custkey%5)||'x"}}),'
||case when c_custkey%2=0 then chr(10)||'  Rem = Table.RemoveColumns(Sel, {{"c2"}}),' else '' end
||chr(10)||'  Add = Table.AddColumn(Sel, "Key'||(c_custkey%3)||'", each if [c0] = null then Text.From([#"c 1"]) else Record.Field([Name = "x"], "c") & [c2]),'
||case when c_custkey%3=0 then chr(10)||'  Mrg = Table.NestedJoin(Add, {{"c0", "c1"}}, T'||((c_custkey*5) % {_NC})||', {{"c2"}}, "x", JoinKind.Inner),' else '' end
||case when c_custkey%5=0 then chr(10)||'  Cmb = Table.Combine({{Add, T'||((c_custkey*3) % {_NC})||', #"T'||((c_custkey*2) % {_NC})||'"}}),' else '' end
||chr(10)||'  Last = Table.SelectRows(Add, each true)'||chr(10)||'in'||chr(10)||'  Last' as m from customer
"""
# Shared queries, in chains of up to five, and parameter queries.
VIEWS["shared_exprs"] = """
select 'shared_'||s_suppkey as name, s_suppkey as ord, case when s_suppkey%5=0 then 'let Source = Oracle.Database("ora'||s_nationkey||'"), Nav = Source{[Schema="own", Item="shared'||s_suppkey||'"]}[Data] in Nav'
else 'let Source = shared_'||(s_suppkey-1)||' in Source' end as expr from supplier
union all select 'Param'||n_nationkey, n_nationkey + 1000000000, '"host'||n_nationkey||'" meta [IsParameterQuery=true, Type="Text"]' from nation
"""
# Text of field parameters, both row widths, quoted, bare and missing table names.
VIEWS["parameter_text"] = """
select p_partkey as id, case when p_size%7=0 then 'm' when p_size%4=0 then null else 'calculated' end as source_type, p_size%9=0 as has_marker,
case when p_size%6=0 then 'SWITCH(TRUE(), 1, 2)' else '{'||chr(10)||'  ("The ""'||p_name||'""'||'", NAMEOF('''||p_type||' T''[c'||(p_size%3)||']), '||p_size||'),'||chr(10)||'  ("b", nameof(T'||p_size||'[x y]) , -1, "G1"),'||chr(10)||'  ( "c",NAMEOF( [m'||p_partkey||'] ))'||chr(10)||'}' end as body from part
"""
VIEWS["sql_text"] = """
select p_partkey as id, 'select * from '||case p_size%4 when 0 then 'raw.' when 1 then '"Raw" . ' else '' end||'['||lower(p_type)||p_size||'] a left join `t'||p_size||'` b on a.k = b.k where exists (select 1 from'||chr(10)||' only_'||lower(p_type)||') and x from (select' as sql from part
"""
# Indented model text, one file per supplier.
VIEWS["model_text"] = """
select s_suppkey as doc, 'relationship r'||s_suppkey||chr(10)||'  fromColumn: ''A b.c''.''c '||s_nationkey||''''||chr(10)||'  toColumn: D.'||s_name||chr(10)||case when s_suppkey%2=0 then '  isActive: false'||chr(10) else '' end
||case when s_suppkey%3=0 then chr(9)||'fromCardinality: one'||chr(10)||'  crossFilteringBehavior: bothDirections'||chr(10) else '' end||'annotation x: y'||chr(10)||'relationship ''q '||s_suppkey||''' = z'||chr(10)||'  fromColumn: X.y'||chr(10)||'  fromColumn: X.y'||s_nationkey||chr(10)||'  toColumn: plain'||chr(10) as body from supplier
"""

# --- Artifacts -----------------------------------------------------------------------------
# One small project (manifest and catalog) and one small report per customer, one
# visual definition per order, one mapping sheet per part.

VIEWS["manifest_json"] = """
select c_custkey as doc, '{"metadata":{"project_name":"p'||c_custkey||'"},"nodes":{"model.p.m'||c_custkey||'":{"resource_type":"model","name":"m'||c_custkey||'","database":"DB","schema":"s'||c_nationkey||'","path":"staging/'||lower(c_mktsegment)||'/m.sql","description":"'||case when c_custkey%3=0 then '' else 'about '||c_custkey end||'","tags":["'||c_mktsegment||'","t'||(c_custkey%5)||'"],'
||case when c_custkey%4=0 then '' else '"compiled_code":"select 1",' end||'"config":{"materialized":"'||case when c_custkey%6=0 then 'ephemeral' else 'view' end||'"},"columns":{"K0":{"data_type":"int","description":"d","quote":true},"K1":{"description":""},"only_docs":{}}},'
||'"test.p.t'||c_custkey||'":{"resource_type":"test","name":"generic_'||c_custkey||'","attached_node":"model.p.m'||c_custkey||'","column_name":"K0","test_metadata":{"name":"not_null"},"config":{"severity":"warn"}},'
||'"test.p.u'||c_custkey||'":{"resource_type":"test","name":"singular_'||c_custkey||'"'||case when c_custkey%2=0 then ',"attached_node":"model.p.m'||c_custkey||'"' else '' end||'},'
||'"analysis.p.a'||c_custkey||'":{"resource_type":"analysis","name":"a'||(c_custkey%40)||'"},"seed.p.d'||c_custkey||'":{"resource_type":"seed","name":"d'||c_custkey||'","alias":"x","path":"d.csv","schema":"raw"}},'
||'"sources":{"source.p.s'||c_custkey||'":{"resource_type":"source","name":"s'||c_custkey||'","identifier":"ident'||c_custkey||'","database":"DB","schema":"raw'||c_nationkey||'"'||case when c_custkey%3=0 then '' else ',"source_name":"crm'||(c_custkey%7)||'"' end||',"columns":{}}},'
||'"exposures":{"exposure.p.e'||c_custkey||'":{"resource_type":"exposure","name":"e'||c_custkey||'"}}}' as body from customer
"""
# The same manifests as they arrive: some cut off, empty, null, of another shape or without a part.
VIEWS["delivered_json"] = f"""
select doc, case when doc%7=0 then substr(body, 1, length(body) - 1 - doc%200) when doc%11=0 then '' when doc%13=0 then null when doc%17=0 then '['||body||']'
when doc%5=0 then replace(body, '"sources":', '"origins":') when doc%19=0 then '{{}}' else body end as body from ({VIEWS["manifest_json"]}) m
"""
VIEWS["catalog_json"] = """
select c_custkey as doc, '{"nodes":{'||case when c_custkey%5=0 or c_custkey%6=0 then '' else '"model.p.m'||c_custkey||'":{"metadata":{"schema":"s"},"columns":{"K0":{"type":"bigint","index":2},"K1":{"type":"text","index":1},"Z":{"type":"date","index":3}}}' end
||'},"sources":{"source.p.s'||c_custkey||'":{"columns":{"a":{"type":"int","index":1}}}}}' as body from customer
"""
VIEWS["parents"] = """
select 'model.p.m'||c_custkey as model, 'model.p.m'||((c_custkey*7) % (select count(*) from customer)) as parent from customer
union all select 'model.p.m'||c_custkey, 'source.p.s'||((c_custkey*3) % (select count(*) from customer)) from customer
union all select 'model.p.m'||c_custkey, 'seed.p.d'||c_custkey from customer
"""
VIEWS["derived_columns"] = "select 'model.p.m'||c_custkey as node, 'k'||(c_custkey%3) as col from customer where c_acctbal > 5000"
VIEWS["visual_json"] = """
select o_orderkey as visual, '{"name":"v'||o_orderkey||'","visual":{"visualType":"t'||(o_orderkey%4)||'",'
||case o_orderkey%3 when 0 then '"visualContainerObjects":{"title":[{"properties":{"text":{"expr":{"Literal":{"Value":"''Title '||o_orderkey||'''"}}}}}]},' when 1 then '"visualContainerObjects":{"general":[{"properties":{"title":{"expr":{"Literal":{"Value":"''General''"}}}}}]},' else '' end
||'"query":{"queryState":{"Y":{"projections":[{"field":{"Measure":{"Expression":{"SourceRef":{"Entity":"T'||(o_custkey%20)||'"}},"Property":"m'||(o_custkey%9)||'"}},"queryRef":"x","displayName":"'||case when o_orderkey%2=0 then 'M'||(o_custkey%9) else ' Label '||(o_custkey%11) end||'"},'
||'{"field":{"Column":{"Expression":{"SourceRef":{"Entity":"T'||(o_custkey%20)||'"}},"Property":"c1"}},"nativeQueryRef":"n"}]},'
||'"Rows":{"projections":[{"field":{"Hierarchy":{"Expression":{"SourceRef":{"Entity":"Date"}},"Hierarchy":"Year"}}}]'||case when o_orderkey%5=0 then ',"fieldParameters":[{"parameterExpr":{"Column":{"Expression":{"SourceRef":{"Entity":"P'||(o_custkey%7)||'"}},"Property":"P"}},"index":'||(o_orderkey%3)||',"length":1}]' else '' end||'}},'
||'"sortDefinition":{"sort":[{"field":{"Measure":{"Expression":{"SourceRef":{"Entity":"T'||(o_custkey%20)||'"}},"Property":"m'||(o_custkey%8)||'"}}}]}}},'
||'"filterConfig":{"filters":[{"field":{"Column":{"Expression":{"SourceRef":{"Entity":"F"}},"Property":"f'||(o_orderkey%6)||'"}}},{"name":"no field"}]}}' as body from orders
"""
VIEWS["pages_json"] = """
select c_custkey as report, '{"pageOrder":["k2","k'||(c_custkey%2)||'"],"activePageName":"k2","landingPageName":"k'||(c_custkey%3)||'"}' as body from customer
"""
VIEWS["page_json"] = "\nunion all ".join(
    f"""select c_custkey as report, 'folder{n}_'||c_custkey as page_id, '{{'||case when c_custkey%5={n} then '' else '"name":"k{n}",' end||'"displayName":"'||case when c_custkey%4={n} then '' else c_mktsegment||' {n}' end||'"'||"""
    f"""case when c_custkey%3={n} then ',"width":1920,"height":1080' else '' end||case when c_custkey%7={n} then ',"visibility":"HiddenInViewMode"' when c_custkey%7=5 then ',"visibility":"AlwaysVisible"' else '' end||'}}' as body from customer"""
    for n in range(3)
)
VIEWS["mapping_csv"] = """
select p_partkey as doc, case when p_size%10=0 then 'from database,FROM_SCHEMA,To Table,From Column,To Column,Note' else 'Note,from_database, From  Schema ,FROM TABLE,To Table,from column,to_column' end||chr(13)||chr(10)||'  '||chr(10)
||'n,"'||p_brand||'",'||p_type||' ,"a ""'||p_name||'"", b",T'||p_size||',"",'||chr(10)||chr(10)||'"x, y",'||p_brand||', s,'||p_name||',"T, '||p_size||'",c1,  c2 '||case when p_size%2=0 then chr(10)||'short,'||p_brand else '' end as body from part
"""
# Table references found in queries, with the text of the query they stand in.
VIEWS["table_refs"] = """
select p_partkey as id, case when p_size%3=0 then '' else lower(p_brand) end as cat, case when p_size%11=0 then '' else lower(p_type) end as db,
case when p_size%4=0 then 'Nowhere'||p_size else upper(p_name) end as tbl, case when p_size%8=0 then 'select * from nowhere'||p_size else 'select 1' end as raw_code from part
"""
VIEWS["searchables"] = """
select p_partkey as id, p_name as label, split(p_brand||','||p_type||','||'Alias '||p_size, ',') as aliases, 'L'||(p_size%3) as layer, split('t'||(p_size%5)||','||p_type, ',') as tags,
case when p_size%2=0 then 'measure' else 'dbtModel' end as facet from part
"""
# The graph's nodes and columns with what the search looks at beside their names.
VIEWS["search_nodes"] = f"""
select id, kind, name, layer, origin, case when kind = 'measure' and length(name)%4 <> 0 then 'Home '||length(name) end as home_table, case when origin = 'dbt' and length(id)%3 <> 0 then 'DB.'||name end as relation,
case when origin = 'dbt' then split('t'||(length(name)%5)||','||layer, ',') when kind = 'visual' and length(name)%2 = 0 then split('shown', ',') end as tags,
case when kind = 'measure' and length(name)%3 = 0 then split('Sold '||name||',Units of '||name, ',') when kind = 'page' then split('Priority', ',') end as aliases from ({VIEWS["nodes"]}) n
"""
VIEWS["search_cols"] = f"select id, col, case when length(id)%2 = 0 then split('key '||col||',Sort '||id, ',') end as aliases from ({VIEWS['cols']}) k"
VIEWS["folders"] = """
select c_custkey as id, lower(r_name)||'/'||lower(n_name)||case when c_custkey%3=0 then '' else '/'||lower(c_mktsegment) end as layer from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey
"""

# Nodes with the place they are stored; report nodes have none.
VIEWS["everything"] = """
select 'part:'||p_partkey as id, 'model' as kind, p_brand as db, case when p_size%9=0 then null else p_type end as sch from part
union all select 'T'||c_custkey, 'pbiTable', null, null from customer
union all select 'v'||o_orderkey, 'visual', null, null from orders
"""

# Views that stand for stored input tables: written once per data folder.
WRITTEN = {"edges", "nodes", "cols", "relationships"}

# Views of documents and other long text, with the column that tells their rows apart.
TEXTS = {
    "manifest_json": "doc",
    "catalog_json": "doc",
    "delivered_json": "doc",
    "visual_json": "visual",
    "page_json": "page_id",
    "mapping_csv": "doc",
    "m_queries": "tbl",
    "formulas": "name",
    "parameter_text": "id",
    "sql_text": "id",
    "model_text": "doc",
}

# Distinct rows spelled from few keys, by the beginning of their select.  Every key stands in the row, so rows
# without a null are as many as their keys, and Spark may take the distinct before it spells them.
KEYS = {
    "select distinct 'tab:s'||l_suppkey, 'mea:'||": ("l_suppkey", "l_partkey", "l_linenumber"),
    "select distinct 'mea:'||l_partkey||'.'||l_linenumber, 'vis:'||": ("l_partkey", "l_linenumber", "l_orderkey"),
    "select distinct 'mea:'||l_partkey||'.'||l_linenumber, 'pag:'||": ("l_partkey", "l_linenumber", "o_orderpriority"),
    "select distinct 'tab:c'||o_custkey, 'pag:'||": ("o_custkey", "o_orderpriority", "o_orderkey%3 as o_orderkey"),
    "select distinct 'mea:'||l_partkey||'.'||l_linenumber, 'measure'": ("l_partkey", "l_linenumber"),
}


def spelled_last(text: str) -> str:
    """The same rows as ``text`` gives, with distinct taken of keys, in numbers, where ``KEYS`` knows them."""
    lines = []
    for line in text.split("\n"):
        for start, keys in KEYS.items():
            head, found, rest = line.partition(start)
            if found:
                items, _, source = (found + rest).removeprefix("select distinct ").partition(" from ")
                names = [k.split("%")[0] for k in keys]
                known = " and ".join(f"{n} is not null" for n in names)
                spelled = f"select {items} from (select distinct {', '.join(keys)} from {source} where {known}) k"
                line = f"{head}{spelled} union all select distinct {items} from {source} where not ({known})"
                break
        lines.append(line)
    return "\n".join(lines)


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the parquet files of ``sf_dir``."""
    for table in TABLES:
        if _mentions(text, table):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)


def _mentions(text: str, table: str) -> bool:
    return table in text.replace(",", " ").replace("(", " ").replace(")", " ").split()
