"""Extraction from text, on short golden strings."""

import pytest
from pyspark.sql import functions as F

from blastradius.functions import norm as N
from blastradius.functions import text as T
from blastradius.operators import extract as X
from blastradius.operators.catalog import partial_key_leads
from blastradius.sources.mapping_csv import cells, mapping_scan, mapping_scan_errors
from blastradius.sources.sink import write_graph


def value(spark, fn, text):
    got = spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("v")).collect()[0].v
    if isinstance(got, list):
        return [tuple(g) if isinstance(g, tuple) else g for g in got]
    return got


@pytest.mark.parametrize(
    "m,schema,table,path",
    [
        ('Nav = Source{[Schema="marts", Item="fct"]}[Data]', "marts", "fct", []),
        ('Nav = Source{ [ Item = "dim" , Schema="marts" ] } [Data]', "marts", "dim", []),
        ('a = S{[Name="acct"]}[Data], b = a{[Name="cur", Kind="Schema"]}[Data], c = b{[Name="ev"]}[Data]', None, "ev", ["acct", "cur", "ev"]),
        ("let x = 1 in x", None, None, []),
    ],
)
def test_navigation(spark, m, schema, table, path):
    got = value(spark, T.navigation, m)
    assert (got.sch, got.tbl, got.path) == (schema, table, path)


def test_renames_and_projection(spark):
    m = 'Table.RenameColumns(x, {{"a", "b"}, {"c d","e"}}), s = Table.SelectColumns(x, {"b","e","z"}), r = Table.RemoveColumns(s, {"z"})'
    assert value(spark, T.renames, m) == [("a", "b"), ("c d", "e")]
    assert value(spark, T.final_projection, m) == ["b", "e"]
    assert value(spark, T.final_projection, "Table.RemoveColumns(s, {\"z\"})") is None


def test_renames_end_with_their_list(spark):
    assert value(spark, T.renames, 'X = Table.RenameColumns(S, {{"a","A"}}), Y = f(Z, {"q","r"})') == [("a", "A")]
    nested = 'Table.RenameColumns(Table.RenameColumns(f(x, {"k", "l"}), {{"a", "b"}}), {{"say ""x""", "c}"}}, MissingField.Ignore), g({"m", "n"})'
    assert sorted(value(spark, T.renames, nested)) == [("a", "b"), ('say "x"', "c}")]
    assert value(spark, T.final_projection, 'Table.SelectColumns(x, {"a}b", "c", "d"}), r = Table.RemoveColumns(s, "c")') == ["a}b", "d"]


def test_many_calls_in_one_text(spark):
    steps = [f'S{n} = Table.AddColumn(S{n - 1}, "K{n}", each [a{n}])' for n in range(2000)]
    got = value(spark, T.added_columns, "let " + ", ".join(steps) + " in S")
    assert [(g[0], list(g[1])) for g in got] == [(f"K{n}", [f"a{n}"]) for n in range(2000)]


def test_a_declared_parameter_anywhere(spark):
    queries = spark.createDataFrame([("a", 'Sql.Database("srv","db"), x > #"Cutoff"'), ("b", 'Sql.Database("srv","db"), x > #"Step"'), ("c", 'OData.Feed("u"), #"Cutoff"')], "tbl string, m string")
    shared = spark.createDataFrame([("Cutoff", '"1" meta [IsParameterQuery=true]'), ("Step", "let x = 1 in x")], "name string, expr string")
    assert {r.tbl: r.parameterized for r in X.connectors(queries, shared).collect()} == {"a": True, "b": False, "c": False}


def test_one_name_in_many_schemas(spark):
    names = spark.range(2000).selectExpr("cast(id as string) as pid", "'t' as low", "case when id > 0 then concat('s', id) end as s")
    sources = spark.range(2000).selectExpr("'t' as low", "case when id > 1 then concat('s', id) end as s", "concat('k', id) as source_key")
    got = partial_key_leads(names, sources)
    # Row 0 names no schema and meets all; every other meets its own schema and the two sources without one.
    assert got.count() == 2000 + 1998 + 2 * 1999
    low = [[str(x) for x in p] for p in (("1", "k0"), ("1", "k1"), ("5", "k5"), ("0", "k7"))]
    assert {tuple(x) for x in low} <= {tuple(r) for r in got.collect()}


def test_long_rename_list_is_read_whole(spark):
    names = [(f"source column number {n}", f"c{n}") for n in range(400)]
    m = "Table.RenameColumns(x, {" + ", ".join('{"%s", "%s"}' % p for p in names) + "})"
    assert value(spark, T.renames, m) == names


def test_added_column_reads_fields_not_records(spark):
    m = 'Table.AddColumn(prev, "Key", each if [a] = null then f([#"b ""x"" c"], "]") else g(h([d e])), type text), y = [z]'
    got = value(spark, T.added_columns, m)
    assert [(g[0], list(g[1])) for g in got] == [("Key", ["a", 'b "x" c', "d e"])]
    assert [list(g[1]) for g in value(spark, T.added_columns, 'Table.AddColumn(p, "K", each x{[Name = "n"]})')] == [[]]


def test_formula_refs(spark):
    dax = "CALCULATE([Total], 'My T'[Col ], T2[c]) + [Other] // [x]\n + /* [y] */ COUNTROWS( 'My T' ) & \"[z]\" + 'Date'[Date] + [After]"
    clean = value(spark, T.clean_formula, dax)
    assert value(spark, T.measure_refs, clean) == ["Total", "Other", "After"]
    assert value(spark, T.column_refs, clean) == [("My T", "Col"), ("T2", "c"), ("Date", "Date")]
    assert value(spark, T.table_refs, clean) == ["My T"]


def test_parameter_rows_of_both_widths(spark):
    body = '{ ("A ""q""", NAMEOF(\'t x\'[c]), 0), ("B", NAMEOF(Bare[d e]), 1, "Grp"), ("C", nameof( [m] )) }'
    assert value(spark, T.parameter_rows, body) == [
        ('A "q"', "t x", "c", 0, None), ("B", "Bare", "d e", 1, "Grp"), ("C", None, "m", None, None),
    ]
    assert value(spark, T.parameter_rows, "SWITCH(TRUE(), 1, 2)") == []


@pytest.mark.parametrize(
    "ref,table,col",
    [("T.C", "T", "C"), ("'a.b'.c", "a.b", "c"), ("T.'c.d'", "T", "c.d"), ("'a b'.'c d'", "a b", "c d"), ("alone", None, "alone"), ("a.b.c", "a", "b.c")],
)
def test_endpoint(spark, ref, table, col):
    got = value(spark, T.endpoint, ref)
    assert (got.tbl, got.col) == (table, col)


def test_connectors(spark):
    m = 'Sql.Database("s", "d") Excel.Workbook(File.Contents("p.xlsx")) PostgreSQL.Database("only one") Snowflake.Databases(#"Acct") Dataverse.Contents() Excel.Workbook(x)'
    got = {(g[0], g[1], g[2], g[4], g[5]) for g in value(spark, T.connectors, m)}
    assert got == {
        ("SQL Server", "s", "d", None, False), ("Excel", None, None, "p.xlsx", False),
        ("Snowflake", "Acct", None, None, True), ("Dataverse", None, None, None, False),
    }
    assert [g[0] for g in value(spark, T.connectors, "Binary.Decompress(Binary.FromText(1))")] == ["Inline Literal"]


def test_shared_ref(spark):
    assert value(spark, T.shared_ref, "let\n  Source = shared_x\nin Source") == "shared_x"
    assert value(spark, T.shared_ref, 'let S = #"a b" in S') == "a b"
    assert value(spark, T.shared_ref, "m\nmode: import\nsource =\n  let\n  Source = shared_y in Source") == "shared_y"
    assert value(spark, T.shared_ref, "Source") is None


def test_sheet_cells(spark):
    assert value(spark, cells, 'a, "b, ""c""" ,,"",d"x,y"z') == ["a", 'b, "c"', "", "", "dx,yz"]


def test_sheet_numbering_and_headings(spark):
    body = "\n from_database , From  Schema,FROM TABLE,To Table\r\n\r\nd,s,t,T\n\nd2,s2\n"
    docs = spark.createDataFrame([("a", body), ("b", "From Table\nx")], "doc string, body string")
    rows = [(r.row_no, r.from_database, r.from_table, r.to_table, r.to_column) for r in mapping_scan(docs).where("doc = 'a'").collect()]
    assert rows == [(2, "d", "t", "T", ""), (3, "d2", "", "", "")]
    assert [(r.doc, r.missing) for r in mapping_scan_errors(docs).collect()] == [("b", "From Database, From Schema, To Table")]


def test_names(spark):
    row = spark.range(1).select(
        N.norm(F.lit("\t A ")).alias("n"),
        N.relation_key(F.lit('"DB"'), F.lit(None), F.lit("`[t]")).alias("k"),
        N.layer_of(F.lit("model"), F.lit("staging\\crm//base/m.sql")).alias("l"),
        N.rename_of(F.lit(" total "), F.lit("Total")).alias("same"),
        N.rename_of(F.lit(" Sum "), F.lit("Total")).alias("other"),
        N.clean_column_name(F.lit('"$a :: int"')).alias("c"),
        N.source_key(*[F.lit(x) for x in ("SQL Server", "S", "", None, "P")]).alias("s"),
        N.gateway_needed(F.lit("SQL Server"), F.lit("x.database.windows.net"), F.lit(None)).alias("g"),
        N.gateway_needed(F.lit("Other"), F.lit(None), F.lit(None)).alias("u"),
    ).collect()[0]
    assert row.n == "a" and row.k == "db..[t" and row.l == "staging/crm/base"
    assert row.same is None and row.other == "Sum" and row.c == "a "
    assert row.s == "sql server|s|p" and row.g is False and row.u is None


def test_sink_replaces_one_tenant(spark, tmp_path):
    path = str(tmp_path / "graph")
    write_graph({"nodes": spark.range(3)}, path, "a")
    write_graph({"nodes": spark.range(2)}, path, "b")
    write_graph({"nodes": spark.range(1)}, path, "a")
    got = {(r.tenant, r["count"]) for r in spark.read.parquet(f"{path}/nodes").groupBy("tenant").count().collect()}
    assert got == {("a", 1), ("b", 2)}
    with pytest.raises(ValueError):
        write_graph({"other": spark.range(1)}, path, "a")


def test_added_columns_at_any_depth(spark):
    deep = "1"
    for _ in range(8):
        deep = f"f({deep}, [x])"
    assert [g[0] for g in value(spark, T.added_columns, f'Table.AddColumn(S, "A", each {deep})')] == ["A"]
    got = value(spark, T.added_columns, 'Table.AddColumn(Table.AddColumn(S, "A", each [p]), "B", each [q], type text)')
    assert [(g[0], list(g[1])) for g in got] == [("B", ["q"]), ("A", ["p"])]
    long = 'Table.AddColumn(' + "a" * 20_000 + ', "A", each [p])'
    assert [g[0] for g in value(spark, T.added_columns, long)] == ["A"]


def test_long_texts_do_not_exhaust_the_stack(spark):
    sql = "select " + "a, " * 5_000 + "b"
    assert value(spark, T.native_queries, f'Value.NativeQuery(Sql.Database("s", "d"), "{sql}")')[0][1] == sql
    caption = 'c""' * 7_000
    assert len(value(spark, T.parameter_rows, f'{{("{caption}", NAMEOF(\'t\'[c]), 0)}}')) == 1


def test_native_queries_at_any_depth(spark):
    steps = 'Snowflake.Databases("s","w"){[Name="DB",Kind="Database"]}[Data]'
    deep = "x"
    for _ in range(12):
        deep = f"f({deep}, {{1, [a = 2]}})"
    for connection in (steps, deep, "a" * 20_000):
        assert value(spark, T.native_queries, f'Value.NativeQuery({connection}, "select \\"1\\", 2", null, [EnableFolding=true])') == [(connection, 'select \\"1\\", 2')]
    assert value(spark, T.native_queries, f'a = Value.NativeQuery ({steps}, #"P"), b = Value.NativeQuery(S, "x")') == [("S", "x")]
    assert value(spark, T.native_queries, 'Value.NativeQuery(S)') == []
