"""Lineage of visuals, sources of tables, mapping sheets: what is read and parsed once, and the rows of small models."""

from blastradius.operators import catalog as K
from blastradius.operators.extract import table_sources
from blastradius.queries import QUERIES
from blastradius.sources.mapping_csv import mapping_scan_errors

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def parsed_in_filters(df):
    return [line for line in optimized(df) if "Filter" in line and "regexp" in line]


def test_uses_are_read_once(spark):
    plan = optimized(QUERIES["visual_lineage"](spark, SF))
    assert sum("Relation [l_orderkey" in line for line in plan) == 1


def test_sources_are_not_parsed_in_filters(spark):
    queries = spark.createDataFrame(
        [
            ("A", 1, 'let Source = Sql.Database("s", "d") in Source'),
            ("B", 2, "let Source = base in Source"),
            ("C", 3, "let Source = gone in Source"),
            ("D", 4, "1"),
            ("base", 5, "2"),
        ],
        "tbl string, ord long, m string",
    )
    shared = spark.createDataFrame([("base", 'let Source = Oracle.Database("o") in Source')], "name string, expr string")
    found = table_sources(queries, shared)
    assert not parsed_in_filters(found)
    assert sorted((r.tbl, r.source_key) for r in found.collect()) == [("A", "sql server|s|d"), ("B", "oracle|o")]


def test_lineage_of_a_small_model(spark, ws):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    formulas = df([("m1", "T1", 1, "[m2] + SUM(T2[c])"), ("m2", "P", 2, "COUNTROWS(T3)")], "name string, home string, ord long, expr string")
    uses = df(
        [
            ("v1", "measure", "T1", "m1"),
            ("v1", "measure", "T1", "m1"),
            ("v2", "column", "T2", "c"),
            ("v2", "hierarchy", "T9", None),
            ("v3", "column", "P", "P"),
            ("v3", "column", "G", "G"),
            ("v4", "measure", "P", "m2"),
        ],
        "visual string, type string, tbl string, field string",
    )
    items = df([("P", "column", "T2", "c"), ("P", "measure", "P", "m2"), ("P", None, None, None)], "param string, target_kind string, node_table string, node_name string")
    groups = df([("G", "i1"), ("G", "i2")], "tbl string, item string")
    params = df([("P",)], "tbl string")
    sources = df([("T1", "s1"), ("T2", "s2"), ("T3", "s2"), ("T3", "s3"), ("G", "s4"), ("P", "s5")], "tbl string, source_key string")
    want = {
        ("v1", "measure", "T1[m1]"), ("v1", "chained measure", "P[m2]"),
        *(("v1", "table", t) for t in ("T1", "T2", "T3")), *(("v1", "source", s) for s in ("s1", "s2", "s3")),
        ("v2", "column", "T2[c]"), ("v2", "column", None), ("v2", "table", "T2"), ("v2", "table", "T9"), ("v2", "source", "s2"),
        ("v3", "parameter item", "T2[c]"), ("v3", "parameter item", "P[m2]"), ("v3", "calculation item", "G[i1]"), ("v3", "calculation item", "G[i2]"),
        *(("v3", "table", t) for t in ("T2", "T3", "G")), *(("v3", "source", s) for s in ("s2", "s3", "s4")),
        ("v4", "measure", "P[m2]"), ("v4", "table", "T3"), ("v4", "source", "s2"), ("v4", "source", "s3"),
    }
    f = K.Formulas(ws, formulas)
    for listed in (1, K.LISTED):
        rows = [tuple(r) for r in K.visual_lineage(ws, f, uses, groups, items, params, sources, listed).select("visual", "kind", "name").collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_headings_are_not_read_in_filters(spark):
    docs = spark.createDataFrame(
        [
            ("a", "from_database, From  Schema,FROM TABLE,To Table\nd,s,t,T"),
            ("b", "\r\n \r\nFrom Table,to table\nx"),
            ("c", ""),
            ("d", None),
        ],
        "doc string, body string",
    )
    found = mapping_scan_errors(docs)
    assert not [line for line in optimized(found) if "Filter" in line and "split" in line]
    every = "From Database, From Schema, From Table, To Table"
    assert sorted((r.doc, r.missing) for r in found.collect()) == [("b", "From Database, From Schema"), ("c", every), ("d", every)]
