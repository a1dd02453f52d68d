"""Mapping rows, relation matching and links."""

import pytest

from blastradius.operators import match as M

REL = "ord long, id string, kind string, name string, db string, sch string, relation string"
MAP = "row_no long, from_database string, from_schema string, from_table string, from_column string, to_table string, to_column string"
PHYS = "ord long, db string, sch string, tbl string, col string, model_table string, model_column string"


def boundary(spark, mapping=(), physical=(), relations=((1, "m1", "model", "orders", "DB", "raw", None),), cols=("id", "Amount", "k")):
    index = M.relation_index(spark.createDataFrame(list(relations), REL))
    rel_cols = spark.createDataFrame([(r[1], c) for r in relations for c in cols], "id string, col string")
    tables = spark.createDataFrame([("Sales", True), ("Typed", False)], "tbl string, has_source boolean")
    model_cols = spark.createDataFrame([("Sales", c) for c in ("ID", "amount", "Label")], "tbl string, col string")
    return M.Boundary(
        spark.createDataFrame(list(mapping), MAP), spark.createDataFrame(list(physical), PHYS), index, rel_cols, tables, model_cols
    )


def links(b):
    return {(r.source_column, r.target_column, r.provenance) for r in b.cross_links().collect()}


AUTO = [(1, "db", "RAW", "Orders", "ID", "sales", "id"), (2, "db", "raw", "orders", "amount", "Sales", "AMOUNT")]


def test_automatic_match_keeps_declared_spelling(spark):
    assert links(boundary(spark, physical=AUTO)) == {("id", "ID", "derived"), ("Amount", "amount", "derived")}


def test_column_row_leaves_the_other_columns_to_automatic_matching(spark):
    b = boundary(spark, [(2, "DB", "raw", "orders", "k", "Sales", "amount")], AUTO)
    assert links(b) == {("id", "ID", "derived"), ("k", "amount", "declared")}


def test_table_row_claims_the_table(spark):
    b = boundary(spark, [(2, "DB", "raw", "orders", "", "SALES", "")], AUTO)
    assert links(b) == {("id", "ID", "declared"), ("Amount", "amount", "declared")}


def test_a_row_with_a_wrong_column_still_closes_its_target(spark):
    b = boundary(spark, [(2, "DB", "raw", "orders", "nope", "Sales", "amount")], AUTO)
    assert links(b) == {("id", "ID", "derived")}
    assert [r.reason for r in b.unresolved_rows().collect()] == ["column not found on one side (nope -> amount)"]


def test_several_declared_sources_are_kept(spark):
    b = boundary(spark, [(2, "DB", "raw", "orders", "id", "Sales", "Label"), (3, "DB", "raw", "orders", "k", "Sales", "label")])
    assert links(b) == {("id", "Label", "declared"), ("k", "Label", "declared")}


@pytest.mark.parametrize(
    "db,sch,tbl,level,found,ambiguous",
    [
        ('"DB"', "[raw]", "`T`", "database.schema.table", "a", True),
        (None, "raw", "t", "schema.table", "a", True),
        ("XX", "raw", "t", "schema.table", "a", True),
        ("DB", "", "t", "table", "a", True),
        (None, "other", "t", "table", "a", True),
        (None, None, "alone", "table", "c", False),
        ("DB", "raw", "zz", None, None, None),
        ("DB", "raw", "", None, None, None),
    ],
)
def test_degrading_match(spark, db, sch, tbl, level, found, ambiguous):
    rel = [(1, "a", "model", "t", "DB", "raw", None), (2, "b", "source", "t", "db", "RAW", "db.raw.T"), (3, "c", "model", "alone", "q", "r", "")]
    index = M.relation_index(spark.createDataFrame(rel, REL))
    req = spark.createDataFrame([(db, sch, tbl)], "db string, sch string, tbl string")
    r = M.resolve_relation(req, index).collect()[0]
    assert (r.match_level, r.id, r.ambiguous) == (level, found, ambiguous)


def test_mapping_defects(spark):
    rows = [
        (2, "", "s", "t", "", "T", ""), (3, "d", "s", "t", "c", "T", ""), (4, "d", "s", "t", "c", "T", "x"),
        (5, "D", '"s"', "t", "C", "t", "X"), (6, "d", "s", "t", "", "T", ""),
    ]
    m = spark.createDataFrame(rows, MAP)
    assert {r.row_no: r.message for r in M.mapping_errors(m).collect()} == {
        2: "missing From Database",
        3: "From Column and To Column must both be filled (column-level row) or both blank (table-level row)",
    }
    assert [(r.row_no, r.message) for r in M.mapping_warnings(m).collect()] == [(5, "duplicate of row 4 — ignored")]
    assert {(r.row_no, r.level) for r in M.mapping_rows(m).collect()} == {(4, "column"), (6, "table")}
