"""Views that are read in part or spelled last, and walks over one step."""

import os

import pytest
from pyspark.sql import functions as F

from blastradius.operators import walks as W
from blastradius.plans import estate
from blastradius.queries import QUERIES
from test_graph_rules import edges, nodes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["children", "column_ancestry", "consumed_nodes", "key_feeders", "diag_keys_unlinked", "edge_union"])
def test_edges_are_not_written_for_queries_that_filter_them(spark, name, monkeypatch):
    from blastradius.plans import registry

    registry.forget(spark)
    QUERIES[name](spark, SF)
    (c,) = (c for (_, sf), c in registry._contexts.items() if sf == SF)
    assert "edges" not in c._views
    registry.forget(spark)


def test_children_read_the_warehouse_tables_alone(spark):
    read = {os.path.basename(f) for f in QUERIES["children"](spark, SF).inputFiles()}
    assert read == {"nation.parquet", "customer.parquet", "supplier.parquet"}


def test_distinct_of_keys_gives_the_rows_of_the_sql(spark):
    line = [(1, 5, 2, 1), (1, 5, 2, 1), (2, 5, 2, 1), (None, 5, 2, 1), (None, 5, 2, 1), (1, None, 2, 2), (1, None, 3, 1), (1, 7, 2, None), (1, 14, 2, None), (9, 7, None, 3)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").createOrReplaceTempView("lineitem")
    order = [(1, 3, "A"), (4, 3, "A"), (2, 3, None), (5, 3, None), (9, None, "B"), (None, 3, "A")]
    spark.createDataFrame(order, "o_orderkey long, o_custkey long, o_orderpriority string").createOrReplaceTempView("orders")
    arms = [a for name in ("edges", "nodes") for a in estate.VIEWS[name].split("union all ") if any(a.startswith(k) for k in estate.KEYS)]
    assert len(arms) == len(estate.KEYS)
    for arm in arms:
        arm = arm.strip()
        spelled = estate.spelled_last(arm)
        assert spelled != arm
        assert sorted(map(str, spark.sql(spelled).collect())) == sorted(map(str, spark.sql(arm).collect()))


def test_each_problem_of_an_edge_is_one_row(spark, ws):
    e = edges(spark, ("a", "b", None, None), ("x", "b", None, None), ("x", "b", None, None), ("a", None, None, None), ("y", "y", None, None), ("a", "a", None, None))
    got = sorted((str(r.src), str(r.dst), r.problem) for r in W.edge_integrity(nodes(spark, a="model", b="model"), e, ws).collect())
    assert got == sorted([
        ("x", "b", "dangling source"), ("x", "b", "dangling source"), ("a", "None", "dangling target"),
        ("y", "y", "dangling source"), ("y", "y", "dangling target"), ("y", "y", "self"), ("a", "a", "self"),
    ])


@pytest.mark.parametrize(("extra", "reached", "walked"), [((), {"v"}, False), ((("p", "w", None, None),), {"v", "w"}, True)])
def test_a_page_that_leads_nowhere_needs_no_walk(spark, ws, monkeypatch, extra, reached, walked):
    given, build = [], W.trace_graph
    monkeypatch.setattr(W, "trace_graph", lambda ws, n, e, *rest: given.append(e) or build(ws, n, e, *rest))
    n = nodes(spark, p="page", v="visual", w="visual", m="measure")
    e = edges(spark, ("p", "v", None, None, "page_to_visual"), ("m", "v", None, None), *extra)
    starts = spark.createDataFrame([("p", None)], "id string, col string")
    got = W.trace(ws, n, e, spark.createDataFrame([], "id string, col string"), starts, "down").collect()
    assert {r.reached for r in got} == reached and (given[0].count() > 1) == walked


def test_sides_that_grow_are_dealt_and_not_sent_to_the_driver(spark):
    from blastradius.operators import diagnostics as D
    from blastradius.operators import impact as I
    from blastradius.plans import registry

    c = registry.context(spark, SF)
    links = c.given("edges").where("kind = 'dbt_to_pbi'")
    feeders = I.key_feeders(c.relationships, c.depends_on, links, c.cols)
    floored = spark.createDataFrame([("tab:c1", "K1", 3, "low")], "id string, col string, visuals bigint, band string")
    marks = I.has_lineage(c.cols, c.given("edges"))
    direct = I.relationship_reach(c.relationships, feeders, c.cols)
    later = direct.select("id", "col", direct.relationships.alias("relationships_downstream"))
    tables = {
        "key_feeders": feeders,
        "relationship_reach": direct,
        "band_floor": I.band_floor(floored, direct, later),
        "has_lineage": marks,
        "columns_unlinked": D.columns_unlinked(c.bi_cols, marks),
        "keys_unlinked": D.keys_unlinked(c.bi_cols, marks, I.relationship_sides(c.relationships)),
        "untested_high": D.untested_high(c.nodes, floored),
        "coverage": D.coverage(c.bi_cols, marks, floored, c.nodes),
    }
    sent = {n for n, t in tables.items() if "BroadcastHashJoin" in t._jdf.queryExecution().executedPlan().toString()}
    assert not sent
    registry.forget(spark)


def test_rounds_deal_sides_of_many_rows(spark, ws, monkeypatch):
    import random

    from blastradius.operators import closure as C

    rng = random.Random(7)
    arcs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(20)})
    steps = spark.createDataFrame(arcs, "src int, dst int")
    given, dealt = [], []
    monkeypatch.setattr(C, "dealt", lambda df: dealt.append(df) or df.hint("merge"))
    for many in (50_000, 0):
        monkeypatch.setattr(C, "MANY", many)
        given.append(sorted(tuple(r) for r in C.pairs(C.closure(ws, steps)).collect()))
        assert bool(dealt) == (many == 0)
    assert given[0] == given[1] and len(given[0]) > len(arcs)


def test_what_is_written_leaves_no_shuffle_files(spark, ws):
    import time

    from blastradius.workspace import CLEANUP

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    got = ws.save(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not shuffled() - before
    assert got.count() == 7 and spark.conf.get(CLEANUP, None) == setting


def test_a_trace_deals_its_rows_once_and_needs_no_join_for_ids(spark, ws, monkeypatch):
    n = nodes(spark, s="source", m="model", t="pbiTable", a="measure", v="visual", w="visual", p="page")
    e = edges(
        spark, ("s", "m", None, "x"), ("m", "t", "X", "k"), ("m", "t", "y", "l"), ("t", "a", None, None), ("a", "v", None, None), ("t", "v", "k", None), ("t", "w", "l", None),
        ("p", "v", None, None, "page_to_visual"), ("p", "w", None, None, "page_to_visual"),
    )
    c, starts = spark.createDataFrame([("t", "k")], "id string, col string"), n.where("kind = 'visual'").selectExpr("id", "cast(null as string) as col")
    given = []
    for many in (50_000, 0):
        monkeypatch.setattr(W, "MANY", many)
        traced = W.trace(ws, n, e, c, starts, "up")
        given.append(sorted(tuple(r) for r in traced.collect()))
    assert given[0] == given[1]
    assert ("v", None, "t", 1, 1, False) in given[0] and ("v", None, "p", 1, 0, False) in given[0] and ("v", None, "s", 3, 0, False) in given[0]
    plan = traced._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("RepartitionByExpression") + plan.count("Exchange hashpartitioning") <= 1


def test_each_diagnostic_section_is_counted_by_itself(spark, ws, monkeypatch):
    from blastradius.operators import rollup as U

    written, save = [], ws.save
    monkeypatch.setattr(ws, "save", lambda df, name, *rest: written.append(name) or save(df, name, *rest))
    got = U.diagnostic_sections(ws, {"broken_refs": spark.range(3), "ambiguous": spark.range(0)}).collect()
    assert {(r.section, r.rows) for r in got} == {("broken_refs", 3), ("ambiguous", 0)}
    assert written == ["section-broken_refs", "section-ambiguous"]
