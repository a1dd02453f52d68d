"""Rules of the walk, of impact and of join keys, each on a graph of a few nodes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from blastradius.operators import impact as I
from blastradius.operators import walks as W
from blastradius.operators.closure import NodeGraph, closure, pairs

NODE = "id string, kind string, name string, layer string, origin string, resource_type string, test_count int"
EDGE = "src string, dst string, sc string, tc string, kind string"


def nodes(spark, **kinds):
    return spark.createDataFrame([(i, k, i, "l", "pbi", None, 0) for i, k in kinds.items()], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, "x")[:5] if len(r) == 4 else r for r in rows], EDGE)


def columns(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, col string")


def impact_of(ws, spark, n, e, c):
    return {(r.id, r.col): r for r in I.impact(ws, n, e, c).collect()}


def test_column_is_carried_and_consumed(spark, ws):
    n = nodes(spark, s="source", m="model", t="pbiTable", a="measure", v1="visual", v2="visual", v3="visual")
    e = edges(
        spark, ("s", "m", "A", "b"), ("m", "t", "B", "c"), ("t", "a", "c", None), ("a", "v1", None, None),
        ("t", "v2", "d", None), ("t", "v3", " C ", None),
    )
    got = impact_of(ws, spark, n, e, columns(spark, ("s", "a"), ("s", "z"), ("t", "D")))
    # The name is compared without regard to case and outer blanks; v2 reads another column.
    assert (got[("s", "a")].visuals, got[("s", "a")].measures, got[("s", "a")].visuals_exact) == (2, 1, 2)
    assert got[("s", "z")].visuals == 0 and got[("s", "z")].band == "none"
    assert got[("t", "D")].visuals == 1
    # A node starts without a column but carries one from its first hop on.
    assert got[("s", None)].visuals == 2
    assert got[("t", None)].visuals == 3 and got[("t", None)].band == "medium"


def test_unnamed_edge_widens_and_stays_widened(spark, ws):
    n = nodes(spark, s="source", m="model", v1="visual", v2="visual")
    e = edges(spark, ("s", "m", None, "b"), ("m", "v1", "b", None), ("s", "v2", "a", None))
    got = impact_of(ws, spark, n, e, columns(spark, ("s", "a")))[("s", "a")]
    assert (got.visuals, got.visuals_exact) == (2, 1)


def test_exact_path_beats_a_widened_one(spark, ws):
    n = nodes(spark, s="source", m="model", v="visual")
    e = edges(spark, ("s", "m", None, "b"), ("s", "m", "a", "b"), ("m", "v", "b", None))
    got = impact_of(ws, spark, n, e, columns(spark, ("s", "a")))[("s", "a")]
    assert (got.visuals, got.visuals_exact) == (1, 1)


def test_containment_never_adds_impact(spark, ws):
    n = nodes(spark, t="pbiTable", p="page", v1="visual", v2="visual")
    e = edges(
        spark, ("t", "v1", "k", None), ("t", "p", "k", None), ("p", "v1", None, None, "page_to_visual"),
        ("p", "v2", None, None, "page_to_visual"),
    )
    got = impact_of(ws, spark, n, e, columns(spark, ("t", "k")))[("t", "k")]
    assert (got.visuals, got.pages) == (1, 1)


def test_cycle_ends_and_missing_target_is_skipped(spark, ws):
    n = nodes(spark, a="measure", b="measure", v="visual")
    e = edges(spark, ("a", "b", None, None), ("b", "a", None, None), ("b", "v", None, None), ("b", "gone", None, None))
    got = impact_of(ws, spark, n, e, columns(spark, ("zz", "c")))
    assert (got[("a", None)].measures, got[("a", None)].visuals) == (2, 1)


def brute_closure(arcs: dict, combine) -> dict:
    """(w, hop) per pair: the largest weight and the fewest hops, each by itself."""
    best = {p: (w, 1) for p, w in arcs.items()}
    changed = True
    while changed:
        changed = False
        for (a, b), (w, hop) in list(best.items()):
            for (c, d), x in arcs.items():
                if b == c:
                    old = best.get((a, d), (-1, 10**9))
                    new = (max(old[0], combine(w, x)), min(old[1], hop + 1))
                    if new != old:
                        best[(a, d)] = new
                        changed = True
    return best


@pytest.mark.parametrize("n,m,back,combine,plain", [(30, 60, 1.0, F.least, min), (30, 36, 0.0, F.greatest, max), (30, 40, 0.06, F.least, min), (16, 24, 0.1, F.greatest, max)])
def test_closure_against_brute_force(spark, ws, n, m, back, combine, plain):
    """All arcs at random, none that lead back, and a few: cycles with ways in, between and out."""
    rnd = random.Random(7)
    arcs = {}
    for _ in range(m):
        a, b = rnd.randrange(n), rnd.randrange(n)
        if rnd.random() >= back:
            a, b = min(a, b), max(a, b) + 1
        arcs[a, b] = rnd.randrange(3)
    best = brute_closure(arcs, plain)
    df = spark.createDataFrame([(a, b, w) for (a, b), w in arcs.items()], "src int, dst int, w int")
    got = [(r.origin, r.v, r.w, r.hop) for r in closure(ws, df, combine=combine).collect()]
    assert sorted(got) == sorted((*p, *x) for p, x in best.items())
    seeds = spark.createDataFrame([("s", 0), ("s", 3), ("t", 5), ("none", 99)], "origin string, v int")
    want = {}
    for (a, b), (w, hop) in best.items():
        for name, v in (("s", 0), ("s", 3), ("t", 5)):
            if v == a:
                old = want.get((name, b), (-1, 10**9))
                want[name, b] = (max(w, old[0]), min(hop, old[1]))
    got = {(r.origin, r.v): (r.w, r.hop) for r in closure(ws, df, seeds, combine=combine).collect()}
    assert got == want


def test_chain_of_forty_is_not_read_again(spark, ws):
    """Each table of pairs is written once an arc, so all that is written grows with the arcs of the pairs."""
    written = {}
    save = ws.save_counted

    def counting(df, name, by=()):
        out, rows = save(df, name, by)
        written[name] = rows
        return out, rows

    ws.save_counted = counting
    df = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    found = closure(ws, df, name="chain")
    assert {(r.origin, r.v, r.hop) for r in found.collect()} == {(a, b, b - a) for a in range(41) for b in range(a + 1, 41)}
    steps = {name: rows for name, rows in written.items() if name.startswith("chain-from-")}
    assert sorted(steps.values()) == list(range(1, 39))


def test_closure_of_no_edges(spark, ws):
    none = spark.createDataFrame([], "src int, dst int")
    assert closure(ws, none).count() == 0
    assert closure(ws, none, spark.createDataFrame([(1, 1)], "origin int, v int")).count() == 0


def test_hot_vertex_keeps_every_row(spark, ws):
    n = 3000
    into = spark.range(n).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("hub").alias("dst"))
    out = spark.range(50).select(F.lit("hub").alias("src"), F.concat(F.lit("z"), "id").alias("dst"))
    got = closure(ws, into.unionByName(out)).groupBy("origin").count().collect()
    assert {r["count"] for r in got if r.origin != "hub"} == {51} and len(got) == n + 1


KEYS = "from_table string, from_column string, to_table string, to_column string, active boolean"


def test_key_feeders_go_one_step_and_count_each_relationship_once(spark, ws):
    rel = spark.createDataFrame([("F", "k", "D", "id", True), ("D", "ID", "F", "K", True), ("F", "k", "E", "id", False)], KEYS)
    dep = spark.createDataFrame([("F", "k", "F", "a"), ("F", "a", "F", "b")], "table_id string, col string, dep_table string, dep_col string")
    links = edges(spark, ("m", "F", "x", "a", "dbt_to_pbi"), ("m", "D", "y", "id", "dbt_to_pbi"))
    cols = columns(spark, ("F", "k"), ("F", "a"), ("F", "b"), ("D", "id"), ("E", "id"), ("m", "X"), ("m", "y"))
    fed = I.key_feeders(rel, dep, links, cols)
    assert {(r.side, r.id, r.col, r.key_table) for r in fed.collect()} == {
        ("report", "F", "a", "F"), ("warehouse", "m", "X", "F"), ("warehouse", "m", "y", "D"),
    }
    got = {(r.id, r.col): (r.relationships, r.relationships_inactive) for r in I.relationship_reach(rel, fed, cols).collect()}
    assert got[("F", "k")] == (2, 1) and got[("F", "a")] == (2, 1) and got[("D", "id")] == (1, 0)
    assert got[("m", None)] == (2, 1) and ("F", "b") not in got


def test_join_reach_is_silent_where_a_key_is_held(spark, ws):
    rel = spark.createDataFrame([("F", "k", "D", "id", True)], KEYS)
    e = edges(spark, ("s", "m", "a", "x"), ("m", "F", "x", "k"), ("s", "m", "b", None))
    cols = columns(spark, ("s", "A"), ("s", "b"), ("m", "x"), ("F", "k"), ("D", "id"))
    direct = spark.createDataFrame([(i, c, 1, 0) for i, c in (("F", "k"), ("F", None), ("D", "id"), ("D", None))], "id string, col string, relationships long, relationships_inactive long")
    got = {(r.id, r.col): r.relationships_downstream for r in I.join_reach(ws, e, rel, cols, direct).collect()}
    assert got == {("s", "A"): 1, ("s", None): 1, ("m", "x"): 1, ("m", None): 1}


def test_floor_lifts_and_never_lowers(spark):
    imp = spark.createDataFrame(
        [("a", "k", 0, "none"), ("b", "k", 30, "high"), ("c", "k", 0, "none"), ("d", "k", 0, "none")],
        "id string, col string, visuals long, band string",
    )
    held = spark.createDataFrame([("a", "k", 2, 0), ("b", "k", 1, 0)], "id string, col string, relationships long, relationships_inactive long")
    later = spark.createDataFrame([("c", "k", 4, 0)], "id string, col string, relationships_downstream long, relationships_downstream_inactive long")
    got = {r.id: (r.band, r.band_raised_from, r.band_reason) for r in I.band_floor(imp, held, later).collect()}
    assert got == {
        "a": ("medium", "none", "holds 2 join keys"), "b": ("high", None, None),
        "c": ("low", "none", "feeds a join key downstream"), "d": ("none", None, None),
    }


def test_trace_of_a_measure_marks_the_columns_it_reads(spark, ws):
    n = nodes(spark, s="model", t="pbiTable", a="measure")
    e = edges(spark, ("s", "t", "x", "k"), ("s", "t", "y", "other"), ("t", "a", "K", None))
    c = columns(spark, ("t", "k"), ("s", "x"))
    start = spark.createDataFrame([("a", None)], "id string, col string")
    got = {r.reached: (r.hop, r.columns, r.inferred) for r in W.trace(ws, n, e, c, start, "up").collect()}
    assert got == {"t": (1, 1, False), "s": (2, 1, False)}


def test_walk_is_limited_in_hops(spark, ws):
    n = nodes(spark, **{x: "model" for x in "abcd"})
    g = NodeGraph(ws, n, edges(spark, *[(a, b, None, None) for a, b in itertools.pairwise("abcd")]))
    got = W.walk_hops(g, n.where("id = 'b'"), 1).collect()
    assert {(r.direction, r.reached, r.hop) for r in got} == {("down", "c", 1), ("up", "a", 1)}


def test_spread_keeps_each_pair_once_and_reads_only_arcs_that_lead_on(spark, ws):
    n = nodes(spark, a="model", b="model", c="model", t="pbiTable", v="visual", p="page")
    kinds = [("a", "b", "dbt"), ("b", "a", "dbt"), ("b", "c", "dbt"), ("c", "gone", "dbt"), ("c", "t", "link"), ("t", "v", "show"), ("p", "v", "hold")]
    g = NodeGraph(ws, n, edges(spark, *[(s, d, None, None, k) for s, d, k in kinds]))
    start = n.where("id in ('a', 'c')").select(F.xxhash64("id").alias("origin"), "id")
    start = g.numbers(start).select("origin", F.col("nid").alias("v"))
    name = {r.nid: r.id for r in g.nodes.collect()}
    origin = {r.origin: name[r.v] for r in start.collect()}
    got = sorted((origin[r.origin], name[r.v], r.kind, r.hop) for r in g.spread(start, "down", "all").collect())
    assert got == [
        ("a", "a", "model", 2), ("a", "b", "model", 1), ("a", "c", "model", 2), ("a", "t", "pbiTable", 3), ("a", "v", "visual", 4),
        ("c", "t", "pbiTable", 1), ("c", "v", "visual", 2),
    ]
    assert g.steps("down", {"pbiTable"}).count() == 1 and g.steps("up", {"visual"}).count() == 2
    assert g.spread(start.limit(0), "down", "none").count() == 0


def test_trace_goes_round_a_cycle_and_keeps_the_best_of_two_ways(spark, ws):
    n = nodes(spark, s="source", m="model", t="pbiTable", a="measure")
    # t is met early over an edge that names no column, later by name; m and t lead back to each other.
    e = edges(spark, ("s", "t", None, "k"), ("s", "m", "x", "y"), ("m", "t", "y", "k"), ("t", "m", "k", "y"), ("t", "a", "K", None), ("gone", "a", None, None))
    c = columns(spark, ("s", "x"), ("m", "y"), ("t", "k"))
    start = spark.createDataFrame([("s", "x")], "id string, col string")
    graph = W.trace_graph(ws, n, e, c, "down")
    got = {r.reached: (r.hop, r.columns, r.inferred) for r in W.trace(ws, n, e, c, start, "down", graph).collect()}
    assert got == {"t": (1, 1, False), "m": (1, 1, False), "a": (2, 0, False)}
    picked = graph.nodes.where("id = 's'").select(F.lit(0).alias("origin"), "nid", F.lit("x").alias("col"), "kind")
    assert graph.spread(picked, "rounds").groupBy("v", "w").count().where("count > 1").count() == 0
