"""Walks over the node graph: neighbourhoods, ancestry, traces, subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blastradius.functions.norm import lineage_name, lineage_rank, norm
from blastradius.operators.closure import (
    CONTAINMENT,
    MANY,
    NodeGraph,
    StateGraph,
    closure,
    column_name,
    pairs,
    union_all,
)
from blastradius.workspace import Workspace, dealt


def reach_set(ws: Workspace, steps: DataFrame, start: DataFrame, name: str, written: bool = False) -> DataFrame:
    """v: the start vertices and everything reached from them over ``steps``."""
    first = start.select("v").distinct()
    seeds = first.select(F.lit(0).alias("origin"), "v")
    beyond = closure(ws, steps, seeds, name=name, written=written).select("v")
    return first.unionByName(beyond).distinct()


def consumed_nodes(ws: Workspace, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Warehouse nodes a report stands on: the linked ones and all they are built from."""
    upstream = edges.where(F.col("kind") == "dbt").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return reach_set(ws, upstream, links.select(F.col("src").alias("v")), "consumed").withColumnRenamed("v", "id")


def linked_only(graph: NodeGraph, links: DataFrame) -> DataFrame:
    """Nodes on a path that crosses from the warehouse into the report."""
    sides = []
    for direction, end in (("up", "src"), ("down", "dst")):
        start = graph.numbers(links.select(F.col(end).alias("id")).distinct()).select(F.col("nid").alias("v"))
        sides.append(start.unionByName(graph.spread(start, direction, f"linked-{direction}").select("v")))
    both = sides[0].unionByName(sides[1]).distinct().withColumnRenamed("v", "nid")
    return graph.nodes.join(both, "nid", "left_semi").select("id")


def downstream_of(graph: NodeGraph, starts: DataFrame, kind: str) -> DataFrame:
    """id: nodes of a kind reached from any start (id), each once."""
    start = graph.numbers(starts.select("id").distinct()).select(F.col("nid").alias("v"))
    reached = start.unionByName(graph.spread(start, "down", "downstream").select("v")).withColumnRenamed("v", "nid")
    return graph.nodes.where(F.col("kind") == kind).join(reached, "nid", "left_semi").select("id")


def walk_hops(graph: NodeGraph, starts: DataFrame, hops: int) -> DataFrame:
    """id, direction, reached, hop: neighbours within ``hops``, the start excluded."""
    numbered = graph.numbers(starts.select("id"))
    seeds = numbered.select(F.col("nid").alias("origin"), F.col("nid").alias("v"))
    out = []
    for direction in ("down", "up"):
        found = graph.spread(seeds, direction, f"hops-{direction}", hops)
        out.append(found.where(F.col("origin") != F.col("v")).select("origin", "v", "hop", F.lit(direction).alias("direction")))
    reached = graph.nodes.select(F.col("id").alias("reached"), F.col("nid").alias("v"))
    return (
        union_all(out)
        .join(numbered.select("id", F.col("nid").alias("origin")), "origin")
        .join(reached, "v")
        .select("id", "direction", "reached", "hop")
    )


def expand_preview(hops: DataFrame, shown: DataFrame) -> DataFrame:
    """Per start and direction: neighbours an expansion would add to those shown."""
    return (
        hops.join(shown.select(F.col("id").alias("reached")), "reached", "left_anti")
        .groupBy("id", "direction")
        .agg(F.count(F.lit(1)).alias("added"))
    )


def _upstream_counts(graph: NodeGraph, seeds: DataFrame, name: str, **kinds: str) -> DataFrame:
    """origin and a count per named kind of the distinct nodes upstream of the seeds (origin, v)."""
    up = graph.spread(seeds, "up", name).where((F.col("origin") != F.col("v")) & F.col("kind").isin(*kinds.values()))
    return up.groupBy("origin").agg(*[F.count_if(F.col("kind") == kind).alias(label) for label, kind in kinds.items()])


def upstream_depth(graph: NodeGraph) -> DataFrame:
    """Per measure and table: how many models and sources lie upstream.

    Asked of the nodes a field belongs to.  A visual would walk up into its page
    and from there into everything else on the page; see ``page_summary``.
    """
    owners = graph.nodes.where(F.col("kind").isin("measure", "pbiTable")).select("id", F.col("nid").alias("origin"))
    counts = _upstream_counts(
        graph, owners.select("origin", F.col("origin").alias("v")), "depth", models="model", sources="source"
    )
    return owners.join(counts, "origin", "left").drop("origin").na.fill(0, ["models", "sources"])


def page_summary(graph: NodeGraph, edges: DataFrame) -> DataFrame:
    """Per page: its visuals and what all of them together stand on."""
    number = graph.nodes.select("id", "nid")
    on_page = graph.ws.save(
        edges.where(F.col("kind") == CONTAINMENT)
        .join(number.select(F.col("id").alias("src"), F.col("nid").alias("origin")), "src")
        .join(number.select(F.col("id").alias("dst"), F.col("nid").alias("v")), "dst")
        .select("origin", "v")
        .distinct(),
        "on-page",
    )
    visuals = on_page.groupBy("origin").agg(F.count(F.lit(1)).alias("visuals"))
    counts = _upstream_counts(graph, on_page, "page", models="model", tables="pbiTable", measures="measure")
    return (
        graph.nodes.where(F.col("kind") == "page")
        .select("id", F.col("nid").alias("origin"))
        .join(visuals, "origin", "left")
        .join(counts, "origin", "left")
        .drop("origin")
        .na.fill(0)
    )


def trace_graph(ws: Workspace, nodes: DataFrame, edges: DataFrame, columns: DataFrame, direction: str) -> StateGraph:
    """The graph that traces of one direction walk; it serves any number of them."""
    return StateGraph(ws, nodes, edges, columns, consuming=("measure", "visual", "page"), up=direction == "up", ids=True)


def trace(
    ws: Workspace,
    nodes: DataFrame,
    edges: DataFrame,
    columns: DataFrame,
    starts: DataFrame,
    direction: str,
    graph: StateGraph | None = None,
) -> DataFrame:
    """What lies on the paths of a selected node or column, one direction.

    ``starts``: id, col (null for the node).  Result: id, col, reached, hop,
    columns (how many columns of the reached node the path names), inferred
    (reached only over edges that name no column).  A page holds its visuals:
    that edge ends a walk; downwards it is taken from the selected page only.
    ``graph`` is the ``trace_graph`` of the same direction, where there is one.
    """
    if graph is None:
        near = F.col("dst" if direction == "up" else "src").alias("id")
        onward = edges.where(F.coalesce("kind", F.lit("")) != CONTAINMENT).select(near)
        led_on = onward.join(starts.select("id").distinct(), "id", "left_semi").limit(1).count()
        # Starts that only hold visuals need no graph to walk on.
        graph = trace_graph(ws, nodes, edges if led_on else edges.where(F.col("kind") == CONTAINMENT), columns, direction)
    picked = starts.select("id", "col", column_name(F.col("col")).alias("low")).distinct()
    at_column = (
        picked.where(F.col("low").isNotNull())
        .join(graph.nodes.select("id", "nid", "kind"), "id")
        .join(graph.named.withColumnRenamed("col", "low"), ["nid", "low"])
        .select("id", "col", F.col("vid").alias("origin"), "nid", "low", "kind")
    )
    at_node = (
        picked.where(F.col("low").isNull())
        .join(graph.nodes.select("id", "nid", "kind"), "id")
        .select("id", "col", F.col("nid").alias("origin"), "nid", "low", "kind")
    )
    tracked = nodes.select("id").join(columns.select("id").distinct().withColumn("cols", F.lit(True)), "id", "left")
    picks, picked = ws.save_counted(at_column.unionByName(at_node).join(tracked, "id"), "picks")
    found = graph.spread(picks.select("origin", "nid", F.col("low").alias("col"), "kind"), f"trace-{direction}")
    held = edges.where(F.col("kind") == CONTAINMENT).select("src", "dst").distinct()
    number = graph.nodes.select("id", "nid", "kind")
    inside = ws.save(
        held.join(number.select(F.col("id").alias("src"), F.col("nid").alias("page")), "src")
        .join(number.select(F.col("id").alias("dst"), F.col("nid").alias("visual"), "kind"), "dst")
        .select(F.col("src").alias("page_id"), "page", F.col("dst").alias("visual_id"), "visual", "kind"),
        "inside",
    )
    if direction == "down":
        ends = picks.join(inside.drop("kind"), picks["origin"] == inside["page"]).select(
            "origin", F.col("visual_id").alias("id"), F.lit(1).alias("hop")
        )
    else:
        on_pages = {r.kind for r in inside.select("kind").distinct().collect()}  # kinds only
        at = found.where(F.col("kind").isin(*sorted(on_pages)) if on_pages else F.lit(False)).select("origin", "id", "hop")
        at = at.unionByName(picks.where(F.col("low").isNull()).select("origin", "id", F.lit(0).alias("hop")))
        ends = at.join(inside.select(F.col("visual_id").alias("id"), "page_id"), "id").select(
            "origin", F.col("page_id").alias("id"), (F.col("hop") + 1).alias("hop")
        )
    rows = found.select("origin", "id", "col", "w", "hop").unionByName(
        ends.select("origin", "id", F.lit(None).cast("string").alias("col"), F.lit(1).cast("tinyint").alias("w"), "hop")
    )
    # Dealt by many origins, for the join with the picks too; few origins may reach very much each.  A walk comes to a
    # position with a column kept at most once, so columns are counted as they come.
    many = picked > MANY
    own = picks.select("origin", "id", "col", "cols")
    return (
        rows.repartition(*["origin"] if many else ["origin", "id"])
        .groupBy("origin", F.col("id").alias("reached"))
        .agg(
            F.min("hop").alias("hop"),
            F.max("w").alias("w"),
            F.count_if(F.col("col").isNotNull() & (F.col("w") == 1)).alias("columns"),
        )
        .join(dealt(own) if many else own, "origin")
        .select(
            "id",
            "col",
            "reached",
            "hop",
            F.when(F.col("col").isNotNull() | F.col("cols").isNull(), F.col("columns")).otherwise(0).alias("columns"),
            ((F.col("col").isNotNull() | F.col("cols").isNull()) & (F.col("w") == 0)).alias("inferred"),
        )
    )


def hits_by_page(traced: DataFrame, edges: DataFrame) -> DataFrame:
    """Per start and page: visuals of that page on the traced path."""
    held = edges.where(F.col("kind") == CONTAINMENT).select(F.col("src").alias("page"), F.col("dst").alias("reached")).distinct()
    return traced.join(held, "reached").groupBy("id", "col", "page").agg(F.count(F.lit(1)).alias("visuals"))


def column_ancestry(ws: Workspace, edges: DataFrame) -> DataFrame:
    """id, col, ancestor, ancestor_col, hop, via_id, via_col.

    ``via`` is the parent pointer of the nested form: the smallest column one hop
    nearer through which the ancestor is reached.
    """
    named = edges.where((F.col("kind") == "dbt") & column_name(F.col("sc")).isNotNull() & column_name(F.col("tc")).isNotNull())
    steps = ws.save(
        named.select(
            F.struct(norm(F.col("dst")).alias("id"), norm(F.col("tc")).alias("col")).alias("src"),
            F.struct(norm(F.col("src")).alias("id"), norm(F.col("sc")).alias("col")).alias("dst"),
        ).distinct(),
        "ancestry-steps",
    )
    found = pairs(closure(ws, steps, name="ancestry", written=True))
    nearer = found.select("origin", F.col("v").alias("src"), "hop").unionByName(
        steps.select(F.col("src").alias("origin"), "src", F.lit(0).alias("hop")).distinct()
    )
    via = (
        nearer.join(steps, "src")
        .groupBy("origin", F.col("dst").alias("v"), (F.col("hop") + 1).alias("hop"))
        .agg(F.min("src").alias("via"))
    )
    return found.join(via, ["origin", "v", "hop"]).select(
        F.col("origin.id").alias("id"),
        F.col("origin.col").alias("col"),
        F.col("v.id").alias("ancestor"),
        F.col("v.col").alias("ancestor_col"),
        "hop",
        F.col("via.id").alias("via_id"),
        F.col("via.col").alias("via_col"),
    )


def path_lineage_type(ws: Workspace, typed_edges: DataFrame) -> DataFrame:
    """Strongest change between every related pair of columns, over any path."""
    steps = typed_edges.select(
        F.struct(F.col("src").alias("id"), norm(F.col("sc")).alias("col")).alias("src"),
        F.struct(F.col("dst").alias("id"), norm(F.col("tc")).alias("col")).alias("dst"),
        lineage_rank(F.col("lineage_type")).alias("w"),
    )
    found = pairs(closure(ws, steps, combine=F.greatest, name="lineage-type"))
    return found.select(
        F.col("origin.id").alias("src"),
        F.col("origin.col").alias("sc"),
        F.col("v.id").alias("dst"),
        F.col("v.col").alias("tc"),
        lineage_name(F.col("w")).alias("lineage_type"),
    )


# What a card offers to reveal one hop away, and in which direction.
REVEALS = (
    ("pbiTable", "page", "out"),
    ("pbiTable", "measure", "out"),
    ("pbiTable", "pbiTable", "out"),
    ("page", "visual", "out"),
    ("page", "measure", "in"),
)


def reveal_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, direction, neighbours: distinct one-hop neighbours a card can reveal."""
    ends = edges.select("src", "dst").join(nodes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src")
    ends = ends.join(nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    offers = []
    for card, kind, direction in REVEALS:
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        row = F.struct(F.col(near).alias("id"), F.col(far).alias("other"), F.lit(kind).alias("kind"), F.lit(direction).alias("direction"))
        offers.append(F.when((F.col(f"{near}_kind") == card) & (F.col(f"{far}_kind") == kind), row))
    return (
        ends.select(F.inline(F.array_compact(F.array(*offers))))
        .distinct()
        .groupBy("id", "kind", "direction")
        .agg(F.count(F.lit(1)).alias("neighbours"))
    )


def layer_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many edges run from one layer into another."""
    layer = nodes.where(F.coalesce("layer", F.lit("")) != "").select("id", "layer")
    return (
        edges.join(layer.select(F.col("id").alias("src"), F.col("layer").alias("src_layer")), "src")
        .join(layer.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer")), "dst")
        .where(F.col("src_layer") != F.col("dst_layer"))
        .groupBy("src_layer", "dst_layer")
        .agg(F.count(F.lit(1)).alias("edges"))
    )


def node_filter(nodes: DataFrame, kinds: list[str], resources: list[str], layers: list[str]) -> DataFrame:
    """Nodes shown under the filters; the layer filter binds models only."""
    resource = F.when(F.col("kind") == "unknown", "unknown").otherwise(F.coalesce("resource_type", F.lit("model")))
    warehouse = resource.isin(*resources) & ((resource != "model") | F.col("layer").isin(*layers))
    return nodes.where(F.col("kind").isin(*kinds) & ((F.col("origin") == "pbi") | warehouse))


# --- The merged graph -------------------------------------------------------------


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that only edges name, as nodes of kind unknown."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select(
        "id",
        F.lit("unknown").alias("kind"),
        F.substring_index("id", ".", -1).alias("name"),
        F.lit("unknown").alias("layer"),
    )


def graph_union(warehouse: DataFrame, report: DataFrame) -> DataFrame:
    """Nodes of both sides; a report node replaces a warehouse node of the same id."""
    return warehouse.join(report.select("id"), "id", "left_anti").unionByName(report)


def edge_union(warehouse: DataFrame, report: DataFrame) -> DataFrame:
    """Edges of both sides one after the other; an edge that both name stands twice."""
    return warehouse.unionByName(report)


def edge_integrity(nodes: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """Edges with an end that does not exist, and edges from a node to itself.

    The ids that no node has are found first, so that the edges need not be shuffled for each of their ends.
    """
    missing = ws.save(stub_nodes(nodes, edges).select("id"), "missing-ids").where(F.col("id").isNotNull())
    no_src = missing.select(F.col("id").alias("src"), F.lit(True).alias("no_src"))
    no_dst = missing.select(F.col("id").alias("dst"), F.lit(True).alias("no_dst"))
    problems = F.array(
        F.when(F.col("src").isNull() | F.col("no_src"), "dangling source"),
        F.when(F.col("dst").isNull() | F.col("no_dst"), "dangling target"),
        F.when(F.col("src") == F.col("dst"), "self"),
    )
    found = edges.join(no_src, "src", "left").join(no_dst, "dst", "left")
    return found.select("src", "dst", "kind", F.explode(F.array_compact(problems)).alias("problem"))


# Column-level reads by filters and joins carry a target column with a reserved prefix, which the caller names: real
# columns may begin with anything.
def structural_edges(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.where(F.startswith("tc", F.lit(prefix)))


def column_edges(edges: DataFrame, prefix: str) -> DataFrame:
    return edges.where(~F.coalesce(F.startswith("tc", F.lit(prefix)), F.lit(False)))
