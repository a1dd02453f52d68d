"""Exact copies by content sort.

Sampled splitters cut the order of the normalised texts into ranges of like
weight, one task sorts each range (Spark's sort spills to disk), equal texts then
stand side by side, and each row is compared in full with the row before it.  The
sort key ends with the document's id, so a text that fills many ranges is split
like any other; a table of one row a range joins the pieces again.

Only DataFrame operations.  Whole texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blastradius.llm.common import LAST_ID, cut_points, drawn, partitions, position, whole, workspace

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Code points of a text that stand in front in the sort key; a hash of the whole text follows.
PREFIX = 24


def normal(text: Column | str) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(whole(text), WHITE_SPACE, " ")


def _key(text: Column) -> Column:
    return F.concat(F.substring(text, 1, PREFIX), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def _sorted(docs: DataFrame, id_col: str, text_col: str, carried: Column) -> DataFrame:
    """Rows dealt by content: range ``_b``, equal texts as ``_run`` in it, first of their run or not.

    ``_edge`` holds the text of the first and the last row of a range only.
    """
    n = partitions(docs.sparkSession)
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    keyed = lambda df: df.withColumn("_n", normal(text_col)).select(_key(F.col("_n")).alias("k"), own.alias("i"), F.length("_n").alias("w"))
    sample = keyed(drawn(docs.select(id_col, text_col), n)).collect()
    mean = sum(r.w for r in sample) / max(1, len(sample))
    points = cut_points([(r.k, r.i) for r in sample], [r.w + mean + 1 for r in sample], n)
    at_most = lambda p: (p["k"] < F.col("_k")) | ((p["k"] == F.col("_k")) & (p["i"] <= F.col("_i")))
    dealt = (
        docs.select(normal(text_col).alias("_n"), own.alias("_i"), carried.alias("_row"))
        .withColumn("_k", _key(F.col("_n")))
        .withColumn("_b", position([F.struct(F.lit(k).alias("k"), F.lit(i).cast("long").alias("i")) for k, i in points], at_most))
        .repartitionById(n, F.col("_b"))
    )
    w = Window.partitionBy("_b").orderBy("_k", "_n", "_i")
    before, after = F.lag("_n").over(w), F.lead("_n").over(w)
    return (
        dealt.withColumn("_before", before)
        .withColumn("_after", after)
        .withColumn("_new", F.coalesce(F.col("_before") != F.col("_n"), F.lit(True)))
        .withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_first", F.col("_before").isNull())
        .withColumn("_last", F.col("_after").isNull())
        .withColumn("_edge", F.when(F.col("_first") | F.col("_last"), F.col("_n")))
        .drop("_before", "_after", "_k")
    )


def _borders(edges: DataFrame) -> DataFrame:
    """(_b, _cont, _owner, _lone): does the range begin inside the run that ended the one before, and in which range did its last run begin.

    ``edges``: (_b, _run, _first, _last, _edge).  One row a range; neighbours meet
    by range number, so no task sees all texts, only flags are ordered as a whole.
    """
    heads = edges.filter("_first").select("_b", F.col("_edge").alias("_head"))
    tails = edges.filter("_last").select("_b", F.col("_edge").alias("_tail"), F.col("_run").alias("_runs"))
    before = tails.select((F.col("_b") + 1).alias("_b"), F.col("_tail").alias("_before"))
    flags = (
        heads.join(tails, "_b")
        .join(before, "_b", "left")
        .select("_b", F.coalesce(F.col("_before") == F.col("_head"), F.lit(False)).alias("_cont"), (F.col("_runs") == 1).alias("_lone"), "_runs")
    )
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return flags.withColumn("_owner", F.max(F.when(~(F.col("_lone") & F.col("_cont")), F.col("_b"))).over(upto))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical with each run of white space as one
    space.  The row with the smallest id stays; of repeated rows one does.  Null
    text is empty text; a null id counts as the largest.  An empty table gives
    no rows.  Columns beside the two named are not read.
    """
    ws = workspace(docs.sparkSession)
    run = Window.partitionBy("_b", "_run")
    rows = ws.save(
        _sorted(docs, id_col, text_col, F.col(id_col).cast("long"))
        .withColumn("text_sha256", F.sha2("_n", 256))
        .drop("_n")
        .withColumn("_size", F.count(F.lit(1)).over(run))
        .withColumn("_head", F.min("_i").over(run))
        .select(F.col("_row").alias("doc_id"), "_b", "_run", "_new", "_first", "_last", "_edge", "_size", "_head", "text_sha256"),
        "content-sorted",
    )
    edges = rows.filter("_edge is not null").select("_b", "_run", "_first", "_last", "_edge")
    borders = ws.save(_borders(edges), "borders")
    # Runs that touch a border: the first of a range that goes on from the one before, and the last of a range.
    before = borders.select((F.col("_b") + 1).alias("_b"), F.col("_owner").alias("_chain"))
    goes_on = borders.filter("_cont").join(before, "_b").select("_b", F.lit(1).cast("long").alias("_run"), "_chain")
    ends = borders.filter("not (_lone and _cont)").select("_b", F.col("_runs").alias("_run"), F.col("_b").alias("_chain"))
    touching = goes_on.unionByName(ends)
    runs = rows.filter("_new").select("_b", "_run", "_size", "_head").join(touching, ["_b", "_run"])
    chains = runs.groupBy("_chain").agg(F.sum("_size").alias("_all"), F.min("_head").alias("_least"))
    found = touching.join(chains, "_chain").select("_b", "_run", "_all", "_least", (F.col("_chain") != F.col("_b")).alias("_later"))
    least = F.coalesce("_least", "_head")
    return rows.join(found, ["_b", "_run"], "left").select(
        "doc_id",
        F.when(least != LAST_ID, least).alias("keep_id"),
        F.coalesce("_all", "_size").alias("group_size"),
        (F.col("_new") & ~F.coalesce("_later", F.lit(False))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the rules of ``copies``."""
    ws = workspace(docs.sparkSession)
    marked = _sorted(docs, id_col, text_col, F.struct("*")).drop("_n", "_i")
    kept = ws.save(marked.filter("_new or _last"), "first-of-run")
    borders = _borders(kept.filter("_edge is not null").select("_b", "_run", "_first", "_last", "_edge"))
    later = borders.filter("_cont").select("_b", F.lit(1).cast("long").alias("_run"), F.lit(True).alias("_later"))
    # One row a range at most, so it is broadcast and the rows with their texts stay where they are.
    return kept.filter("_new").join(F.broadcast(later), ["_b", "_run"], "left").filter("_later is null").select("_row.*")
