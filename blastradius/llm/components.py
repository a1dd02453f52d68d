"""Connected components of an edge table, by alternating stars.

Every node gets the smallest node of its component.  A large star points the larger
neighbours of a node to its smallest one, a small star the smaller ones; both are a
minimum a node, combined before the shuffle, and a join that Spark splits where a
node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blastradius.llm.common import Tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b), a > b, distinct."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    found = both.join(least, "a")
    if large:
        out = found.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, ws: Tables) -> DataFrame:
    """(node, component) of every node with an edge; ``edges``: two long columns a, b in any order."""
    now = ws.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        before, now = now, ws.save(_star(_star(now, True), False), "stars")
        ws.release(before)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
