"""Connected components by alternating star contraction, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import remove, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) with a > b. Large: each node's larger neighbours move to its least
    neighbour. Small: its smaller ones and itself do.

    The least neighbour is a map-side combined minimum; hub nodes meet it in an equi-join, which
    adaptive execution may split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        moved = edges.join(least, edges["b"] == least["node"]).select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        moved = edges.join(least, edges["a"] == least["node"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where("a <> b").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for each node of the links (a, b); no row for lone nodes.

    Links may repeat, run either way or join a node to itself. Each round is a staged table, removed once
    the next one is, and compared with the last by number and sums alone. The last one stays: the result reads it.
    """
    edges, path = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, old = now, path
        edges, path = staged(_star(_star(edges, True), False))
        remove(links.sparkSession, old)
