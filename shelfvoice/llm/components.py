"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvoice.llm.common import stage
from shelfvoice.operators.joins import BROADCAST_MAX_ROWS, salted_left


def _least_of(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """Join each edge with the row of its end ``u``, which a hub has many edges of.

    ``least`` has at most two rows an edge, so the edges' number bounds it.
    """
    if 2 * rows <= BROADCAST_MAX_ROWS:
        return edges.join(F.broadcast(least), "u")
    return salted_left(edges, least, "u", F.col("v"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link every larger neighbour of a vertex to the least vertex near it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _least_of(both.filter("v > u"), least, rows).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link a vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _least_of(down, least, rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(vertex, root)`` for every vertex of ``edges(u, v)``; root is the least vertex reachable.

    Both stars aggregate before they join, so a hub is a large key of a join and
    not a list. Each round is written to the shared folder: lineage stays short
    and a lost executor repeats part of one round. Ends when a round changes no
    edge. No edges: an empty table. Null ends and loops are left out; repeated
    edges count once.
    """
    now = stage(
        edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found[0] == 0 or tuple(found) == mark:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("vertex"), F.col("v").alias("root"))
            ).distinct()
        mark = tuple(found)
        # A large star makes no edges of its own: at most one for each it got.
        now = stage(_small_star(_large_star(now, found[0]), found[0]).distinct(), "edges")
