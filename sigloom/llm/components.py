"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a map-side combined minimum per node followed by a join on the
node, so a hub's edges are never gathered in one task. Links stay on the
executors; the driver sees only a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node moves to the node's least neighbour.
    Small: the node and its smaller neighbours move there."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, the component being its smallest node.

    Nodes without an edge to another node do not appear. Null ends, loops and
    repeated edges are ignored; an empty table gives an empty table.
    """
    cur = ws.table(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    last = None
    while True:
        mark = tuple(cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(20,0)"))).first())
        if mark == last or mark[0] == 0:
            break
        last = mark
        new = ws.table(_star(_star(cur, True), False))
        ws.drop(cur, sweep=False)
        cur = new
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
