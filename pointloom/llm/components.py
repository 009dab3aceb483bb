"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang the neighbours of every node on its smallest neighbour.

    The minimum per node is a partially aggregated groupBy, so that a node with very many
    neighbours sends one row per task; the join back is left to adaptive skew handling.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is the smallest node reachable.

    Nodes that have no edge are absent. Rounds are logarithmic in the longest path; each
    round's edges are written to the shared checkpoint folder in place of those before. Null endpoints are ignored.
    """
    cur = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    cur = cut_lineage(cur)
    mark = None
    for _ in range(max_rounds):
        before, cur = cur, cut_lineage(_star(_star(cur, large=True), large=False))
        drop_checkpoint(before)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
