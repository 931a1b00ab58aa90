"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import cut


def _starred(edges: DataFrame) -> bool:
    """Whether every node with an edge to a smaller one has no other edge: then the smaller ones are the roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.sum("down").alias("downs"))
    return counts.where("ups > 1 or (ups = 1 and downs > 0)").agg(F.count("*")).first()[0] == 0


def stars(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``edges`` that is not the smallest of its component, which is its root.

    Self loops and repeated or reversed edges change nothing, null ends are
    ignored, an empty table gives an empty result. Per round the stars cost two
    aggregations with map-side minima and two joins, and a hub's edges are never
    gathered; the number of rounds is logarithmic in the longest chain. Rounds end when
    only stars about smallest nodes are left, which one aggregation finds.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    now = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _starred(now):
        sym = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.where("u <> v")
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        out = small.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(out, "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest node. Edges are read as in ``stars``."""
    both = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    nodes = both.select(F.col(left).alias("node")).union(both.select(right)).distinct()
    return nodes.join(stars(edges, left, right), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
