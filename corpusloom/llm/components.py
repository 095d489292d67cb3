"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.runtime import settle


def _only_stars(e: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then each smaller end is its component's least node."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; a component is named by its smallest node.

    Each step connects the neighbours of a node to their smallest one; a hot node's minimum is taken with map-side
    aggregation and its edges are joined back with a join that Spark can split. Steps are written to the shared
    folder, so a lost executor costs one step at most. Ends when only stars are left, which costs one small aggregation
    to see and no further step; edges that are stars from the start take no step."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = settle(e, "edges")
    while not _only_stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = settle(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    # stars remain: every edge leads to the smallest node
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
