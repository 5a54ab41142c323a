"""Connected components by alternating large-star and small-star.

Each half step is a group-by for the least neighbour and a join back, both of which split hot nodes;
each full step is written to the shared folder.  It ends when a step changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node in its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them.  Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node and its component's least node, for the nodes of ``pairs`` (u, v) that aren't the least themselves."""
    edges = pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = common.keep(edges, "edges"), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
        new = common.keep(small_star(large_star(edges)), "edges")
        common.forget(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
