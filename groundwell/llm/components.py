"""Connected components of an edge table, wholly distributed.

Alternates the large-star and small-star steps until the edges no longer change; every step is a
partially aggregated minimum and a join of written tables, so no neighbour list is ever gathered
in one place and a node with very many edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def component_of(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges(u, v)`` the smallest node that it reaches.

    Nodes without an edge do not appear. Self-loops and repeated edges are allowed.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.settle(edges)
    mark = _mark(edges)
    rows = mark[0]  # no step makes more rows than twice the edges
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows=2 * rows)
        large = scratch.settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), rows=rows)
        scratch.drop(least)
        least = scratch.settle(large.groupBy("u").agg(F.min("v").alias("m")), rows=rows)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.settle(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), rows=2 * rows)
        scratch.drop(least, large, edges)
        edges, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.settle(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), rows=2 * rows)
