"""Connected components of an edge table, all in DataFrame operations.

Alternates the large-star and small-star steps of Kiveris et al. (2014):
every step joins each edge with the least neighbour of one of its ends. The
least comes from a partial aggregation and is one row a node, so a hub's edges
stream past it, are never held, and adaptive execution deals them out to
several tasks where they are many. The rounds grow with the logarithm of a
component's diameter, not with the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _stars(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u").select("u", "v", "m")


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has an edge; component is the least node reachable.

    Loops, repeated edges and nulls are ignored. No edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b))).distinct()
    e = staged(e, "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: each greater neighbour goes to the least
        large = _stars(both, least).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _stars(large, least).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        nxt = staged(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "edges")
        new = _mark(nxt)
        dropped(e)
        e = nxt
        if new == mark:
            break
        mark = new
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
