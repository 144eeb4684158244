"""Connected components by alternating large and small stars.

Each half round is one aggregate with map-side combine and one join of two written tables, so that Spark can split a
hub's rows at run time. Every step is written to the shared folder: a lost executor repeats one step only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Links each node's larger (or smaller) neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:  # v > u goes to m
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours go to m
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    new = staged(out.filter("u > v").distinct(), "star")
    dropped(least)
    return new


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, root) for every node but the roots; root is the component's smallest node."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        wide = _star(now, large=True)
        new = _star(wide, large=False)
        dropped(wide)
        dropped(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
