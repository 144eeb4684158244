"""Comment trees as (tree, idx, parent_idx, time) rows; a root's parent is -1.

Paths are made by pointer doubling: every round joins each unfinished row with the row that its path has reached so
far, so trees of depth d take log2(d) joins on (tree, idx), whatever their number. A step is the node's place among its
siblings, in a few characters that sort as numbers do; a node's path begins with its ancestors' paths. There is no
limit on rows or depth. Every round is written to the shared folder. ``preorder`` sorts within a tree only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dropped, staged


def paths(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, idx, parent_idx, depth, path), children ascending by (time, idx); unreachable nodes, orphans and rings, are dropped."""
    place = F.hex(F.row_number().over(Window.partitionBy(tree, "parent_idx").orderBy("time", "idx")))
    step = F.concat(F.char(64 + F.length(place)), place)
    own = nodes.select(F.col(tree).alias("tree"), "idx", "parent_idx", F.col("parent_idx").alias("up"), F.lit(0).alias("depth"), step.alias("path"))
    now = staged(own, "tree-paths")
    before, left = None, _open(now)
    while left[0] and left != before:  # when nobody gets home or is lost any more, only rings are left
        reached = now.select("tree", F.col("idx").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("head"))
        moved = now.filter("up <> -1").join(reached, ["tree", "up"])
        moved = moved.select("tree", "idx", "parent_idx", F.col("next").alias("up"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.concat("head", "path").alias("path"))
        new = staged(now.filter("up = -1").unionByName(moved), "tree-paths")
        dropped(now)
        now, before, left = new, left, _open(new)
    return now.filter("up = -1").drop("up").withColumnRenamed("tree", tree)


def _open(rows: DataFrame) -> tuple[int, int]:
    return tuple(rows.agg(F.count(F.when(F.col("up") != -1, 1)), F.count("*")).first())


def preorder(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """Depth-first order, children ascending by (time, idx): adds ``rank`` from 0 within each tree."""
    w = Window.partitionBy(tree).orderBy("path")
    return paths(nodes, tree).withColumn("rank", F.row_number().over(w) - 1)


def above(walked: DataFrame, point: DataFrame, tree: str = "tree", inclusive: bool = False) -> DataFrame:
    """Nodes before each tree's point (tree, idx) in depth-first order."""
    at = walked.join(point.select(tree, F.col("idx").alias("_i")), tree).filter("idx = _i").select(tree, F.col("rank").alias("_r"))
    return walked.join(at, tree).filter(F.col("rank") <= F.col("_r") if inclusive else F.col("rank") < F.col("_r")).drop("_r")


def below(walked: DataFrame, point: DataFrame, tree: str = "tree", inclusive: bool = False) -> DataFrame:
    at = walked.join(point.select(tree, F.col("idx").alias("_i")), tree).filter("idx = _i").select(tree, F.col("rank").alias("_r"))
    return walked.join(at, tree).filter(F.col("rank") >= F.col("_r") if inclusive else F.col("rank") > F.col("_r")).drop("_r")


def descendants(walked: DataFrame, point: DataFrame, tree: str = "tree") -> DataFrame:
    """The subtree of each tree's point, itself included."""
    p = point.select(tree, F.col("idx").alias("_i"))
    at = walked.join(p, tree).filter("idx = _i").select(tree, F.col("path").alias("_p"))
    return walked.join(at, tree).filter(F.startswith("path", F.col("_p"))).drop("_p")


def subtree_sums(walked: DataFrame, value: str, tree: str = "tree") -> DataFrame:
    """Each node's sum of ``value`` over its subtree, zero sums left out.

    Doubling again: a node's sum over 2k levels is its own over k and those of the nodes k levels below."""
    now = staged(walked.select(F.col(tree).alias("tree"), "idx", F.col("parent_idx").alias("up"), F.col(value).alias("sum")), "tree-sums")
    while now.filter("up <> -1").limit(1).count():
        below = now.filter("up <> -1").groupBy("tree", F.col("up").alias("idx")).agg(F.sum("sum").alias("below"))
        far = now.select("tree", F.col("idx").alias("up"), F.col("up").alias("next"))
        new = now.join(below, ["tree", "idx"], "left").join(far, ["tree", "up"], "left")
        new = staged(new.select("tree", "idx", F.coalesce("next", F.lit(-1)).alias("up"), (F.col("sum") + F.coalesce("below", F.lit(0))).alias("sum")), "tree-sums")
        dropped(now)
        now = new
    return now.filter("sum <> 0").select(F.col("tree").alias(tree), "idx", F.col("sum").alias(value))


def redirect_paths(links: DataFrame, max_depth: int = 10) -> DataFrame:
    """links(url, target): where each chain of redirects ends, and whether it loops or is longer than ``max_depth``.

    One equi-join a hop; the depth that counts as too long bounds them, and a row that has ended joins nothing."""
    hops = links.select(F.col("url").alias("from"), F.col("target").alias("next"))
    now = links.select("url", F.col("target").alias("end"), F.array("url").alias("seen"))
    looped = F.array_contains("seen", F.coalesce("end", F.lit("")))
    for _ in range(max_depth):
        on = F.when(~looped, F.col("end"))
        ahead = now.withColumn("on", on).join(hops, F.col("on") == F.col("from"), "left")
        goes = F.col("from").isNotNull()
        now = ahead.select("url", F.when(goes, F.col("next")).otherwise(F.col("end")).alias("end"), F.when(goes, F.array_append("seen", F.col("from"))).otherwise(F.col("seen")).alias("seen"))
    hops_ = F.size("seen")
    last = now.groupBy("url").agg(F.max_by("end", hops_).alias("end"), F.bool_or(looped).alias("loops"), F.max(hops_).alias("hops"))
    return last.select("url", "end", "loops", "hops", (F.col("hops") > max_depth).alias("too_long"))
