"""Merging versions of a record that were written apart: each rule is an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subscription states, the furthest last.
STATES = ("adding", "subscribed", "scanning", "retry", "error")


def replicas(*tables: DataFrame) -> DataFrame:
    """Versions side by side; ``replica`` numbers them, and the earlier wins a tie."""
    out = None
    for n, t in enumerate(tables):
        t = t.withColumn("replica", F.lit(n))
        out = t if out is None else out.unionByName(t)
    return out


def max_by(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The version with the largest ``order`` wins whole; of equals the earlier replica's."""
    rest = [c for c in versions.columns if c not in (*keys, "replica")]
    best = F.max_by(F.struct(*rest), F.struct(*order, -F.col("replica"))).alias("_best")
    return versions.groupBy(*keys).agg(best).select(*keys, "_best.*")


def map_max(versions: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Union of maps, each key with its largest value."""
    entries = versions.select(*keys, F.explode(column).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.max("_v").alias("_v"))
    return entries.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(column))


def tier_max(versions: DataFrame, keys: list[str], tiers: tuple[str, ...], tier: str, till: str) -> DataFrame:
    """The highest tier, and of equals the latest till."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col(tier))
    best = F.max(F.struct(place.alias("p"), F.col(till), F.col(tier))).alias("_b")
    return versions.groupBy(*keys).agg(best).select(*keys, F.col(f"_b.{tier}").alias(tier), F.col(f"_b.{till}").alias(till))


def fields(versions: DataFrame, keys: list[str], least: list[str] = (), most: list[str] = (), union: list[str] = ()) -> DataFrame:
    """Smallest, largest and united fields."""
    return versions.groupBy(*keys).agg(
        *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most),
        *(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in union),
    )


def two_phase(added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """What was added and never removed."""
    return added.select(*keys).distinct().join(removed.select(*keys), keys, "left_anti")


def replay(events: DataFrame, keys: list[str], order: list[str], added: str) -> DataFrame:
    """Keys whose last event adds them."""
    last = events.groupBy(*keys).agg(F.max_by(added, F.struct(*order)).alias("_a"))
    return last.filter("_a").select(*keys)


def subscriptions(versions: DataFrame) -> DataFrame:
    """subscriptions(user, url, state, edits, title, folders, replica): the furthest state wins, then the most edits;
    folders are united."""
    place = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    best = F.max(F.struct(place.alias("p"), "edits", (-F.col("replica")).alias("r"), "state", "title")).alias("_b")
    out = versions.groupBy("user", "url").agg(best, F.sort_array(F.array_distinct(F.flatten(F.collect_list("folders")))).alias("folders"))
    return out.select("user", "url", "_b.state", "_b.edits", "_b.title", "folders")


def opml_union(rows: DataFrame) -> DataFrame:
    """One row per url, its folders united in order of appearance, the first title kept; rows(url, title, folders, pos)."""
    lists = F.sort_array(F.collect_list(F.struct("pos", "folders", "title"))).alias("_l")
    return rows.groupBy("url").agg(lists).select("url", F.col("_l")[0]["title"].alias("title"), F.array_distinct(F.flatten("_l.folders")).alias("folders"))


def sorted_union(a: DataFrame, b: DataFrame, key: str, aggregates: list[Column]) -> DataFrame:
    """Full outer merge with duplicates of a key combined."""
    return a.unionByName(b).groupBy(key).agg(*aggregates)
