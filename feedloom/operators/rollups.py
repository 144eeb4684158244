"""Time buckets and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_range(start: int, end: int, step: int) -> tuple[range, range, range]:
    """start..end as base units before the first whole step, whole steps, and base units after the last."""
    if end < start:
        return range(0), range(0), range(0)
    first, last = -(-start // step), (end + 1) // step
    if last <= first:
        return range(start, end + 1), range(0), range(0)
    return range(start, first * step), range(first, last), range(last * step, end + 1)


def buckets(events: DataFrame, time: str, width: str = "5 minutes", keys: tuple[str, ...] = ("user_id",), flag: str = "event_type") -> DataFrame:
    """Distinct flags and number of events per bucket and key."""
    w = F.window(time, width)
    return events.groupBy(w.alias("w"), *keys).agg(F.sort_array(F.collect_set(flag)).alias("flags"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *keys, "flags", "n")


def days(base: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Day aggregates of bucket rows."""
    return base.groupBy(F.date_trunc("day", "bucket").alias("bucket"), *keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.sum("n").alias("n"))


def over_range(base: DataFrame, daily: DataFrame, start, end, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Flags and events of [start, end): day aggregates for whole days, buckets for what is left at either end."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    first = F.when(F.date_trunc("day", s) == s, s).otherwise(F.date_trunc("day", s) + F.expr("INTERVAL 1 DAY"))
    last = F.greatest(F.date_trunc("day", e), first)
    t = F.col("bucket")
    edges = base.filter((t >= s) & (t < e) & ((t < first) | (t >= last)))
    rows = edges.select("bucket", *keys, "flags", "n").unionByName(daily.filter((t >= first) & (t < last)).select("bucket", *keys, "flags", "n"))
    return rows.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.sum("n").alias("n"))


def counters(events: DataFrame, name: str, amount: str) -> DataFrame:
    return events.groupBy(name).agg(F.sum(amount).alias("value"))
