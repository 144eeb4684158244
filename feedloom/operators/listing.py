"""Ordered, paged listings by keyset: the order columns of the last row seen bound the next page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 15
MOST_BODIES, MOST_IDS, DEFAULT = 1000, 50_000, 20


def limit_of(asked: int | None, bodies: bool = True) -> int:
    return min(DEFAULT if asked is None else max(0, asked), MOST_BODIES if bodies else MOST_IDS)


def after(keys: list[str], point: tuple, descending: bool = False) -> Column:
    """Strictly beyond ``point`` in the order of ``keys``."""
    mine = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    theirs = F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(point)))
    return mine < theirs if descending else mine > theirs


def merged(posts: DataFrame, n: int, descending: bool = True, point: tuple | None = None) -> DataFrame:
    """A page over all feeds by (time, feed number the other way round): one top-n, no sort of everything."""
    rows = posts if point is None else posts.filter(_beyond(point, descending))
    order = [F.col("time").desc(), F.col("feed_id")] if descending else [F.col("time"), F.col("feed_id").desc()]
    return rows.orderBy(*order, F.col("post_idx").desc() if descending else F.col("post_idx")).limit(n)


def _beyond(point: tuple, descending: bool) -> Column:
    time, feed, idx = (F.lit(x) for x in point)
    t, f, i = F.col("time"), F.col("feed_id"), F.col("post_idx")
    if descending:
        return (t < time) | ((t == time) & ((f > feed) | ((f == feed) & (i < idx))))
    return (t > time) | ((t == time) & ((f < feed) | ((f == feed) & (i > idx))))


def grouped(posts: DataFrame, order: DataFrame, n: int) -> DataFrame:
    """Feeds one after the other in the user's order (unlisted last, by number), each newest first."""
    rows = posts.join(order.select("feed", "pos"), "feed", "left")
    return rows.orderBy(F.col("pos").asc_nulls_last(), "feed_id", F.col("time").desc(), F.col("post_idx").desc()).limit(n)


def user_order(items: DataFrame, order: DataFrame, key: str, pinned: list) -> DataFrame:
    """Pinned first as listed, then the user's own order, then the rest by key; adds ``place`` from 1."""
    pins = F.array_position(F.array(*map(F.lit, pinned)), F.col(key)) if pinned else F.lit(0)
    rows = items.join(order.select(key, "pos"), key, "left").withColumn("_pin", F.nullif(pins, F.lit(0)))
    w = Window.orderBy(F.col("_pin").asc_nulls_last(), F.col("pos").asc_nulls_last(), F.col(key))
    return rows.withColumn("place", F.row_number().over(w)).drop("_pin", "pos")


def visible_budget(items: DataFrame, group: list[str], order: list[Column], size: str, n: int) -> DataFrame:
    """Items (posts with their ``size`` of shown comments) until ``n`` are shown: the last may exceed it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("_before") < n).drop("_before")


def tag_listing(tagged: DataFrame, snapshot, ascending: bool = False, since=None, until=None) -> DataFrame:
    """Tagged items newest first, each once at its newest tagging up to the snapshot, within a time window."""
    rows = tagged.filter(F.col("tag_time") <= F.lit(snapshot))
    if since is not None:
        rows = rows.filter(F.col("tag_time") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("tag_time") < F.lit(until))
    w = Window.partitionBy("item_id").orderBy(F.col("tag_time").desc(), F.col("feed_id"))
    rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    down = [F.col("tag_time").desc(), F.col("feed_id"), F.col("item_id")]
    up = [F.col("tag_time"), F.col("feed_id").desc(), F.col("item_id").desc()]
    return rows.orderBy(*(up if ascending else down))


def id_window(items: DataFrame, key: str, since=None, most=None, with_ids: list | None = None, n: int = 50) -> DataFrame:
    """Up to n after ``since``, or before ``most``, or those named."""
    if with_ids is not None:
        return items.filter(F.col(key).isin(with_ids[:n])).orderBy(key)
    if most is not None:
        return items.filter(F.col(key) < most).orderBy(F.col(key).desc()).limit(n)
    return items.filter(F.col(key) > (since or 0)).orderBy(key).limit(n)


def batches(items: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Numbers batches of n in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return items.withColumn("batch", F.ceil(F.row_number().over(w) / n).cast("int"))


def natural_key(c: Column) -> Column:
    """Sorts numbers inside text by value: digits padded to 20 places, letters lower-cased."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")
