"""Counters of feeds, folders, streams and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed_counters(posts: DataFrame, flag: str = "read", order: tuple[str, ...] = ("time", "post_idx")) -> DataFrame:
    """Total and read posts, and the first and last unread post by order."""
    key = F.struct(*order)
    unread = ~F.col(flag)
    return posts.groupBy("feed").agg(
        F.count("*").alias("total"), F.count_if(F.col(flag)).alias("read"),
        F.min_by(F.when(unread, F.col("post_idx")), F.when(unread, key)).alias("first_unread"),
        F.max_by(F.when(unread, F.col("post_idx")), F.when(unread, key)).alias("last_unread"),
    )


def state_counters(subs: DataFrame, state: str = "state", names: tuple[str, ...] = ("subscribed", "scanning", "error")) -> list[Column]:
    """One 0/1 column per state."""
    return [F.when(F.col(state) == n, 1).otherwise(0).alias(n) for n in names]


def folder_rollup(feeds: DataFrame, folders: str = "folders") -> DataFrame:
    """Sums per folder and over all feeds (folder null): a feed counts in each of its folders, but once in all.

    Comments count only where the feed is shown expanded."""
    sums = [F.sum("total").alias("total"), F.sum("read").alias("read"), F.sum(F.when(F.col("expanded"), F.col("comments")).otherwise(0)).alias("comments"), F.count("*").alias("feeds")]
    one = feeds.select("*", F.explode(F.array_distinct(folders)).alias("folder")).groupBy("folder").agg(*sums)
    return one.unionByName(feeds.agg(*sums).select(F.lit(None).cast("string").alias("folder"), "total", "read", "comments", "feeds"))


def stream_counters(matches: DataFrame, posts: DataFrame, flag: str = "read") -> DataFrame:
    """matches(stream, feed, post_idx): visible and unread posts of each stream."""
    joined = matches.join(posts.select("feed", "post_idx", flag), ["feed", "post_idx"])
    return joined.groupBy("stream").agg(F.count("*").alias("total"), F.count_if(~F.col(flag)).alias("unread"), F.count_distinct("feed").alias("feeds"))


def tag_counters(tagged: DataFrame, posts: DataFrame) -> DataFrame:
    """tagged(tag, feed, post_idx, comment_idx, expanded); posts(feed, post_idx, read).

    A comment whose post has the tag too and is expanded is not counted again; items of unknown feeds count as read."""
    own = tagged.filter("comment_idx IS NULL AND expanded").select("tag", "feed", "post_idx").distinct().withColumn("_post", F.lit(True))
    rows = tagged.join(own, ["tag", "feed", "post_idx"], "left").filter("comment_idx IS NULL OR _post IS NULL")
    rows = rows.join(posts.select("feed", "post_idx", "read"), ["feed", "post_idx"], "left").withColumn("read", F.coalesce("read", F.lit(True)))
    return rows.groupBy("tag").agg(F.count("*").alias("total"), F.count_if("read").alias("read"))


def changed(now: DataFrame, client: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counters that differ from what the client has; those that are gone are 0."""
    a = now.select(key, *values)
    b = client.select(key, *(F.col(v).alias(f"_{v}") for v in values))
    out = a.join(b, key, "full_outer").select(key, *(F.coalesce(v, F.lit(0)).alias(v) for v in values), *(f"_{v}" for v in values))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return out.filter(~same).select(key, *values)


def unread_streams(counters: DataFrame) -> DataFrame:
    """Streams with unread items."""
    return counters.filter((F.col("unread") > 0) & (F.col("feeds") > 0))


def group_ids(items: DataFrame, group: str, item: str) -> DataFrame:
    return items.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("ids"))
