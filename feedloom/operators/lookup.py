"""Keyed tables: lookups, merging writes, id resolution, variants of an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, url

#: Keys that a lookup broadcasts at most.
MOST_KEYS = 100_000


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value)


def get_many(table: DataFrame, key: str, values: list) -> DataFrame:
    """One row for each value in order (``position``), nulls where the table has none."""
    spark = table.sparkSession
    wanted = spark.createDataFrame(list(enumerate(values)), f"position int, {key} {table.schema[key].dataType.simpleString()}")
    return (F.broadcast(wanted) if len(values) <= MOST_KEYS else wanted).join(table, key, "left").orderBy("position")


def keys(table: DataFrame, key: str, after=None, n: int | None = None) -> DataFrame:
    """Keys in order, from a continuation on."""
    rows = table.select(key).distinct()
    rows = rows if after is None else rows.filter(F.col(key) > after)
    return rows.orderBy(key) if n is None else rows.orderBy(key).limit(n)


def merge_write(table: DataFrame, new: DataFrame, key: list[str], aggregates: list[Column]) -> DataFrame:
    """Old and new rows of a key merged by aggregates."""
    return table.unionByName(new).groupBy(*key).agg(*aggregates)


def fresh(cache: DataFrame, now, ok_seconds: int = 86_400, error_seconds: int = 3600) -> DataFrame:
    """cache(.., time, error): what has not expired; errors expire sooner."""
    ttl = F.when(F.col("error").isNull(), ok_seconds).otherwise(error_seconds)
    return cache.filter(F.unix_seconds("time") + ttl > F.unix_seconds(F.lit(now)))


def resolve_items(items: DataFrame, headers: DataFrame, saved: DataFrame) -> DataFrame:
    """items(item_id) -> message keys by headers(item_id, key), else by what tagging has saved (item_id, key)."""
    rows = items.join(headers.select("item_id", F.col("key").alias("_h")), "item_id", "left").join(saved.select("item_id", F.col("key").alias("_s")), "item_id", "left")
    return rows.select("item_id", F.coalesce("_h", "_s").alias("key")).filter("key IS NOT NULL")


def by_variant(links: DataFrame, known: DataFrame, link: str, guid: str) -> DataFrame:
    """Adds ``seen``: whether a known guid is the link in some variant of scheme, www and port."""
    plain = lambda c: F.regexp_replace(url.bare(c), r"^([^/:]+):(?:80|443)(?=/|$)", "$1")
    k = known.select(plain(F.col(guid)).alias("_k")).distinct().withColumn("seen", F.lit(True))
    return links.withColumn("_k", plain(F.col(link))).join(k, "_k", "left").withColumn("seen", F.coalesce("seen", F.lit(False))).drop("_k")


def translated(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tags(feed, tag, users) and dictionary(tag, country, word): users of each word by country; words that are the feed's own tags are left out."""
    rows = tags.join(dictionary, "tag").groupBy("feed", "country", "word").agg(F.sum("users").alias("users"))
    return rows.join(tags.select("feed", F.col("tag").alias("word")), ["feed", "word"], "left_anti")


def without_site_parts(pages: DataFrame) -> DataFrame:
    """pages(url, image, icon, description): what a page only shares with its site's root page is taken out."""
    root = F.concat(url.root_page(F.col("url")), F.lit("/"))
    roots = pages.filter(url.is_top_level(F.col("url"))).select(root.alias("_root"), *(F.col(c).alias(f"_{c}") for c in ("image", "icon", "description")))
    rows = pages.withColumn("_root", root).join(roots.dropDuplicates(["_root"]), "_root", "left")
    own = lambda c: F.when(~url.is_top_level(F.col("url")) & F.col(c).eqNullSafe(F.col(f"_{c}")), None).otherwise(F.col(c)).alias(c)
    return rows.select("url", *(own(c) for c in ("image", "icon", "description")))


def range_slice(table: DataFrame, key: str, low, high) -> DataFrame:
    """Keys strictly between two."""
    return table.filter((F.col(key) > low) & (F.col(key) < high))


def comment_items(table: DataFrame, feed: int, post: int) -> DataFrame:
    """A post's comments by their packed ids, a range of the key."""
    low = ids.pack(F.lit(feed), F.lit(post), F.lit(0))
    return table.filter((F.col("item_id") >= low) & (F.col("item_id") <= ids.pack(F.lit(feed), F.lit(post), F.lit(0x3FFF))))


def quality_gate(feeds: DataFrame, now) -> DataFrame:
    """Why a feed is not in the catalogue, null if it is; feeds(is_deleted, next_scan, error_since, title, bad, posts)."""
    week = F.unix_seconds(F.lit(now)) - F.unix_seconds("error_since") > 7 * 86400
    reason = (
        F.when(F.col("is_deleted"), "Deleted posts").when(F.col("next_scan").isNull(), "No more scanning").when(week, "A week of errors").when(F.coalesce("title", F.lit("")) == "", "No title")
        .when(F.col("bad"), "Bad title").when(F.col("posts") == 0, "Empty feed").when(F.col("posts") == 1, "Single post feed")
    )
    return feeds.withColumn("reason", reason)


def reasons(feeds: DataFrame) -> DataFrame:
    return feeds.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def first_picture(headers: DataFrame, pattern: str, latest: int = 50) -> DataFrame:
    """headers(feed, time, picture): the first picture like a pattern among a feed's latest headers."""
    w = Window.partitionBy("feed").orderBy(F.col("time").desc())
    rows = headers.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= latest) & F.col("picture").rlike(pattern))
    return rows.groupBy("feed").agg(F.min_by("picture", "_n").alias("picture"))


def collapsed(messages: DataFrame, key: list[str], time: str) -> DataFrame:
    """The latest of each key."""
    w = Window.partitionBy(*key).orderBy(F.col(time).desc())
    return messages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def attachments(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows(key, pos, url, mime, size, ..): one of each address at its first place, with whatever attributes any has."""
    rest = [c for c in rows.columns if c not in (*key, "pos", "url")]
    one = rows.groupBy(*key, "url").agg(F.min("pos").alias("pos"), *(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in rest))
    return one.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "url", *rest))).alias("attachments"))
