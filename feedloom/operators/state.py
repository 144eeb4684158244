"""Small predicates and lookups over feeds, users and tagged items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MODE = {"ascending": False, "unread_only": True, "expanded": False}

#: Parts of a path that say nothing but that it is a logo.
LOGO_PARTS = ("", "assets", "images", "files", "uploads", "logo", "rss", "stub", "icon", "favicon", "png", "jpg", "jpeg", "gif", "webp")


def newer_feeds(newest: DataFrame, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Feeds with something downloaded since a time: newest(feed, dl_time) of posts, counts(feed, version) of comments,
    which matter to expanded feeds only; wanted(feed, expanded, since)."""
    posts = newest.groupBy("feed").agg(F.max("dl_time").alias("post_time"))
    comments = counts.groupBy("feed").agg(F.max("version").alias("comment_time"))
    known = wanted.join(posts, "feed").join(comments, "feed", "left")
    return known.filter((F.col("post_time") >= F.col("since")) | (F.col("expanded") & F.coalesce(F.col("comment_time") >= F.col("since"), F.lit(False)))).select("feed")


def empty_masks(masks: DataFrame, keys: list[str], on_error: bool) -> DataFrame:
    """Whether each mask (rows keys, state, size) lets nothing through; an erroneous one counts as ``on_error`` says."""
    wrong = F.max(F.col("state") == "error")
    return masks.groupBy(*keys).agg(F.when(wrong, on_error).otherwise(F.coalesce(F.sum("size"), F.lit(0)) == 0).alias("empty"))


def is_paid(state: Column, till: Column, now: datetime) -> Column:
    """Unknown states count as paid; nobody (null) does not."""
    runs = state.isin("paid", "trial") & (till > F.lit(now))
    return F.coalesce((state == "unknown") | runs, F.lit(False))


def view_modes(listed: DataFrame, modes: DataFrame, keys: list[str], unread_only: bool = True) -> DataFrame:
    """Each listed feed, folder or tag with the mode that its user chose, or the default; tags show read items too."""
    default = DEFAULT_MODE | {"unread_only": unread_only}
    return listed.join(modes, keys, "left").select(*listed.columns, *(F.coalesce(k, F.lit(v)).alias(k) for k, v in default.items()))


def distinct_authors(messages: DataFrame, author: str) -> DataFrame:
    return messages.agg(F.countDistinct(F.lower(author)).alias("authors"))


def average_size(sizes: DataFrame, size: str, below: int = 1000) -> DataFrame:
    """Mean of the sizes below a bound; 0 if there are none."""
    return sizes.agg(F.coalesce(F.avg(F.when(F.col(size) < below, F.col(size))), F.lit(0.0)).alias("average"))


def tags_of_feeds(items: DataFrame, starred: str = "starred") -> DataFrame:
    """(feed, tag) from items(feed, tags): all tags of a feed's items, and null for "all tags", which an item that is only
    starred has no part in."""
    tags = F.when(F.size("tags") == 0, F.array().cast("array<string>")).when(F.expr(f"tags = array('{starred}')"), F.col("tags")).otherwise(F.concat(F.array(F.lit(None).cast("string")), F.col("tags")))
    return items.select("feed", F.explode(tags).alias("tag")).distinct()


def feeds_of_tag(items: DataFrame, active: DataFrame) -> DataFrame:
    """(tag, feed): the active feeds that have items of a tag."""
    return items.select("feed", F.explode("tags").alias("tag")).distinct().join(active.select("feed"), "feed", "left_semi").select("tag", "feed")


def users_by_country(users: DataFrame, sign_ins: DataFrame, payments: DataFrame) -> DataFrame:
    """(user, country, paid): "-" where no first sign-in tells a country; paid if the user ever paid."""
    ever = payments.select("user").distinct().withColumn("ever", F.lit(True))
    told = users.select("user").join(sign_ins.select("user", "country"), "user", "left").join(ever, "user", "left")
    return told.select("user", F.coalesce("country", F.lit("-")).alias("country"), F.coalesce("ever", F.lit(False)).alias("paid"))


def looks_like_logo(path: Column) -> Column:
    """Whether a path and query have no part but those of LOGO_PARTS."""
    parts = F.split(F.lower(path), "[/.\\-_?=&]")
    return (path != "") & (F.size(F.array_except(parts, F.array(*map(F.lit, LOGO_PARTS)))) == 0)


def valid_renames(renames: DataFrame, now: Column, most: int) -> DataFrame:
    """renames(user, time, url, to) of less than a day ago: each url's newest, ``most`` a user."""
    recent = renames.filter(F.unix_timestamp(now) - F.unix_timestamp("time") < 86400)
    newest = F.row_number().over(Window.partitionBy("user", "url").orderBy(F.col("time").desc(), "to"))
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.col("time").desc(), "url"))
    kept = recent.withColumn("_n", newest).filter("_n = 1").withColumn("_n", rank).filter(F.col("_n") <= most)
    return kept.drop("_n")


def until_older(posts: DataFrame, least: Column, feed: str = "feed") -> DataFrame:
    """Posts of a descending scan up to the first, by time, whose download and own times both lie before ``least``."""
    old = (F.col("dl_time") < least) & (F.coalesce("time", "dl_time") < least)
    before = Window.partitionBy(feed).orderBy(F.col("time").desc(), F.col("post_idx").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return posts.withColumn("_old", F.max(old).over(before)).filter("NOT _old").drop("_old")
