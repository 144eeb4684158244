"""Crawl scheduling as columns: time buckets, list numbers, dispatch order, cancel rules, scan progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW_LISTS, SUBSCRIPTION_LISTS = 32, 1_000_000


def scan_bucket(time: Column, step_ms: int = 500) -> Column:
    return F.timestamp_micros(F.unix_micros(time) - F.pmod(F.unix_micros(time), F.lit(step_ms * 1000)))


def list_number(url: Column, lists: int = NEW_LISTS) -> Column:
    """Which of so many lists a url is queued in."""
    return F.pmod(F.xxhash64(url), F.lit(lists)).cast("int")


def due(queue: DataFrame, now) -> DataFrame:
    """queue(url, time) entries whose time has come."""
    return queue.filter(F.col("time") <= F.lit(now))


def current(queue: DataFrame, urls: DataFrame) -> DataFrame:
    """Entries that still stand: their time is the url's next scan; urls(url, next_scan)."""
    return queue.join(urls.select("url", F.col("next_scan").alias("time")), ["url", "time"], "left_semi")


def processed_removed(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("bucket", "url"), ["bucket", "url"], "left_anti")


def dispatch_order(queue: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Adds ``turn``: per host, kinds take turns by weight, oldest first within a kind."""
    w = Window.partitionBy("host", "kind").orderBy("time", "url")
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("kind")]
    round_ = F.floor((F.row_number().over(w) - 1) / F.coalesce(weight, F.lit(1)))
    ranked = queue.withColumn("_round", round_)
    turn = Window.partitionBy("host").orderBy("_round", "kind", "time", "url")
    return ranked.withColumn("turn", F.row_number().over(turn)).drop("_round")


def top_hosts(queue: DataFrame, least: int = 10) -> DataFrame:
    return queue.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > least).orderBy(F.col("n").desc(), "host")


def cancelled(no_parents: Column, no_readers_days: Column, comments: Column, few_comments: Column, late_days: Column) -> Column:
    """Whether a queued fetch is dropped: nothing links to it, nobody has read it for a day, too many comments, or three days late."""
    most = F.when(few_comments, 200).otherwise(600)
    return F.coalesce(no_parents | (no_readers_days >= 1) | (comments > most) | (late_days >= 3), F.lit(False))


def scanned_percent(posts: Column, posts_without_new: Column, seconds_since_start: Column) -> Column:
    """Share of posts without new comment feeds in percent; all of them after an hour, or if there are none."""
    share = F.floor(100 * posts_without_new / F.when(posts > 0, posts)).cast("int")
    return F.when(seconds_since_start > 3600, 100).otherwise(F.coalesce(share, F.lit(100)))


def subscription_state(state: Column, found: Column, error: Column, seconds: Column) -> Column:
    """The next state: a new subscription is found or, after half an hour, retried; retries end in an error after two hours."""
    return (
        F.when(found, "subscribed").when(error.isNotNull() & (seconds > 7200), "error").when(state.isin("adding", "scanning") & (seconds > 1800), "retry").otherwise(state)
    )


def in_batches_of_once(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests in flight together are looked up once."""
    return requests.dropDuplicates(keys)
