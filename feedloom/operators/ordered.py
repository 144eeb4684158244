"""Ordered analytics: retention, successive differences, batch normalisation, id assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_ids(existing: DataFrame, new: DataFrame, name: str, id_col: str, keys: list[str]) -> DataFrame:
    """Dense ids for names that have none, going on from each key's largest, in order of name."""
    top = existing.groupBy(*keys).agg(F.max(id_col).alias("_top"))
    fresh = new.select(*keys, name).distinct().join(existing.select(*keys, name), [*keys, name], "left_anti")
    w = Window.partitionBy(*keys).orderBy(name)
    given = fresh.withColumn("_n", F.row_number().over(w)).join(top, keys, "left")
    return given.select(*keys, name, (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long").alias(id_col))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep-first dedup."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def batch(items: DataFrame, most: int = 500, trusted: bool = False) -> DataFrame:
    """A fetched batch (feed, pos, guid, link, time) made ready: newest first if every item has a time, positions from
    0, repeated guids dropped (unless empty, and not for trusted sources), a count for each link of what is left, only
    positions below ``most``; ``out`` numbers these oldest first."""
    all_timed = F.bool_and(F.col("time").isNotNull()).over(Window.partitionBy("feed"))
    rows = items.withColumn("_timed", all_timed)
    key = F.when(F.col("_timed"), -F.unix_micros("time")).otherwise(F.lit(0))
    w = Window.partitionBy("feed").orderBy(key, "pos")
    rows = rows.withColumn("position", F.row_number().over(w) - 1)
    if not trusted:
        named = F.length(F.trim(F.coalesce(F.col("guid").cast("string"), F.lit("")))) > 0
        rows = rows.withColumn("_key", F.when(named, F.col("guid").cast("string")).otherwise(F.concat(F.lit("\u0000"), F.col("position"))))
        rows = first_of(rows, ["feed", "_key"], [F.col("position")]).drop("_key")
    rows = rows.withColumn("link_count", F.count("*").over(Window.partitionBy("feed", "link")))
    back = Window.partitionBy("feed").orderBy(F.col("position").desc())
    return rows.filter(F.col("position") < most).withColumn("out", F.row_number().over(back) - 1).drop("_timed")


def newer_than_known(items: DataFrame) -> DataFrame:
    """items(feed, position, known), newest first: those before the first known one; all where none is known."""
    first = F.min(F.when(F.col("known"), F.col("position"))).over(Window.partitionBy("feed"))
    return items.withColumn("_f", first).filter(F.col("_f").isNull() | (F.col("position") < F.col("_f"))).drop("_f")


def retained(posts: DataFrame, keep: int = 500, tagged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted) posts: the newest ``keep`` of each feed stay, and so do tagged ones; evicted ones carry comments."""
    w = Window.partitionBy("feed").orderBy(F.col("post_idx").desc())
    rows = posts.withColumn("_n", F.row_number().over(w))
    rows = rows.join(tagged.select("feed", "post_idx", F.lit(True).alias("_t")).distinct(), ["feed", "post_idx"], "left") if tagged is not None else rows.withColumn("_t", F.lit(None).cast("boolean"))
    keep_ = (F.col("_n") <= keep) | F.coalesce("_t", F.lit(False))
    return rows.filter(keep_).drop("_n", "_t"), rows.filter(~keep_).drop("_n", "_t")


def version_retention(versions: DataFrame, now, keep: int = 1000, slack: int = 30) -> DataFrame:
    """versions(feed, post_idx, version, count, time): newest ``keep`` of a feed not older than a day stay, and each
    post's latest; nothing goes from a feed that would lose ``slack`` or fewer."""
    feed, post = Window.partitionBy("feed").orderBy(F.col("version").desc()), Window.partitionBy("feed", "post_idx").orderBy(F.col("version").desc())
    old = (F.row_number().over(feed) > keep) | (F.col("time") < F.lit(now) - F.expr("INTERVAL 1 DAY"))
    rows = versions.withColumn("_p", F.row_number().over(post)).withColumn("_go", old & (F.row_number().over(post) > 1))
    lost = F.count_if("_go").over(Window.partitionBy("feed"))
    return rows.withColumn("_lost", lost).filter(~F.col("_go") | (F.col("_lost") <= slack)).drop("_p", "_go", "_lost")


def as_of(points: DataFrame, versions: DataFrame, keys: list[str], at: str, version: str, value: str, default=0) -> DataFrame:
    """Each point's latest value with version <= at: one union and one window, no pairs of points and versions."""
    p = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast(versions.schema[value].dataType).alias("_v"))
    v = versions.select(*keys, F.col(version).alias("_at"), F.lit(0).alias("_point"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = p.unionByName(v).withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_point = 1")
    return found.select(*keys, F.col("_at").alias(at), F.coalesce(value, F.lit(default)).alias(value))


def monotone(df: DataFrame, keys: list[str], time: str, order: list[str]) -> DataFrame:
    """Times made strictly increasing in order: each at least a second after the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w)
    base = F.unix_seconds(time) - n
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_base", base).withColumn("_n", n).withColumn("monotone", F.timestamp_seconds(F.max("_base").over(up) + F.col("_n"))).drop("_base", "_n")


def recent(df: DataFrame, keys: list[str], time: str, now, days: int = 30, n: int = 10) -> DataFrame:
    """The newest n within so many days."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.filter(F.col(time) >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def effective_time(time: Column, downloaded: Column, last_batch: Column | None = None) -> Column:
    """Not later than the download; the download's time where missing or older than the batch before."""
    t = F.least(F.coalesce(time, downloaded), downloaded)
    return t if last_batch is None else F.when(t < last_batch, downloaded).otherwise(t)


def increasing_counts(events: DataFrame, keys: list[str], order: str, count: str) -> DataFrame:
    """Comment counts that grow: an event that does not exceed all before it is ignored."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    up = F.coalesce(F.max(count).over(w), F.lit(0))
    return events.withColumn("_up", up).filter(F.col(count) > F.col("_up")).withColumn("grown", F.col(count) - F.col("_up")).drop("_up")


def paid_till(payments: DataFrame, user: str = "user") -> DataFrame:
    """payments(user, time, days): each adds its days from its own time or from the end of those before, if later."""
    fold = F.aggregate(F.sort_array(F.collect_list(F.struct(F.unix_seconds("time").alias("t"), F.col("days").cast("long").alias("d")))), F.lit(0).cast("long"), lambda end, p: F.greatest(end, p["t"]) + p["d"] * 86400)
    return payments.groupBy(user).agg(F.timestamp_seconds(fold).alias("paid_till"))
