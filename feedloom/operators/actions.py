"""User actions as an event log: read state and tags are what replaying the log leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def coalesced(actions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Drops an action that repeats the one just before it (same values of ``keys``) of the same user."""
    w = Window.partitionBy("user").orderBy(order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    return actions.withColumn("_same", same & F.lag(order).over(w).isNotNull()).filter("NOT _same").drop("_same")


def runs(actions: DataFrame, key: str, order: str) -> DataFrame:
    """Numbers groups of successive actions with one ``key`` per user, from 1."""
    w = Window.partitionBy("user").orderBy(order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    return actions.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")


def last_state(actions: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last action's value for each key."""
    return actions.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def mark_read(read: DataFrame, actions: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """Read ranges after the marks (read boolean): the last mark of an item counts."""
    last = last_state(actions, [*keys, item], "read", order)
    more = ranges.insert(read, last.filter("read"), keys, item)
    return ranges.delete(more, last.filter("NOT read"), keys, item)


def mark_feed_read(posts: DataFrame, read: DataFrame, matches: DataFrame | None = None, older_than=None, point: tuple | None = None, above: bool = True, ascending: bool = False) -> DataFrame:
    """Read ranges (feed, lo, hi) after marking posts read: those of a mask, older than a time, above or below a point.

    The point is (time, feed_id, post_idx); in ascending order above and below change places; ties go by feed, then post."""
    rows = posts if matches is None else posts.join(matches.select("feed", "post_idx").distinct(), ["feed", "post_idx"], "left_semi")
    if older_than is not None:
        rows = rows.filter(F.col("time") < F.lit(older_than))
    if point is not None:
        rows = rows.filter(beyond(point, newer=above != ascending))
    return ranges.union(read, ranges.from_items(rows, ["feed"], "post_idx"), ["feed"])


def beyond(point: tuple, newer: bool) -> Column:
    """Strictly newer (or older) than the point: by time, then feed number the other way round, then post."""
    time, feed, idx = (F.lit(x) for x in point)
    t, f, i = F.col("time"), F.col("feed_id"), F.col("post_idx")
    if newer:
        return (t > time) | ((t == time) & (f < feed)) | ((t == time) & (f == feed) & (i > idx))
    return (t < time) | ((t == time) & (f > feed)) | ((t == time) & (f == feed) & (i < idx))


def replay_tags(log: DataFrame) -> DataFrame:
    """Tags of (user, item) after log rows (user, item_id, tag, added, seq): the last word on each tag counts."""
    last = log.groupBy("user", "item_id", "tag").agg(F.max_by("added", "seq").alias("added"), F.max("seq").alias("seq"))
    return last.filter("added").select("user", "item_id", "tag", "seq")


def remove_tag_older(tagged: DataFrame, tag: str, before) -> DataFrame:
    return tagged.filter(~((F.col("tag") == tag) & (F.col("tag_time") < F.lit(before))))


def rename_folder(subs: DataFrame, old: str, new: str | None) -> DataFrame:
    """Renames (or, with None, removes) a folder in all lists; where both were listed one stays, at the first place."""
    mapped = F.transform("folders", lambda f: F.when(f == old, F.lit(new)).otherwise(f))
    return subs.withColumn("folders", F.array_distinct(F.filter(mapped, lambda f: f.isNotNull())))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """changes replace the rows with their keys; rows with ``_deleted`` true only remove."""
    kept = table.join(changes.select(*keys), keys, "left_anti")
    new = changes.filter("NOT _deleted").select(*table.columns) if "_deleted" in changes.columns else changes.select(*table.columns)
    return kept.unionByName(new)


def initially_ignored(posts: DataFrame, now, newest: int = 10, days: int = 30) -> DataFrame:
    """What a new subscriber does not see as unread: all but the newest ten, and what is older than thirty days."""
    w = Window.partitionBy("feed").orderBy(F.col("time").desc(), F.col("post_idx").desc())
    old = F.col("time") < F.lit(now) - F.expr(f"INTERVAL {days} DAYS")
    rows = posts.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") > newest) | old)
    return ranges.from_items(rows, ["feed"], "post_idx")


def surrogate_ids(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """existing(user, key, id), wanted(user, key, time): a user's ids that are still wanted stay, new keys follow the
    user's largest id by time."""
    kept = existing.join(wanted.select("user", "key"), ["user", "key"], "left_semi")
    new = wanted.join(existing.select("user", "key"), ["user", "key"], "left_anti")
    top = existing.groupBy("user").agg(F.max("id").alias("_top"))
    given = new.withColumn("_n", F.row_number().over(Window.partitionBy("user").orderBy("time", "key"))).join(top, "user", "left")
    return kept.select("user", "key", "id").unionByName(given.select("user", "key", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long").alias("id")))


def expired_accounts(users: DataFrame, now, days: int = 30, payer_days: int = 60) -> DataFrame:
    """Users to archive: expired long enough and without saved queries; users(user, paid_till, ever_paid, queries)."""
    wait = F.when(F.col("ever_paid"), payer_days).otherwise(days)
    return users.filter((F.unix_timestamp("paid_till") + wait * 86400 < F.unix_timestamp(F.lit(now))) & (F.col("queries") == 0))


def skipped(walked: DataFrame, points: DataFrame, visible: DataFrame, read: DataFrame, tree: str = "tree") -> DataFrame:
    """Read ranges (tree, lo, hi) of comments after the subtrees of the points are skipped, as far as they were visible
    then; walked as by ``trees.preorder``, visible(tree, count)."""
    from . import trees

    below = trees.descendants(walked, points, tree).join(visible, tree).filter(F.col("idx") < F.col("count"))
    return ranges.union(read, ranges.from_items(below, [tree], "idx"), [tree])


def read_deltas(before: DataFrame, after: DataFrame, folders: DataFrame) -> DataFrame:
    """What a change of read state (feed, post_idx, read) adds to the read counters of feeds and their folders; zeros are left out."""
    b = before.select("feed", "post_idx", F.col("read").cast("int").alias("_b"))
    change = after.join(b, ["feed", "post_idx"], "left").select("feed", (F.col("read").cast("int") - F.coalesce("_b", F.lit(0))).alias("d"))
    feeds = change.groupBy("feed").agg(F.sum("d").alias("delta")).filter("delta <> 0")
    up = feeds.join(folders, "feed").select(F.explode("folders").alias("name"), "delta").groupBy("name").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    return feeds.select(F.lit("feed").alias("kind"), F.col("feed").alias("name"), "delta").unionByName(up.select(F.lit("folder").alias("kind"), "name", "delta"))


def imported(found: DataFrame, existing: DataFrame, folders: DataFrame) -> DataFrame:
    """found(user, tag, item_id) of an import: new items of tags that are no folders, each once."""
    return found.join(folders.select("user", F.col("folder").alias("tag")), ["user", "tag"], "left_anti").join(existing.select("user", "tag", "item_id"), ["user", "tag", "item_id"], "left_anti").distinct()
