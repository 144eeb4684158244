"""Messages as rows for search, headers and clients; per-user upkeep: tagged copies, archives, backups, welcome state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Users that are never archived.
KEPT_USERS = ("fte", "se", "demo")

#: Hosts whose feeds are public, and their subdomains.
PUBLIC_HOSTS = ("vk.com", "t.me", "telegram.me", "instagram.com", "feedburner.com", "pinterest.com", "flickr.com", "soundcloud.com", "slideshare.net")

#: Parts of a path that tell nothing about what a feed holds.
COMMON_PARTS = (
    "", "rss", "rss2", "rss20", "atom", "rdf", "xml", "feeds", "feed", "blogs", "blog", "web", "index", "news", "newsticker", "main", "posts", "default",
    "home", "data", "alt", "current", "recent", "new", "articles", "full", "all", "php", "aspx", "asp", "pl", "js",
)


def search_rows(messages: DataFrame) -> DataFrame:
    """What search reads of a message: texts, times with defaults, links that are not empty, and flags.

    messages(.., time, dl_time, link, links, comment_guid, attachments array<struct<kind, url>>, html_img, html_gif, html_video).
    A message without a time has that of its download."""
    kinds = lambda *k: F.exists("attachments", lambda a: a.kind.isin(*k))
    gif = F.exists("attachments", lambda a: (a.kind == "image") & F.lower(a.url).rlike(r"\.gif($|\?)"))
    own = F.array("link")
    filled = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return messages.select(
        "guid", "subject", "author", F.coalesce("time", "dl_time").alias("time"), "dl_time", filled(own).alias("item_link"), filled(F.concat(own, F.col("links"))).alias("link"),
        F.col("comment_guid").isNotNull().alias("comment"), (F.col("html_img") | kinds("image")).alias("img"), (F.col("html_gif") | gif).alias("gif"), kinds("audio").alias("audio"),
        (F.col("html_video") | kinds("video", "video2", "iframe")).alias("video"), (F.size("attachments") > 0).alias("attachment"),
    )


def headers(messages: DataFrame, strip: Column) -> DataFrame:
    """Headers of messages: the comment's guid, else the post's, else the feed; stripped ones lose author, subject and text."""
    empty = lambda c: F.when(strip, F.lit("")).otherwise(F.col(c)).alias(c)
    return messages.select(F.coalesce("comment_guid", "post_guid", "feed").alias("guid"), empty("author"), empty("subject"), empty("short_text"), "time", "dl_time")


def client_rows(messages: DataFrame) -> DataFrame:
    """Items as mobile clients take them: numbers for flags, seconds for times, 0 for an id that is not given yet."""
    return messages.select(
        F.coalesce("surrogate", F.lit(0)).cast("long").alias("id"), "feed_id", F.col("subject").alias("title"), "author", F.coalesce("link", F.lit("")).alias("url"),
        F.coalesce(F.array_contains("tags", "starred"), F.lit(False)).cast("int").alias("is_saved"), F.coalesce("read", F.lit(False)).cast("int").alias("is_read"), F.unix_seconds(F.coalesce("time", "dl_time")).alias("created_on_time"),
    )


def is_private(url: Column, host: Column, own: str | None = None) -> Column:
    """Addresses that hold a key, a code or a password, those of a closed feed service, and those that contain ``own``,
    the beginning of a reader's own feeds."""
    low = F.lower(url)
    return low.contains("key=") | low.contains("code=") | url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*@") | host.endswith(".feedsportal.com") | F.lit(own is not None) & url.contains(own or "")


def is_public_host(host: Column) -> Column:
    found = F.lit(False)
    for h in PUBLIC_HOSTS:
        found = found | (host == h) | host.endswith("." + h)
    return found


def only_common_parts(path: Column) -> Column:
    """Whether a path and query have no part but those of COMMON_PARTS."""
    parts = F.split(F.lower(path), "[/.\\-_?=&]")
    return (path != "") & (F.size(F.array_except(parts, F.array(*map(F.lit, COMMON_PARTS)))) == 0)


def altered(table: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, write): what read-modify-write leaves of rows; a null in ``changes`` deletes, an equal value writes nothing."""
    new = changes.select(key, F.col(value).alias("_new"), F.lit(True).alias("_changed"))
    both = table.select(key, value).join(new, key, "full")
    changed = F.coalesce("_changed", F.lit(False))
    write = F.when(changed & ~F.col("_new").eqNullSafe(F.col(value)), F.when(F.col("_new").isNull(), "delete").otherwise("put")).otherwise("none")
    return both.select(key, F.when(changed, F.col("_new")).otherwise(F.col(value)).alias(value), write.alias("write"))


def tagged_copies(copies: DataFrame, tagged: DataFrame, messages: DataFrame) -> DataFrame:
    """Search copies (user, item, tags, subject) after tags change: tagged(user, item, tags) replaces what is there, items
    without tags lose their copy, items whose message is gone get none."""
    kept = copies.join(tagged.select("user", "item"), ["user", "item"], "left_anti").select("user", "item", "tags", "subject")
    return kept.unionByName(tagged.filter(F.size("tags") > 0).join(messages, "item").select("user", "item", "tags", "subject"))


def filter_statistics(users: DataFrame, filters: DataFrame) -> DataFrame:
    """(user, total, filters, streams, size, paid) of users with saved queries; a query's size is its feeds times its length."""
    size = F.col("feeds").cast("long") * F.length("query")
    sums = filters.groupBy("user").agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "filter").alias("filters"), F.count_if(F.col("kind") == "stream").alias("streams"), F.sum(size).alias("size"))
    return users.select("user", "paid").join(sums, "user").select("user", "total", "filters", "streams", "size", "paid")


def archived(users: DataFrame, now: datetime) -> DataFrame:
    """Users to archive: of no known state, 30 days past a trial or 60 past a payment, without saved queries, and not one
    of KEPT_USERS; users(user, state, till, queries)."""
    days = F.when(F.col("state").startswith("trial"), 30).otherwise(60)
    old = (F.col("state") == "unknown") | (F.unix_seconds(F.lit(now)) - F.unix_seconds("till") > days * 86400)
    return users.filter(old & (F.col("queries") == 0) & ~F.col("user").isin(*KEPT_USERS)).select("user")


def without_users(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A per-user table after accounts are deleted."""
    return table.join(gone.select("user"), "user", "left_anti")


def last_backups(backups: DataFrame, order: str) -> DataFrame:
    """The newest backup of each user."""
    n = F.row_number().over(Window.partitionBy("user").orderBy(F.col(order).desc()))
    return backups.withColumn("_n", n).filter("_n = 1").drop("_n")


def live_or_backup(live: DataFrame, backups: DataFrame, order: str) -> DataFrame:
    """Live users, and the newest backup of those that are not."""
    gone = last_backups(backups, order).join(live.select("user"), "user", "left_anti")
    return live.unionByName(gone.select(*live.columns))


def removed_feeds(old: DataFrame, subs: DataFrame, known: DataFrame) -> DataFrame:
    """(user, feed, title, link) of feeds that a restored user had: subscriptions(user, feed, title) that are among the
    known feeds(feed, link) come first, older entries stay beside them; without a title or link the address stands in."""
    new = subs.filter("feed <> ''").join(known, "feed").select("user", "feed", F.coalesce("title", "feed").alias("title"), F.coalesce("link", "feed").alias("link"))
    return new.unionByName(old.join(new.select("user", "feed"), ["user", "feed"], "left_anti").select("user", "feed", "title", "link"))


def welcome(users: DataFrame, backups: DataFrame, tagged: DataFrame) -> DataFrame:
    """What greets a user: an earlier account, subscriptions there, starred or tagged items from before the first sign-in.

    users(user, first_sign_in), backups(user, time, subscriptions), tagged(user, tag, time); "starred" is the star."""
    last = last_backups(backups, "time").select("user", F.lit(True).alias("_had"), (F.col("subscriptions") > 0).alias("_subs"))
    star = F.col("tag") == "starred"
    before = tagged.groupBy("user").agg(F.min(F.when(star, F.col("time"))).alias("_starred"), F.min(F.when(~star, F.col("time"))).alias("_tagged"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    first = F.col("first_sign_in")
    rows = users.join(last, "user", "left").join(before, "user", "left")
    return rows.select("user", yes(F.col("_had")).alias("had_account"), yes(F.col("_subs")).alias("had_subscriptions"), yes(F.col("_starred") < first).alias("starred_restored"), yes(F.col("_tagged") < first).alias("tagged_restored"))


def wanted_surrogates(items: DataFrame, now: Column) -> DataFrame:
    """Items that clients may ask for: unread, saved, or of the last thirty days; items(user, key, time, read, saved)."""
    recent = F.unix_seconds("time") > F.unix_seconds(now) - 30 * 86400
    return items.filter(~F.col("read") | F.col("saved") | recent).select("user", "key", "time").distinct()


def without_tags(tagged: DataFrame, listed: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Tagged items after tags are removed from all listed items (user, item) at once: the given ones, else all but the star."""
    hit = F.col("tag") != "starred" if tags is None else F.col("tag").isin(*tags)
    marked = tagged.join(listed.select("user", "item", F.lit(True).alias("_hit")).distinct(), ["user", "item"], "left")
    return marked.filter(F.col("_hit").isNull() | ~hit).drop("_hit")


def unread_messages(messages: DataFrame, read: DataFrame, ignored: DataFrame) -> DataFrame:
    """Messages (feed, post_idx, comment_idx, null for a post) that are neither read nor of an ignored post."""
    same = messages["feed"].eqNullSafe(read["feed"]) & (messages["post_idx"] == read["post_idx"]) & messages["comment_idx"].eqNullSafe(read["comment_idx"])
    return messages.join(read, same, "left_anti").join(ignored.select("feed", "post_idx"), ["feed", "post_idx"], "left_anti")


def unignored(ignored: DataFrame, read: DataFrame, marked: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ignored posts and read messages after messages (feed, post_idx, comment_idx) are marked unread.

    An ignored post that is marked, or has a marked comment, is ignored no more: all of its comments but the marked ones
    are read then, and the post itself too unless it was marked; counts(feed, post_idx, count) of comments."""
    key = ["feed", "post_idx"]
    freed = ignored.select(*key).join(marked.select(*key), key, "left_semi")
    comments = freed.join(counts, key).filter("count > 0").select(*key, F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("comment_idx"))
    now_read = comments.unionByName(freed.select(*key, F.lit(None).cast("int").alias("comment_idx")))
    rows = read.select(*key, "comment_idx").unionByName(now_read).distinct().alias("r")
    m = marked.alias("m")
    same = (F.col("r.feed") == F.col("m.feed")) & (F.col("r.post_idx") == F.col("m.post_idx")) & F.col("r.comment_idx").eqNullSafe(F.col("m.comment_idx"))
    return ignored.join(freed, key, "left_anti"), rows.join(m, same, "left_anti")


def removed_comments(posts: DataFrame, keep: int, deleted: DataFrame) -> DataFrame:
    """(feed, deleted): the counter of deleted comments after all but the newest ``keep`` posts go; a post has as many
    comments as its last version counts."""
    last = F.max("post_idx").over(Window.partitionBy("feed"))
    gone = posts.withColumn("_last", last).filter(F.col("post_idx") <= F.col("_last") - keep).groupBy("feed").agg(F.sum("comments").alias("_more"))
    return deleted.join(gone, "feed", "left").select("feed", (F.col("deleted") + F.coalesce("_more", F.lit(0))).cast("long").alias("deleted"))
