"""Feed masks: which posts and comments of a feed a saved query lets through.

Tables: ``masks`` (owner, feed, state, expanded) has one row per owner and feed; ``mask_posts`` (owner, feed, post_idx)
the posts that match; ``mask_comments`` (owner, feed, post_idx, idx) the comments that match where expanded. A collapsed
mask (expanded false) lets a post decide for its comments; an expanded one without comment rows lets none through; an
error absorbs whatever it meets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_matches(posts: DataFrame, queries: list[dict]) -> DataFrame:
    """(query_id, feed, post_idx) for saved queries {id, predicate, negate, feeds}: negate turns the text's meaning
    round inside the listed feeds only. One scan answers all queries; nothing is joined."""
    hits = [F.when(_applies(q), F.lit(q["id"])) for q in queries]
    if not hits:
        return posts.select(F.lit(None).cast("int").alias("query_id"), "feed", "post_idx").limit(0)
    return posts.select("feed", "post_idx", F.explode(F.array_compact(F.array(*hits))).alias("query_id")).select("query_id", "feed", "post_idx")


def _applies(q: dict) -> Column:
    p = ~q["predicate"] if q.get("negate") else q["predicate"]
    return p & F.col("feed").isin(q["feeds"])


def _covering(queries: list[dict]) -> Column:
    """How many filters list the row's feed."""
    return reduce(lambda a, b: a + b, [F.col("feed").isin(q["feeds"]).cast("int") for q in queries], F.lit(0))


def globally_visible(posts: DataFrame, filters: list[dict]) -> DataFrame:
    """Posts that pass every filter that mentions their feed; feeds in no filter are unaffected."""
    passed = reduce(lambda a, b: a + b, [_applies(q).cast("int") for q in filters], F.lit(0))
    return posts.filter(passed == _covering(filters))


def stream_matches(posts: DataFrame, streams: list[dict], filters: list[dict]) -> DataFrame:
    """A stream's own matches among what the filters leave."""
    return query_matches(globally_visible(posts, filters), streams)


def intersect(masks: DataFrame, posts: DataFrame, comments: DataFrame, left: str, right: str, owner: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The masks of two owners met feed by feed, as new tables of ``owner``; feeds that only one has are left out."""
    a, b = (masks.filter(F.col("owner") == o).select("feed", F.col("state").alias(f"s{n}"), F.col("expanded").alias(f"e{n}")) for n, o in enumerate((left, right)))
    both = a.join(b, "feed")
    error = (F.col("s0") == "error") | (F.col("s1") == "error")
    made = both.select(F.lit(owner).alias("owner"), "feed", F.when(error, "error").otherwise("ok").alias("state"), (~error & (F.col("e0") | F.col("e1"))).alias("expanded"))
    ok = both.filter(~error)
    pa, pb = (posts.filter(F.col("owner") == o).select("feed", "post_idx") for o in (left, right))
    post = ok.select("feed").join(pa, "feed").join(pb, ["feed", "post_idx"]).select(F.lit(owner).alias("owner"), "feed", "post_idx")
    ca, cb = (comments.filter(F.col("owner") == o).select("feed", "post_idx", "idx") for o in (left, right))
    two = ok.filter("e0 AND e1").select("feed").join(ca.join(cb, ["feed", "post_idx", "idx"]), "feed")
    one = ok.filter("e0 AND NOT e1").select("feed").join(ca.join(pb, ["feed", "post_idx"]), "feed")
    other = ok.filter("NOT e0 AND e1").select("feed").join(cb.join(pa, ["feed", "post_idx"]), "feed")
    comment = two.unionByName(one).unionByName(other).select(F.lit(owner).alias("owner"), "feed", "post_idx", "idx")
    return made, post, comment


def unite(masks: DataFrame, posts: DataFrame, comments: DataFrame, left: str, right: str, owner: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Either owner's; where one is collapsed the other's comments stand."""
    own = masks.filter(F.col("owner").isin(left, right))
    made = own.groupBy("feed").agg(F.when(F.bool_or(F.col("state") == "error"), "error").otherwise("ok").alias("state"), F.bool_or("expanded").alias("expanded"))
    made = made.select(F.lit(owner).alias("owner"), "feed", "state", (F.col("expanded") & (F.col("state") == "ok")).alias("expanded"))
    good = made.filter("state = 'ok'").select("feed")
    pick = lambda t, *k: t.filter(F.col("owner").isin(left, right)).join(good, "feed", "left_semi").select(F.lit(owner).alias("owner"), "feed", *k).distinct()
    return made, pick(posts, "post_idx"), pick(comments, "post_idx", "idx")


def comment_visible(comments: DataFrame, masks: DataFrame, posts: DataFrame, mask_comments: DataFrame, owner: str) -> DataFrame:
    """Adds ``visible``: a collapsed mask's post decides, an expanded mask's comments speak for themselves."""
    m = masks.filter((F.col("owner") == owner) & (F.col("state") == "ok")).select("feed", "expanded")
    p = posts.filter(F.col("owner") == owner).select("feed", "post_idx", F.lit(True).alias("_p"))
    c = mask_comments.filter(F.col("owner") == owner).select("feed", "post_idx", "idx", F.lit(True).alias("_c"))
    out = comments.join(m, "feed", "left").join(p, ["feed", "post_idx"], "left").join(c, ["feed", "post_idx", "idx"], "left")
    shown = F.when(F.col("expanded"), F.col("_c")).otherwise(F.col("_p"))
    return out.withColumn("visible", F.coalesce(shown, F.lit(False))).drop("expanded", "_p", "_c")


def clamped(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Drops what retention has evicted; a feed whose posts are all gone keeps none."""
    return items.join(feeds.select("feed", F.least("lo", F.col("hi") + 1).alias("_lo")), "feed").filter(F.col("post_idx") >= F.col("_lo")).drop("_lo")


def unread(items: DataFrame, read: DataFrame) -> DataFrame:
    """Posts that are neither read nor ignored; read(feed, kind, lo, hi) holds ranges."""
    from . import ranges

    gone = ranges.canonical(read.filter(F.col("kind").isin("post", "ignored")).select("feed", "lo", "hi"), ["feed"])
    return ranges.member(items, gone, ["feed"], "post_idx", "_read").filter("NOT _read").drop("_read")


def overlaid(posts: DataFrame, visible: DataFrame, read: DataFrame) -> DataFrame:
    """Read state with everything that the masks hide counted as read: ranges (feed, lo, hi)."""
    from . import ranges

    hidden = posts.select("feed", "post_idx").join(visible.select("feed", "post_idx"), ["feed", "post_idx"], "left_anti")
    return ranges.union(read.filter("kind = 'post'").select("feed", "lo", "hi"), ranges.from_items(hidden, ["feed"], "post_idx"), ["feed"])


def resolved(feeds: DataFrame, explicit: DataFrame, streams: DataFrame, filters: DataFrame, has_stream: bool) -> DataFrame:
    """Which mask applies to a feed: an explicit one, else (in a stream) the stream's or an empty one, else the filters'."""
    e, s, f = (t.select("feed", F.lit(n).alias(n)) for t, n in ((explicit, "explicit"), (streams, "stream"), (filters, "filter")))
    out = feeds.select("feed").join(e, "feed", "left").join(s, "feed", "left").join(f, "feed", "left")
    rest = F.coalesce("stream", F.lit("empty")) if has_stream else F.coalesce("filter", F.lit("all"))
    return out.select("feed", F.coalesce("explicit", rest).alias("mask"))


def appended(old: DataFrame, new: DataFrame, edited: DataFrame, feeds: DataFrame) -> DataFrame:
    """Incremental refresh of one query's matches: old ones without edited feeds and evicted posts, and the new ones."""
    kept = clamped(old.join(edited.select("feed"), "feed", "left_anti"), feeds)
    return kept.select("feed", "post_idx").unionByName(new.select("feed", "post_idx")).distinct()


def edited_feeds(before: DataFrame, after: DataFrame) -> DataFrame:
    """Feeds whose set of saved queries changed; both tables (feed, query_id)."""
    a = before.groupBy("feed").agg(F.sort_array(F.collect_set("query_id")).alias("a"))
    b = after.groupBy("feed").agg(F.sort_array(F.collect_set("query_id")).alias("b"))
    return a.join(b, "feed", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("feed")


def widened(query_feeds: DataFrame, subscriptions: DataFrame, new_feeds: DataFrame) -> DataFrame:
    """New feeds join each query that lists more than half of its user's feeds; tables (user, query_id, feed), (user, feed)."""
    total = subscriptions.groupBy("user").agg(F.count_distinct("feed").alias("_all"))
    most = query_feeds.groupBy("user", "query_id").agg(F.count_distinct("feed").alias("_n")).join(total, "user").filter("2 * _n > _all")
    return query_feeds.unionByName(most.join(new_feeds, "user").select("user", "query_id", "feed")).distinct()


def from_hits(hits: DataFrame, posts: DataFrame, comments: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search hits by guid as mask rows: (feed, post_idx) and (feed, post_idx, idx).

    hits(feed, post_guid, comment_guid); posts(feed, post_idx, guid, total) and comments(feed, post_idx, idx, guid) are
    what is known now; versions(feed, post_idx, count) bounds a post's comments as of then. Where a post has as many
    hits as comments, all of its comments match without being looked up."""
    known = posts.filter("post_idx < total").select("feed", F.col("guid").alias("post_guid"), "post_idx")
    own = hits.join(known, ["feed", "post_guid"])
    matched = own.filter("comment_guid IS NULL").select("feed", "post_idx").distinct()
    below = own.filter("comment_guid IS NOT NULL").join(versions, ["feed", "post_idx"])
    some = below.groupBy("feed", "post_idx", "count").agg(F.count_distinct("comment_guid").alias("_n"))
    whole = some.filter((F.col("_n") >= F.col("count")) & (F.col("count") > 0)).select("feed", "post_idx", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("idx"))
    part = some.filter(F.col("_n") < F.col("count")).select("feed", "post_idx")
    looked = below.join(part, ["feed", "post_idx"], "left_semi").join(comments.select("feed", "post_idx", "idx", F.col("guid").alias("comment_guid")), ["feed", "post_idx", "comment_guid"])
    found = looked.filter(F.col("idx") < F.col("count")).select("feed", "post_idx", "idx").distinct()
    return matched, whole.withColumn("idx", F.col("idx").cast("int")).unionByName(found.withColumn("idx", F.col("idx").cast("int")))


def comment_ranges(posts: DataFrame, ignored: DataFrame) -> DataFrame:
    """All comments of posts that are not ignored as ranges (feed, post_idx, lo, hi); posts(feed, post_idx, comments)."""
    kept = posts.join(ignored.select("feed", "post_idx"), ["feed", "post_idx"], "left_anti").filter("comments > 0")
    return kept.select("feed", "post_idx", F.lit(0).cast("long").alias("lo"), (F.col("comments") - 1).cast("long").alias("hi"))


#: Saved queries that a user may have.
MOST_QUERIES = 500


def save_query(saved: DataFrame, new: DataFrame) -> DataFrame:
    """saved and new (user, query, negate, feeds): the same text and sense is one query with the feeds of both; a user's
    queries beyond the first MOST_QUERIES are not taken."""
    from pyspark.sql import Window

    rows = saved.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    one = rows.groupBy("user", "query", "negate").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("feeds")))).alias("feeds"), F.min("_new").alias("_new"))
    place = F.row_number().over(Window.partitionBy("user").orderBy("_new", "query", "negate"))
    return one.withColumn("_n", place).filter((F.col("_new") == 0) | (F.col("_n") <= MOST_QUERIES)).drop("_new", "_n")


def without_feeds(saved_feeds: DataFrame, removed: DataFrame) -> DataFrame:
    """(user, query_id, feed) without feeds that are no longer read; queries without feeds are gone with their rows."""
    return saved_feeds.join(removed.select("user", "feed"), ["user", "feed"], "left_anti")
