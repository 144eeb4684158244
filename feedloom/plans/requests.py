"""What a caller can ask for: listings, searches, tags, counters and the sidebar, as one DataFrame each.

``Reader`` binds the tables of one user; nothing is computed until a result is used.

posts(feed, feed_id, post_idx, time, words, ...), feeds(feed, lo, hi), read(feed, kind, lo, hi), subscriptions(feed,
title, folders), tagged(item_id, tag, tag_time, feed, feed_id, post_idx), filters and streams as in ``masks``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import actions, counters, listing, masks, ranges
from . import textquery

#: Stream selections of the item API.
ALL, STARRED, READ = "user/-/state/com.google/reading-list", "user/-/state/com.google/starred", "user/-/state/com.google/read"
LABEL, FEED = "user/-/label/", "feed/"
#: Seconds by which an API's lower time bound is moved back.
SLACK = 180
MOST_CONTENTS = 10_000


@dataclass
class Page:
    """How a listing is shown."""

    size: int = listing.PAGE
    descending: bool = True
    unread_only: bool = False
    after: tuple | None = None  # (time, feed_id, post_idx) of the last item seen
    since: datetime | None = None
    until: datetime | None = None


@dataclass
class Selection:
    """An API stream: what to include, what to leave out, and bounds."""

    streams: list[str] = field(default_factory=lambda: [ALL])
    without: list[str] = field(default_factory=list)
    only: list[str] = field(default_factory=list)
    n: int | None = None
    ascending: bool = False
    older: int | None = None  # ot, seconds
    newer: int | None = None  # nt


class MaskError(RuntimeError):
    pass


@dataclass
class Reader:
    posts: DataFrame
    feeds: DataFrame
    read: DataFrame
    subscriptions: DataFrame
    tagged: DataFrame
    fields: textquery.Fields
    filters: list[dict] = field(default_factory=list)
    streams: dict[str, dict] = field(default_factory=dict)
    mask_errors: DataFrame | None = None  # owner, feed

    # --- what is visible

    def _compiled(self, q: dict) -> dict:
        return q | {"predicate": textquery.compiled(q["query"], self.fields)}

    def visible(self, feeds: list[str] | None = None) -> DataFrame:
        """Retained posts that pass the filters, of some feeds or all."""
        rows = self.posts if feeds is None else self.posts.filter(F.col("feed").isin(feeds))
        return masks.clamped(masks.globally_visible(rows, [self._compiled(q) for q in self.filters]), self.feeds)

    def with_state(self, rows: DataFrame) -> DataFrame:
        """Adds ``read``: read, ignored, or no longer retained."""
        gone = ranges.canonical(self.read.filter(F.col("kind").isin("post", "ignored")).select("feed", "lo", "hi"), ["feed"])
        return ranges.member(rows, gone, ["feed"], "post_idx", "read")

    def _page(self, rows: DataFrame, page: Page) -> DataFrame:
        if page.since is not None:
            rows = rows.filter(F.col("time") >= F.lit(page.since))
        if page.until is not None:
            rows = rows.filter(F.col("time") < F.lit(page.until))
        rows = self.with_state(rows)
        if page.unread_only:
            rows = rows.filter("NOT read")
        return listing.merged(rows, page.size, page.descending, page.after)

    # --- listings

    def folder_feeds(self, folder: str) -> DataFrame:
        return self.subscriptions.filter(F.array_contains("folders", folder)).select("feed")

    def feed(self, feed: str, page: Page | None = None) -> DataFrame:
        return self._page(self.visible([feed]), page or Page())

    def folder(self, folder: str | None, page: Page | None = None) -> DataFrame:
        """A folder's feeds merged by time; None is all of them."""
        rows = self.visible()
        chosen = self.subscriptions.select("feed") if folder is None else self.folder_feeds(folder)
        return self._page(rows.join(chosen, "feed", "left_semi"), page or Page())

    def stream_matches(self, name: str) -> DataFrame:
        q = self._compiled(self.streams[name])
        return self.visible(q["feeds"]).filter(~q["predicate"] if q["negate"] else q["predicate"])

    def stream(self, name: str, page: Page | None = None) -> DataFrame:
        return self._page(self.stream_matches(name), page or Page())

    def search(self, query: str, feeds: list[str] | None = None, within: str | None = None, page: Page | None = None) -> DataFrame:
        """Text search in feeds, or in a saved stream."""
        rows = self.stream_matches(within) if within else self.visible(feeds)
        return self._page(rows.filter(textquery.compiled(query, self.fields)), page or Page())

    def search_totals(self, query: str, feeds: list[str] | None = None) -> DataFrame:
        rows = self.with_state(self.visible(feeds).filter(textquery.compiled(query, self.fields)))
        return rows.agg(F.count("*").alias("total"), F.count_if(~F.col("read")).alias("unread"))

    def tag(self, tag: str | None, snapshot: datetime, page: Page | None = None) -> DataFrame:
        """Items of a tag by tagging time; None is every tag but those items that are only starred."""
        p = page or Page()
        rows = self.tagged
        if tag is None:
            starred_only = rows.groupBy("item_id").agg(F.collect_set("tag").alias("_t")).filter("_t = array('starred')")
            rows = rows.join(starred_only, "item_id", "left_anti")
        else:
            rows = rows.filter(F.col("tag") == tag)
        return listing.tag_listing(rows, snapshot, not p.descending, p.since, p.until).limit(p.size)

    def tag_search(self, query: str, tag: str, snapshot: datetime, page: Page | None = None) -> DataFrame:
        hits = self.posts.filter(textquery.compiled(query, self.fields)).select("feed", "post_idx")
        p = page or Page()
        return listing.tag_listing(self.tagged.filter(F.col("tag") == tag).join(hits, ["feed", "post_idx"], "left_semi"), snapshot, not p.descending, p.since, p.until).limit(p.size)

    # --- counters

    def sidebar(self) -> DataFrame:
        """kind, name, total, unread of every feed, folder, stream and tag."""
        state = self.with_state(self.visible())
        per_feed = counters.feed_counters(state).join(self.subscriptions.select("feed", "title", "folders"), "feed")
        feeds = per_feed.select(F.lit("feed").alias("kind"), F.col("feed").alias("name"), "total", (F.col("total") - F.col("read")).alias("unread"))
        rolled = counters.folder_rollup(per_feed.withColumns({"expanded": F.lit(False), "comments": F.lit(0)}))
        folders = rolled.select(F.when(F.col("folder").isNull(), "all").otherwise("folder").alias("kind"), F.coalesce("folder", F.lit("")).alias("name"), "total", (F.col("total") - F.col("read")).alias("unread"))
        out = feeds.unionByName(folders)
        for name in self.streams:
            rows = self.with_state(self.stream_matches(name))
            out = out.unionByName(rows.agg(F.count("*").alias("total"), F.count_if(~F.col("read")).alias("unread")).select(F.lit("stream").alias("kind"), F.lit(name).alias("name"), "total", "unread"))
        t = counters.tag_counters(self.tagged.select("tag", "feed", "post_idx", F.lit(None).cast("int").alias("comment_idx"), F.lit(False).alias("expanded")), state.select("feed", "post_idx", "read"))
        return out.unionByName(t.select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), "total", (F.col("total") - F.col("read")).alias("unread")))

    def unread_counts(self) -> DataFrame:
        return self.sidebar().filter("unread > 0")

    # --- item API

    def select(self, s: Selection) -> DataFrame:
        """Posts of an API selection in order, without limit."""
        rows = self.visible()
        chosen = None
        for x in s.streams:
            part = self._stream_rows(rows, x)
            chosen = part if chosen is None else chosen.unionByName(part)
        chosen = chosen.dropDuplicates(["feed", "post_idx"])
        for x in s.only:
            chosen = chosen.join(self._stream_rows(rows, x).select("feed", "post_idx"), ["feed", "post_idx"], "left_semi")
        for x in s.without:
            chosen = chosen.join(self._stream_rows(rows, x).select("feed", "post_idx"), ["feed", "post_idx"], "left_anti")
        if s.older is not None:
            chosen = chosen.filter(F.unix_seconds("time") >= s.older - SLACK)
        if s.newer is not None:
            chosen = chosen.filter(F.unix_seconds("time") < s.newer)
        return chosen

    def _stream_rows(self, rows: DataFrame, x: str) -> DataFrame:
        if x == ALL:
            return rows.join(self.subscriptions.select("feed"), "feed", "left_semi")
        if x == READ:
            return self.with_state(rows).filter("read").drop("read")
        if x == STARRED:
            return rows.join(self.tagged.filter("tag = 'starred'").select("feed", "post_idx"), ["feed", "post_idx"], "left_semi")
        if x.startswith(FEED):
            return rows.filter(F.col("feed") == x[len(FEED) :])
        name = x.removeprefix(LABEL)
        if name in self.streams:
            return self.stream_matches(name)
        tagged = rows.join(self.tagged.filter(F.col("tag") == name).select("feed", "post_idx").distinct(), ["feed", "post_idx"], "left_semi")
        return tagged.unionByName(rows.join(self.folder_feeds(name), "feed", "left_semi")).dropDuplicates(["feed", "post_idx"])

    def item_ids(self, s: Selection) -> DataFrame:
        rows = self.select(s).select("feed_id", "post_idx", "time", ids.pack(F.col("feed_id"), F.col("post_idx")).alias("item_id"))
        order = [F.col("time"), F.col("feed_id").desc()] if s.ascending else [F.col("time").desc(), F.col("feed_id")]
        return rows.orderBy(*order, F.col("post_idx") if s.ascending else F.col("post_idx").desc()).limit(listing.limit_of(s.n, bodies=False))

    def contents(self, items: DataFrame) -> DataFrame:
        """items(item_id) -> their posts; ids of posts that are gone are left out."""
        wanted = items.orderBy("item_id").limit(MOST_CONTENTS).select("item_id", ids.unpack(F.col("item_id")).alias("_i")).select("item_id", F.col("_i.feed").alias("feed_id"), F.col("_i.post").alias("post_idx"))
        return self.posts.withColumns({"feed_id": F.col("feed_id").cast("long"), "post_idx": F.col("post_idx").cast("long")}).join(wanted, ["feed_id", "post_idx"])

    def public_feed(self, s: Selection) -> DataFrame:
        """The newest twenty of a selection, for a public feed."""
        return listing.merged(self.select(s), listing.DEFAULT)

    def mark_all_read(self, s: Selection, before: datetime | None = None) -> DataFrame:
        """The read ranges (feed, lo, hi) after all of a selection is read."""
        now = self.read.filter("kind = 'post'").select("feed", "lo", "hi")
        return actions.mark_feed_read(self.select(s), now, older_than=before)

    # --- errors

    def check(self, owner: str, feeds: list[str] | None = None) -> None:
        """Raises if a stream's, or with some of the feeds a filter's, masks are in error."""
        if self.mask_errors is None:
            return
        bad = self.mask_errors.filter(F.col("owner") == owner)
        if feeds is not None:
            bad = bad.filter(F.col("feed").isin(feeds))
        if first := bad.limit(1).collect():
            raise MaskError(f"{owner}: the search of {first[0]['feed']} failed")


def refresh_mode(now: datetime, updated: datetime | None, took: timedelta, queries: int, time_based: bool, edited: bool) -> str:
    """Whether a saved query's masks are refreshed in full, for edited feeds only, for new posts only, or not yet."""
    if updated is None or time_based:
        return "full"
    if edited:
        return "edited"
    return "incremental" if now - updated >= timedelta(seconds=90 + 2 * queries) + 3 * took else "none"
