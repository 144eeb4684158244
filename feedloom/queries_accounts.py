"""Registered queries: messages as rows for search and clients, accounts, tags and unread state."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import accounts
from .queries import events, query, table

NOW = datetime(2024, 2, 1, tzinfo=UTC)

_ATTACHMENT = "CASE doc_id % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'iframe' WHEN 4 THEN 'image' END"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as messages: every third has no time, every fifth is a comment, every fourth has links."""
    d = table(spark, sf_dir, "documents")
    t = lambda c: F.timestamp_seconds(c)
    kind = F.expr(_ATTACHMENT)
    one = F.array(F.struct(kind.alias("kind"), F.concat(F.lit("http://h/"), "doc_id", F.expr("CASE WHEN doc_id % 7 = 4 THEN '.GIF?x' ELSE '.png' END")).alias("url")))
    return d.select(
        F.concat(F.lit("g"), "doc_id").alias("guid"), F.concat(F.lit("g"), "doc_id").alias("post_guid"), F.col("source").alias("feed"), F.col("lang").alias("subject"), F.concat(F.lit("a"), F.col("doc_id") % 11).alias("author"),
        F.when(F.expr("doc_id % 3 <> 0"), t(1_600_000_000 + F.col("doc_id"))).alias("time"), t(1_700_000_000 + F.col("doc_id")).alias("dl_time"), F.when(F.expr("doc_id % 6 <> 1"), F.concat(F.lit(" http://x/"), "doc_id")).alias("link"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN array(' ', concat('http://y/', doc_id, ' ')) ELSE CAST(array() AS ARRAY<STRING>) END").alias("links"), F.when(F.expr("doc_id % 5 = 0"), F.concat(F.lit("c"), "doc_id")).alias("comment_guid"),
        F.when(kind.isNotNull(), one).otherwise(F.filter(one, lambda a: F.lit(False))).alias("attachments"), F.expr("doc_id % 9 = 0").alias("html_img"), F.expr("doc_id % 10 = 0").alias("html_gif"), F.expr("doc_id % 8 = 0").alias("html_video"),
        F.concat(F.col("source"), F.lit(": "), F.col("lang")).alias("short_text"), "doc_id",
    )


@query("""SELECT 'g' || doc_id AS guid, lang AS subject, 'a' || doc_id % 11 AS author, CASE WHEN doc_id % 3 <> 0 THEN 1600000000 ELSE 1700000000 END + doc_id AS t, CASE WHEN doc_id % 6 <> 1 THEN 'http://x/' || doc_id ELSE '' END AS item_link,
concat_ws(' ', CASE WHEN doc_id % 6 <> 1 THEN 'http://x/' || doc_id END, CASE WHEN doc_id % 4 = 0 THEN 'http://y/' || doc_id END) AS link, doc_id % 5 = 0 AS comment, doc_id % 9 = 0 OR doc_id % 7 IN (0, 4) AS img, doc_id % 10 = 0 OR doc_id % 7 = 4 AS gif,
doc_id % 7 = 1 AS audio, doc_id % 8 = 0 OR doc_id % 7 IN (2, 3) AS video, doc_id % 7 < 5 AS attachment FROM documents""")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = accounts.search_rows(_messages(spark, sf_dir))
    return r.select("guid", "subject", "author", F.unix_seconds("time").alias("t"), F.array_join("item_link", " ").alias("item_link"), F.array_join("link", " ").alias("link"), "comment", "img", "gif", "audio", "video", "attachment")


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'c' ELSE 'g' END || doc_id AS guid, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'a' || doc_id % 11 END AS author, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS subject, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source || ': ' || lang END AS short_text FROM documents""")
def message_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.headers(_messages(spark, sf_dir), F.expr("doc_id % 2 = 0")).drop("time", "dl_time")


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 ELSE 0 END AS id, CAST(doc_id % 13 AS BIGINT) AS feed_id, lang AS title, 'a' || doc_id % 11 AS author, CASE WHEN doc_id % 6 <> 1 THEN ' http://x/' || doc_id ELSE '' END AS url,
CAST(doc_id % 4 = 0 AS INTEGER) AS is_saved, CAST(doc_id % 3 = 0 AS INTEGER) AS is_read, CASE WHEN doc_id % 3 <> 0 THEN 1600000000 ELSE 1700000000 END + doc_id AS created_on_time FROM documents""")
def client_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).withColumns({"surrogate": F.expr("CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 END"), "feed_id": F.col("doc_id") % 13, "tags": F.expr("CASE doc_id % 4 WHEN 0 THEN array('a', 'starred') WHEN 1 THEN array('a') END"), "read": F.expr("CASE WHEN doc_id % 3 = 0 THEN true END")})
    return accounts.client_rows(m)


_ADDRESS = "CASE page_id % 8 WHEN 0 THEN concat('http://u:p@h.example/', page_id) WHEN 1 THEN 'http://x.feedburner.com/abc' WHEN 2 THEN 'http://a.feedsportal.com/b' WHEN 3 THEN 'http://h.example/Feed.xml?KEY=1' WHEN 4 THEN 'http://h.example/blog/index.php' WHEN 5 THEN 'http://reader.example/feed/7' WHEN 6 THEN 'http://notvk.com/a' ELSE url END"
_HOST = r"lower(regexp_extract({}, '^[a-zA-Z]+://([^/?#]*@)?([^/?#:]*)', 2))"


@query(f"""WITH p AS (SELECT page_id, {_ADDRESS} AS u FROM pages), h AS (SELECT *, {_HOST.format('u')} AS host, regexp_extract(u, '^[a-zA-Z]+://[^/?#]*(.*)$', 1) AS path FROM p)
SELECT page_id, contains(lower(u), 'key=') OR contains(lower(u), 'code=') OR regexp_matches(u, '^[a-zA-Z]+://[^/?#]*@') OR ends_with(host, '.feedsportal.com') OR contains(u, 'reader.example/feed/') AS private,
regexp_matches(host, '(^|\\.)({'|'.join(h.replace('.', '[.]') for h in accounts.PUBLIC_HOSTS)})$') AS public_host, path <> '' AND len(list_filter(regexp_split_to_array(lower(path), '[/.\\-_?=&]'), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in accounts.COMMON_PARTS)}))) = 0 AS common FROM h""")
def feed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_ADDRESS).alias("u")).withColumns({"host": F.expr(_HOST.format("u")), "path": F.regexp_extract("u", "^[a-zA-Z]+://[^/?#]*(.*)$", 1)})
    return p.select("page_id", accounts.is_private(F.col("u"), F.col("host"), "reader.example/feed/").alias("private"), accounts.is_public_host(F.col("host")).alias("public_host"), accounts.only_common_parts(F.col("path")).alias("common"))


@query("""SELECT c_custkey AS "key", CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_name WHEN 2 THEN 'new' ELSE c_name END AS "value", CASE c_custkey % 4 WHEN 0 THEN 'delete' WHEN 2 THEN 'put' ELSE 'none' END AS "write" FROM customer
UNION ALL SELECT -n_nationkey - 1, n_name, 'put' FROM nation""")
def altered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the keys is deleted, one written as it was, one changed, one not named; nations are new keys."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    named = c.filter("key % 4 < 3").withColumn("value", F.expr("CASE key % 4 WHEN 1 THEN value WHEN 2 THEN 'new' END"))
    new = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("key"), F.col("n_name").alias("value"))
    return accounts.altered(c, named.unionByName(new), "key", "value")


@query("""SELECT o_custkey AS "user", o_orderkey AS item, 'old' AS tags, o_orderstatus AS subject FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""")
def tagged_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("subject"), F.array("o_orderpriority").alias("given"))
    changed = o.filter("item % 3 = 0").select("user", "item", F.expr("CASE WHEN item % 2 = 0 THEN given ELSE CAST(array() AS ARRAY<STRING>) END").alias("tags"))
    out = accounts.tagged_copies(o.withColumn("tags", F.array(F.lit("old"))), changed, o.filter("item % 5 <> 0").select("item", "subject"))
    return out.withColumn("tags", F.array_join("tags", ","))


@query("""SELECT c_custkey AS "user", count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS filters, count(*) FILTER (o_orderkey % 2 = 1) AS streams, CAST(sum((o_orderkey % 10) * length(o_orderpriority)) AS BIGINT) AS size, c_acctbal > 0 AS paid FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal""")
def filter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), (F.col("c_acctbal") > 0).alias("paid"))
    return accounts.filter_statistics(users, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'filter' ELSE 'stream' END").alias("kind"), (F.col("o_orderkey") % 10).alias("feeds"), F.col("o_orderpriority").alias("query")))


_GONE = "c_custkey % 5 <> 0 AND c_custkey <> 7 AND (c_custkey % 3 = 0 OR c_custkey % 100 > CASE WHEN c_custkey % 3 = 1 THEN 30 ELSE 60 END)"


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(
        F.expr("CASE WHEN c_custkey = 7 THEN 'demo' ELSE CAST(c_custkey AS STRING) END").alias("user"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'trial' ELSE 'paid' END").alias("state"),
        F.timestamp_seconds(F.lit(int(NOW.timestamp())) - (F.col("c_custkey") % 100) * 86400).alias("till"), F.expr("CAST(c_custkey % 5 = 0 AS INT)").alias("queries"),
    )
    return accounts.archived(users, NOW)


@query(f"""SELECT c_custkey::VARCHAR AS "user" FROM customer WHERE {_GONE}""")
def archived_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gone(spark, sf_dir)


@query(f"""SELECT o_custkey::VARCHAR AS "user", o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE {_GONE})""")
def kept_after_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.without_users(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("user"), "o_orderkey"), _gone(spark, sf_dir))


@query("""SELECT c_custkey AS "user", 'live' AS state FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, 'o' || max(o_orderkey) FROM orders WHERE o_custkey % 2 = 1 GROUP BY o_custkey""")
def live_or_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user"), F.lit("live").alias("state"))
    return accounts.live_or_backup(live, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.concat(F.lit("o"), "o_orderkey").alias("state"), "o_orderkey"), "o_orderkey")


_NEW = "o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"


@query(f"""SELECT o_custkey AS "user", 'f' || o_orderkey AS feed, CASE WHEN {_NEW} THEN CASE WHEN o_orderkey % 5 = 0 THEN 'f' || o_orderkey ELSE o_orderstatus END ELSE 'old' END AS title, CASE WHEN {_NEW} THEN 'l' || o_orderkey ELSE 'x' END AS link FROM orders WHERE {_NEW} OR o_orderkey % 7 < 3""")
def removed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"user": F.col("o_custkey"), "feed": F.concat(F.lit("f"), "o_orderkey")})
    old = o.filter("o_orderkey % 7 < 3").select("user", "feed", F.lit("old").alias("title"), F.lit("x").alias("link"))
    subs = o.filter("o_orderkey % 2 = 0").select("user", "feed", F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END").alias("title"))
    return accounts.removed_feeds(old, subs, o.filter("o_orderkey % 3 <> 0").select("feed", F.concat(F.lit("l"), "o_orderkey").alias("link")))


@query("""WITH b AS (SELECT o_custkey AS u, arg_max(o_orderkey % 2, o_orderkey) AS s FROM orders GROUP BY 1), t AS (SELECT user_id AS u, min(ts) FILTER (event_type = 'click') AS a, min(ts) FILTER (event_type <> 'click') AS z FROM events GROUP BY 1), m AS (SELECT min(ts) + to_days(3) AS f FROM events)
SELECT c_custkey AS "user", b.u IS NOT NULL AS had_account, coalesce(b.s > 0, false) AS had_subscriptions, coalesce(a < f, false) AS starred_restored, coalesce(z < f, false) AS tagged_restored FROM customer LEFT JOIN b ON b.u = c_custkey LEFT JOIN t ON t.u = c_custkey, m""")
def welcome_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.agg((F.min("ts") + F.expr("INTERVAL 3 DAYS")).alias("first_sign_in"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user")).join(F.broadcast(first))  # one row
    backups = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("time"), (F.col("o_orderkey") % 2).alias("subscriptions"))
    return accounts.welcome(users, backups, e.select(F.col("user_id").alias("user"), F.expr("CASE event_type WHEN 'click' THEN 'starred' ELSE event_type END").alias("tag"), F.col("ts").alias("time")))


@query("""SELECT user_id AS "user", event_id AS "key" FROM events, (SELECT max(ts) AS now FROM events) WHERE event_id % 3 <> 0 OR event_type = 'click' OR floor(epoch(ts)) > floor(epoch(now)) - 2592000""")
def wanted_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    items = e.select(F.col("user_id").alias("user"), F.col("event_id").alias("key"), F.col("ts").alias("time"), F.expr("event_id % 3 = 0").alias("read"), F.expr("event_type = 'click'").alias("saved"))
    return accounts.wanted_surrogates(items.join(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("now")).select("user", "key")


@query("""SELECT user_id AS "user", event_id AS item, event_type AS tag FROM events WHERE event_id % 4 <> 0 OR event_type NOT IN ('click', 'view')""")
def untagged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = events(spark, sf_dir).select(F.col("user_id").alias("user"), F.col("event_id").alias("item"), F.col("event_type").alias("tag"))
    return accounts.without_tags(t, t.filter("item % 4 = 0"), ["click", "view"])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: turn 0 is the post, turn n its comment n - 1."""
    return table(spark, sf_dir, "conversations").select(F.lit("f").alias("feed"), F.col("conv_id").alias("post_idx"), F.expr("CASE WHEN turn > 0 THEN CAST(turn - 1 AS INT) END").alias("comment_idx"), "turn")


@query("""SELECT conv_id AS post_idx, CASE WHEN turn > 0 THEN CAST(turn - 1 AS INTEGER) END AS comment_idx FROM conversations WHERE (conv_id + turn) % 3 <> 0 AND conv_id % 4 <> 0""")
def unread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _turns(spark, sf_dir).select("feed", "post_idx", "comment_idx", "turn")
    read = m.filter("(post_idx + turn) % 3 = 0").drop("turn")
    return accounts.unread_messages(m.drop("turn"), read, m.filter("post_idx % 4 = 0 AND turn = 0")).select("post_idx", "comment_idx")


@query("""SELECT conv_id AS post_idx, CASE WHEN turn > 0 THEN CAST(turn - 1 AS INTEGER) END AS comment_idx FROM conversations WHERE conv_id % 4 = 0 AND conv_id % 3 <> 0 AND turn <> conv_id % 3""")
def unignored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post or comment is marked unread in two thirds of the ignored conversations."""
    m = _turns(spark, sf_dir)
    counts = m.groupBy("feed", "post_idx").agg(F.max("turn").alias("count"))
    ignored, nothing = m.filter("post_idx % 4 = 0 AND turn = 0").select("feed", "post_idx"), m.filter("false").drop("turn")
    marked = counts.filter("post_idx % 3 <> 0").select("feed", "post_idx", (F.col("post_idx") % 3 - 1).cast("int").alias("comment_idx"))
    return accounts.unignored(ignored, nothing, marked, counts)[1].select("post_idx", "comment_idx")


@query("""WITH p AS (SELECT source, doc_id % 6 AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source AS feed, CAST(3 + coalesce(sum(c) FILTER (i < n - 10), 0) AS BIGINT) AS deleted FROM p GROUP BY 1""")
def removed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import model

    p = model.post_index(table(spark, sf_dir, "documents")).select(F.col("source").alias("feed"), "post_idx", (F.col("doc_id") % 6).alias("comments"))
    return accounts.removed_comments(p, 10, p.select("feed").distinct().withColumn("deleted", F.lit(3)))
