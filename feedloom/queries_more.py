"""Registered queries: actions, catalogue, merge rules, ordered analytics, rollups, scalar functions, sources, streams."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates, ids, langdetect, text, url
from .operators import state as states
from .operators import actions, catalog, lookup, masks, merge, ordered, ranges, rollups, schedule, trees
from .queries import _POSTS, _tree, events, posts, query, table
from .sources import feeds as feed_sources
from .sources import sinks
from .streaming import upsert

NOW = datetime(2024, 2, 1, tzinfo=UTC)

# --- actions: events as user actions


def _islands(rel: str) -> str:
    return f"SELECT k, CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM ({rel})) GROUP BY k, g"


@query("""SELECT user_id AS "user", event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p""")
def coalesced_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("user_id", "user")
    return actions.coalesced(e, ["event_type"], "event_id").select("user", "event_id")


@query("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id AS "user", event_id, CAST(sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM l""")
def action_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("user_id", "user")
    return actions.runs(e, "event_type", "event_id").select("user", "event_id", "run")


@query(f"""WITH last AS (SELECT user_id AS k, event_id % 200 AS x, arg_max(event_type <> 'error', event_id) AS r FROM events WHERE event_id % 3 > 0 GROUP BY ALL),
base AS (SELECT DISTINCT user_id AS k, event_id % 200 AS x FROM events WHERE event_id % 3 = 0)
{_islands('SELECT k, x FROM base WHERE (k, x) NOT IN (SELECT k, x FROM last WHERE NOT r) UNION SELECT k, x FROM last WHERE r')}""")
def marked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("k"), (F.col("event_id") % 200).alias("x"), "event_id", (F.col("event_type") != "error").alias("read"))
    return actions.mark_read(ranges.from_items(e.filter("event_id % 3 = 0"), ["k"], "x"), e.filter("event_id % 3 > 0"), ["k"], "x", "event_id")


@query(f"""WITH {_POSTS} SELECT k AS feed, lo, hi FROM ({_islands("SELECT feed AS k, post_idx AS x FROM posts WHERE doc_id % 3 = 0 UNION SELECT feed, post_idx FROM posts WHERE (t, -CAST(substr(feed, 4) AS INTEGER), post_idx) > (1700000400, -5, 18) AND lang = 'en'")})""")
def marked_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All English posts above a point marked read."""
    p = posts(spark, sf_dir, words=False).withColumn("feed_id", F.substring("feed", 4, 9).cast("int"))
    read = ranges.from_items(p.filter("doc_id % 3 = 0"), ["feed"], "post_idx")
    return actions.mark_feed_read(p, read, matches=p.filter("lang = 'en'"), point=(datetime.fromtimestamp(1_700_000_400, UTC), 5, 18))


@query("""SELECT user_id AS "user", event_id % 40 AS item_id, event_type AS tag, max(event_id) AS seq FROM events GROUP BY ALL HAVING arg_max(value > 20, event_id)""")
def replayed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return actions.replay_tags(e.select(F.col("user_id").alias("user"), (F.col("event_id") % 40).alias("item_id"), F.col("event_type").alias("tag"), (F.col("value") > 20).alias("added"), F.col("event_id").alias("seq")))


@query(f"""WITH {_POSTS}, n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY t DESC, post_idx DESC) AS n FROM posts)
SELECT k AS feed, lo, hi FROM ({_islands('SELECT feed AS k, post_idx AS x FROM n WHERE n > 10')})""")
def initially_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.initially_ignored(posts(spark, sf_dir, words=False), datetime.fromtimestamp(1_700_100_000, UTC))


@query("""WITH have AS (SELECT c_nationkey AS u, c_custkey AS key, c_custkey * 2 + 1 AS id FROM customer WHERE c_custkey % 3 = 0), want AS (SELECT c_nationkey AS u, c_custkey AS key, c_acctbal AS t FROM customer WHERE c_custkey % 2 = 0),
fresh AS (SELECT u, key, row_number() OVER (PARTITION BY u ORDER BY t, key) AS n FROM want WHERE key NOT IN (SELECT key FROM have)), top AS (SELECT u, max(id) AS t FROM have GROUP BY u)
SELECT u AS "user", key, id FROM have WHERE key IN (SELECT key FROM want) UNION ALL SELECT u, key, CAST(n + coalesce(t, 0) AS BIGINT) FROM fresh LEFT JOIN top USING (u)""")
def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    user = F.col("c_nationkey").alias("user")
    have = c.filter("c_custkey % 3 = 0").select(user, F.col("c_custkey").alias("key"), (F.col("c_custkey") * 2 + 1).alias("id"))
    return actions.surrogate_ids(have, c.filter("c_custkey % 2 = 0").select(user, F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("time")))


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 > 1 UNION ALL SELECT c_custkey, 'NEW', c_acctbal + 1 FROM customer WHERE c_custkey % 5 = 1""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = c.filter("c_custkey % 5 < 2").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.expr("c_custkey % 5 = 0").alias("_deleted"))
    return actions.upsert(c, changes, ["c_custkey"])


@query("""SELECT c_custkey AS "user", CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'x,b' ELSE 'c' END AS folders FROM customer""")
def renamed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.expr("CASE c_custkey % 3 WHEN 0 THEN array('a', 'x') WHEN 1 THEN array('a', 'b', 'x') ELSE array('c') END").alias("folders"))
    return actions.rename_folder(c, "a", "x").withColumn("folders", F.array_join("folders", ","))


# --- catalogue: suppliers as feeds, customers as their readers


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed, user, country, paid, tag): a customer reads the suppliers of its orders, in folders named by the part."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("country"), (F.col("c_acctbal") > 5000).alias("paid"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tag"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_suppkey").alias("feed"))
    return li.join(p, "l_partkey").join(o, "o_orderkey").join(c, "user").select("feed", "user", "country", "paid", "tag")


_SUBS = """subs AS (SELECT l_suppkey AS feed, o_custkey AS "user", c_nationkey AS country, c_acctbal > 5000 AS paid, p_type AS tag
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"""


@query(f"""WITH {_SUBS} SELECT feed, country, count(DISTINCT "user") AS users, count(DISTINCT CASE WHEN paid THEN "user" END) AS paid_users FROM subs GROUP BY feed, country""")
def subscriber_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.subscriber_stats(_subs(spark, sf_dir))


@query(f"""WITH {_SUBS}, r AS (SELECT c_nationkey AS country, avg(CAST(c_acctbal > 5000 AS INTEGER)) AS ratio FROM customer GROUP BY 1),
s AS (SELECT feed, country, count(DISTINCT "user") AS users, count(DISTINCT CASE WHEN paid THEN "user" END) AS paid_users FROM subs GROUP BY feed, country)
SELECT feed, round(greatest(CAST(sum(paid_users) AS DOUBLE), sum(coalesce(ratio, 1.0) * users)), 6) AS nsubs FROM s LEFT JOIN r USING (country) GROUP BY feed""")
def normalized_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country"), (F.col("c_acctbal") > 5000).alias("paid"))
    return catalog.normalized_subscribers(catalog.subscriber_stats(_subs(spark, sf_dir)), catalog.paid_ratio(c)).withColumn("nsubs", F.round("nsubs", 6))


@query(f"""WITH {_SUBS}, words AS (SELECT tag FROM subs GROUP BY feed, tag HAVING count(DISTINCT "user") >= 5)
SELECT feed, tag, count(DISTINCT "user") AS users FROM subs WHERE tag IN (SELECT tag FROM words) GROUP BY feed, tag HAVING count(DISTINCT "user") >= 2""")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tag_vocabulary(_subs(spark, sf_dir)).select("feed", "tag", "users")


@query(f"""WITH {_SUBS} SELECT country, tag, count(DISTINCT "user") AS users FROM subs GROUP BY country, tag HAVING count(DISTINCT "user") >= 10""")
def country_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_tags(_subs(spark, sf_dir), by=["country"])


@query(f"""WITH {_SUBS}, t AS (SELECT feed, tag, count(DISTINCT "user") AS u FROM subs GROUP BY feed, tag HAVING count(DISTINCT "user") >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY u DESC, tag) AS n FROM t)
SELECT feed, string_agg(tag, ',' ORDER BY n) FILTER (n <= 10) AS tags, arg_min(tag, n) AS category FROM r GROUP BY feed""")
def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalogue(catalog.tag_vocabulary(_subs(spark, sf_dir), least=0)).withColumn("tags", F.array_join("tags", ","))


@query("""WITH s AS (SELECT DISTINCT user_id AS u, CAST(floor(value / 4) AS BIGINT) AS f FROM events), n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
p AS (SELECT a.u AS a, b.u AS b, count(*) AS shared FROM s a JOIN s b ON a.f = b.f AND a.u < b.u GROUP BY 1, 2)
SELECT a, b, shared, CAST(floor(100 * shared / greatest(na.n, nb.n)) AS BIGINT) AS sameness FROM p JOIN n na ON na.u = a JOIN n nb ON nb.u = b WHERE 100 * shared >= 70 * greatest(na.n, nb.n)""")
def similar_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.similar_users(events(spark, sf_dir).select(F.col("user_id").alias("user"), F.floor(F.col("value") / 4).alias("feed")))


@query("SELECT event_type, median(value) AS m, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'none', 0.0, 0")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    one = e.groupBy("event_type").agg(catalog.median0("value").alias("m"), F.count("*").alias("n"))
    return one.unionByName(e.filter("event_id < 0").agg(catalog.median0("value").alias("m"), F.count("*").alias("n")).select(F.lit("none").alias("event_type"), "m", "n"))


@query("""WITH r AS (SELECT o_custkey AS feed, epoch(max(o_orderdate) OVER (PARTITION BY o_custkey)) - epoch(o_orderdate) AS age, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
s AS (SELECT feed, coalesce(min(n) FILTER (n >= 10 AND age > 604800), max(n)) AS n FROM r GROUP BY feed)
SELECT feed, round(CASE WHEN age < 1 OR n <= 1 THEN 1.0 ELSE 86400.0 / (age / (n - 1)) END, 9) AS per_day FROM s JOIN r USING (feed, n)""")
def posts_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("feed"), F.col("o_orderdate").cast("timestamp").alias("time"), F.col("o_orderkey").alias("post_idx"))
    return catalog.posts_per_day(o).withColumn("per_day", F.round("per_day", 9))


@query("""WITH g AS (SELECT CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 3600000000) AS BIGINT) AS gap FROM events), c AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap)
SELECT gap, n, CAST(sum(n) OVER (ORDER BY gap) AS BIGINT) AS upto, sum(n) OVER (ORDER BY gap) / (SELECT sum(n) FROM c) AS share FROM c""")
def inter_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.inter_arrival(events(spark, sf_dir), "user_id", "ts", 60)


@query("SELECT CAST(length(text) // 1000 AS BIGINT) AS kb, count(*) AS n FROM documents GROUP BY 1")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.histogram(table(spark, sf_dir, "documents").select(F.floor(F.length("text") / 1000).alias("kb")), "kb")


@query("""WITH u AS (SELECT user_id, min(ts) AS s, bool_or(event_type = 'purchase' AND value > 60) AS paid FROM events GROUP BY user_id)
SELECT count(*) AS users, count(*) FILTER (paid) AS paid, count(*) FILTER (paid) / count(*) AS ratio FROM u WHERE (epoch(TIMESTAMP '2024-02-01') - floor(epoch(s))) / 86400.0 BETWEEN 30 AND 60""")
def cohort_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("signed_up"), F.bool_or(F.expr("event_type = 'purchase' AND value > 60")).alias("paid"))
    return catalog.cohort_conversion(u, NOW)


@query("""SELECT p_brand, p_partkey, round(CASE WHEN max(p_size) OVER w = 1 THEN 0 ELSE ln(p_size) / ln(max(p_size) OVER w) END, 9) AS score FROM part WINDOW w AS (PARTITION BY p_brand)""")
def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("v"))
    return catalog.group_normalised(p, "p_brand", "v").select("p_brand", "p_partkey", F.round("score", 9).alias("score"))


@query("""SELECT p_partkey, round((3 - greatest(0, least(2, ln(p_retailprice / 900.0) / ln(6)))) / 3, 9) AS often, round(greatest(1, least(3, CASE WHEN p_size = 1 THEN 1 ELSE log10(20 * (p_size - 1)) END)) / 3, 9) AS short FROM part""")
def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(catalog.frequency_penalty(F.col("p_retailprice") / 900.0), 9).alias("often"), F.round(catalog.length_penalty(20 * (F.col("p_size") - 1.0)), 9).alias("short"))


@query()
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds for three tags in one country: a top-k report."""
    s = _subs(spark, sf_dir)
    rows = catalog.catalogue(catalog.tag_vocabulary(s))
    stats = catalog.subscriber_stats(s)
    code = F.col("country").cast("string")
    by_country = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct(code, F.col(c))))).alias("paid_countries" if c == "paid_users" else "countries")
    n = stats.groupBy("feed").agg(F.sum("users").cast("double").alias("nsubs"), by_country("users"), by_country("paid_users"))
    cat = rows.join(n, "feed").withColumns({"per_day": F.col("feed") % 50 + 0.5, "post_len": F.col("feed") % 60 + 1.0, "updated": F.timestamp_seconds(F.lit(1_704_000_000) + F.col("feed") * 10_000)})
    return catalog.search(cat, ["ECONOMY", "SMALL"], "3", NOW).select("feed", "tier", "step", "score", F.round("rank", 6).alias("rank"))


# --- merge rules: events as two replicas


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return merge.replicas(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))


@query("SELECT user_id, arg_max(event_id, (value, -(event_id % 2), event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def merged_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).select("user_id", "value", "event_id", "replica")
    one = ordered.first_of(v, ["user_id", "value", "replica"], [F.col("event_id").desc()])
    return merge.max_by(one, ["user_id"], ["value"]).select("user_id", "event_id", "value")


@query("""WITH m AS (SELECT user_id % 30 AS k, event_type AS t, max(value) AS v FROM events GROUP BY ALL) SELECT k, string_agg(t || '=' || CAST(CAST(floor(v * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS m FROM m GROUP BY k""")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).select((F.col("user_id") % 30).alias("k"), F.create_map("event_type", "value").alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], F.floor(e["value"] * 100).cast("string")))
    return merge.map_max(v, ["k"], "m").select("k", F.array_join(F.array_sort(entries), ",").alias("m"))


@query("""WITH t AS (SELECT user_id, event_type, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS p FROM events WHERE event_type IN ('signup', 'view', 'purchase'))
SELECT user_id, arg_max(event_type, (p, event_id)) AS event_type, arg_max(event_id, (p, event_id)) AS event_id FROM t GROUP BY user_id""")
def merged_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).filter("event_type IN ('signup', 'view', 'purchase')")
    return merge.tier_max(v, ["user_id"], ("signup", "view", "purchase"), "event_type", "event_id")


@query("""SELECT user_id, min(event_id) AS event_id, max(value) AS value, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM events x WHERE x.user_id = e.user_id)) AS flags FROM events e GROUP BY user_id""")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).withColumn("flags", F.array("event_type"))
    return merge.fields(v, ["user_id"], ["event_id"], ["value"], ["flags"]).withColumn("flags", F.array_join("flags", ","))


@query("SELECT DISTINCT user_id, event_id % 100 AS item FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, event_id % 100 FROM events WHERE event_type = 'error'")
def two_phase_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("item", F.col("event_id") % 100)
    return merge.two_phase(e.filter("event_type = 'view'"), e.filter("event_type = 'error'"), ["user_id", "item"])


@query("""SELECT event_id % 25 AS feed, user_id FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL HAVING arg_max(event_type = 'signup', (ts, event_id))""")
def replayed_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type IN ('signup', 'error')").withColumn("feed", F.col("event_id") % 25)
    return merge.replay(e.withColumn("added", F.col("event_type") == "signup"), ["feed", "user_id"], ["ts", "event_id"], "added")


@query("""WITH v AS (SELECT user_id AS "user", 'u' || (event_id % 10) AS url, CASE event_type WHEN 'signup' THEN 'adding' WHEN 'view' THEN 'subscribed' WHEN 'click' THEN 'scanning' WHEN 'purchase' THEN 'retry' ELSE 'error' END AS state,
 CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS p, event_id AS edits, 'f' || (event_id % 4) AS f FROM events)
SELECT "user", url, arg_max(state, (p, edits)) AS state, arg_max(edits, (p, edits)) AS edits, string_agg(DISTINCT f, ',' ORDER BY f) AS folders FROM v GROUP BY "user", url""")
def merged_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr("CASE event_type WHEN 'signup' THEN 'adding' WHEN 'view' THEN 'subscribed' WHEN 'click' THEN 'scanning' WHEN 'purchase' THEN 'retry' ELSE 'error' END")
    v = _versions(spark, sf_dir).select(F.col("user_id").alias("user"), F.concat(F.lit("u"), F.col("event_id") % 10).alias("url"), state.alias("state"), F.col("event_id").alias("edits"), F.lit("t").alias("title"), F.array(F.concat(F.lit("f"), F.col("event_id") % 4)).alias("folders"), "replica")
    return merge.subscriptions(v).select("user", "url", "state", "edits", F.array_join("folders", ",").alias("folders"))


# --- ordered analytics


@query("""WITH have AS (SELECT c_nationkey AS k, c_name AS name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS id FROM customer WHERE c_custkey % 2 = 0),
top AS (SELECT k, max(id) AS t FROM have GROUP BY k)
SELECT c_nationkey AS k, c_name AS name, CAST(coalesce(t, 0) + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS BIGINT) AS id FROM customer LEFT JOIN top ON k = c_nationkey WHERE c_custkey % 2 = 1""")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), "c_custkey")
    have = c.filter("c_custkey % 2 = 0").withColumn("id", F.row_number().over(Window.partitionBy("k").orderBy("c_custkey")).cast("long"))
    return ordered.next_ids(have, c, "name", "id", ["k"])


@query("""WITH i AS (SELECT user_id AS feed, event_id AS pos, CAST(floor(value) AS INTEGER) AS guid, event_type AS link, CASE WHEN user_id % 7 = 0 AND event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) END AS t FROM events),
a AS (SELECT *, bool_and(t IS NOT NULL) OVER (PARTITION BY feed) AS timed FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY CASE WHEN timed THEN -t ELSE 0 END, pos) - 1 AS position FROM a),
d AS (SELECT *, row_number() OVER (PARTITION BY feed, guid ORDER BY position) AS n FROM p), l AS (SELECT *, count(*) OVER (PARTITION BY feed, link) AS link_count FROM d WHERE n = 1)
SELECT feed, pos, CAST(position AS INTEGER) AS position, link_count, CAST(row_number() OVER (PARTITION BY feed ORDER BY position DESC) - 1 AS INTEGER) AS out FROM l WHERE position < 60""")
def fetched_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    items = e.select(F.col("user_id").alias("feed"), F.col("event_id").alias("pos"), F.floor("value").alias("guid"), F.col("event_type").alias("link"), F.when(F.expr("user_id % 7 = 0 AND event_id % 5 = 0"), None).otherwise(F.col("ts")).alias("time"))
    return ordered.batch(items, 60).select("feed", "pos", "position", "link_count", "out")


@query(f"""WITH {_POSTS}, r AS (SELECT *, max(post_idx) OVER (PARTITION BY feed) AS hi FROM posts) SELECT feed, post_idx FROM r WHERE post_idx > hi - 20 OR doc_id % 9 = 0""")
def retained_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir, words=False)
    return ordered.retained(p, 20, tagged=p.filter("doc_id % 9 = 0"))[0].select("feed", "post_idx")


@query("""WITH v AS (SELECT user_id AS feed, event_id % 5 AS post_idx, event_id AS version, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY version DESC) AS n, row_number() OVER (PARTITION BY feed, post_idx ORDER BY version DESC) AS p FROM v),
g AS (SELECT *, (n > 50 OR ts < TIMESTAMP '2024-01-30') AND p > 1 AS go FROM r), l AS (SELECT *, count(*) FILTER (go) OVER (PARTITION BY feed) AS lost FROM g) SELECT feed, version FROM l WHERE NOT go OR lost <= 30""")
def kept_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = events(spark, sf_dir).select(F.col("user_id").alias("feed"), (F.col("event_id") % 5).alias("post_idx"), F.col("event_id").alias("version"), F.col("event_id").alias("count"), F.col("ts").alias("time"))
    return ordered.version_retention(v, datetime(2024, 1, 31, tzinfo=UTC), keep=50).select("feed", "version")


@query("""WITH p AS (SELECT user_id AS k, event_id AS at FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id AS k, event_id AS ver, CAST(floor(value) AS BIGINT) AS n FROM events WHERE event_type = 'view')
SELECT p.k, p.at, coalesce(v.n, 0) AS n FROM p ASOF LEFT JOIN v ON p.k = v.k AND p.at >= v.ver""")
def as_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("user_id", "k")
    return ordered.as_of(e.filter("event_type = 'purchase'").withColumnRenamed("event_id", "at"), e.filter("event_type = 'view'").select("k", F.col("event_id").alias("ver"), F.floor("value").alias("n")), ["k"], "at", "ver", "n")


@query("""WITH b AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, event_id, max(x) OVER (PARTITION BY user_id ORDER BY event_id) + n AS t FROM b""")
def monotone_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return ordered.monotone(e, ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", F.unix_seconds("monotone").alias("t"))


@query("""WITH c AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS n, coalesce(max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up FROM events)
SELECT user_id, event_id, n, n - up AS grown FROM c WHERE n > up""")
def grown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", F.floor("value").alias("n"))
    return ordered.increasing_counts(e, ["user_id"], "event_id", "n")


@query("""WITH RECURSIVE p AS (SELECT o_custkey AS u, CAST(epoch(o_orderdate) AS BIGINT) AS t, CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 365 ELSE 183 END AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 365 ELSE 183 END) AS n FROM orders),
f AS (SELECT u, n, t + d * 86400 AS e FROM p WHERE n = 1 UNION ALL SELECT p.u, p.n, greatest(f.e, p.t) + p.d * 86400 FROM f JOIN p ON p.u = f.u AND p.n = f.n + 1)
SELECT u AS "user", max(e) AS till FROM f GROUP BY u""")
def paid_till(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderdate").cast("timestamp").alias("time"), F.expr("CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 365 ELSE 183 END").alias("days"))
    return ordered.paid_till(o).select("user", F.unix_seconds("paid_till").alias("till"))


# --- rollups


@query("""SELECT CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS bucket, user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS flags, count(*) AS n FROM events GROUP BY 1, 2""")
def usage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.buckets(events(spark, sf_dir), "ts").select(F.unix_seconds("bucket").alias("bucket"), "user_id", F.array_join("flags", ",").alias("flags"), "n")


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS flags, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05 07:35:00' AND ts < TIMESTAMP '2024-01-20 13:10:00' GROUP BY user_id""")
def usage_over_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rollups.buckets(events(spark, sf_dir), "ts")
    out = rollups.over_range(base, rollups.days(base), "2024-01-05 07:35:00", "2024-01-20 13:10:00")
    return out.select("user_id", F.array_join("flags", ",").alias("flags"), "n")


@query("SELECT event_type AS name, CAST(sum(event_id % 10) AS BIGINT) AS value FROM events GROUP BY 1")
def counter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.counters(events(spark, sf_dir).select(F.col("event_type").alias("name"), (F.col("event_id") % 10).alias("amount")), "name", "amount")


# --- scalar functions


@query("""WITH x AS (SELECT doc_id AS f, CAST(doc_id % 67108864 AS BIGINT) AS p, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id % 16384 END AS c FROM documents)
SELECT f, CASE WHEN c IS NULL THEN f * 4294967296 + p ELSE CAST(f * 1099511627776 + p * 16384 + c - 9223372036854775808 AS BIGINT) END AS item, lpad(lower(to_hex(CASE WHEN c IS NULL THEN f * 4294967296 + p ELSE CAST(f * 1099511627776 + p * 16384 + c - 9223372036854775808 AS BIGINT) END)), 16, '0') AS hex,
f AS feed, p AS post, c AS comment FROM x WHERE f > 0""")
def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id > 0").select(F.col("doc_id").alias("f"), F.expr("doc_id % 67108864").alias("p"), F.expr("CASE WHEN doc_id % 2 = 1 THEN doc_id % 16384 END").alias("c"))
    item = d.withColumn("item", ids.pack(F.col("f"), F.col("p"), F.col("c")))
    parts = ids.unpack(ids.read_external(ids.external(F.col("item"))))
    return item.select("f", "item", F.substring(ids.external(F.col("item")), -16, 16).alias("hex"), parts["feed"].alias("feed"), parts["post"].alias("post"), parts["comment"].alias("comment"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, array_to_string(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '.')[-2:], '.') AS domain,
CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) END AS path,
regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', '') AS bare, regexp_replace(url, '^http://', 'https://') AS secure,
regexp_replace(url, '\?utm_source=feed(#|$)', '\1') AS clean, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS root FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.host(u).alias("host"), url.registered_domain(url.host(u)).alias("domain"), url.path_and_query(u).alias("path"), url.bare(u).alias("bare"), url.to_https(u).alias("secure"), url.without_tracking(u).alias("clean"), url.root_page(u).alias("root"))


@query("""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS mail, CAST(epoch(o_orderdate) AS BIGINT) AS iso, CAST(epoch(CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN o_orderdate + INTERVAL 366 DAY ELSE o_orderdate + INTERVAL 1 YEAR END) AS BIGINT) AS next,
(o_orderkey % 50) * 3600 + 125 AS clock, CAST((o_orderkey % 50) * 3600 + 86400 + 60 AS DOUBLE) AS iso_seconds FROM orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    hours = F.col("o_orderkey") % 50
    return o.select(
        "o_orderkey", F.unix_seconds(dates.rfc822(dates.as_rfc822(F.col("d")))).alias("mail"), F.unix_seconds(dates.rfc3339(dates.as_rfc3339(F.col("d")))).alias("iso"),
        F.unix_seconds(dates.add_year(F.col("d"))).alias("next"), dates.clock_duration(F.format_string("%d:02:05", hours)).alias("clock"),
        dates.iso_duration(F.format_string("P1DT%dH1M", hours)).alias("iso_seconds"),
    )


@query(r"""WITH w AS (SELECT lang, translate(w, '-''’', '   ') AS w FROM (SELECT lang, regexp_extract(unnest(regexp_split_to_array(lower(text), '[\s\p{Z}]+')), '^[\p{Ps}\p{Pi}"]?([\p{L}\p{M}''’-]+)[\p{P}]*$', 1) AS w FROM documents) WHERE w <> ''), g AS (SELECT lang, substr(' ' || w || ' ', CAST(i AS INTEGER), 3) AS trigram FROM w, LATERAL (SELECT unnest(generate_series(1, length(w))) AS i))
SELECT lang, trigram, count(*) AS freq FROM g GROUP BY lang, trigram""")
def trigram_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langdetect.train(table(spark, sf_dir, "documents"), "lang", "text")


@query()
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by profiles of all of them, and whether that is the one it is labelled with."""
    d = table(spark, sf_dir, "documents")
    found = langdetect.detect(d, langdetect.train(d, "lang", "text"), "doc_id", "text")
    return d.select("doc_id", "lang").join(found, "doc_id", "left").select("doc_id", "lang", "detected", (F.col("lang") == F.col("detected")).alias("right"))


@query("""SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') <> '' AS has_text, lower(md5(text)) AS md5, sha256(text) AS sha256 FROM documents""")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.regexp_replace("text", r"\s+", " ") != "").alias("has_text"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query()
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.element_at(F.array(*map(F.lit, ("compact", "magazine", "mosaic", "list"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.short_text(F.col("text"), view).alias("short"), text.duration(F.col("doc_id") * 7).alias("duration"), text.file_size(F.col("n_chars")).alias("size"))


# --- sources and sinks


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, images and text of every page, links resolved."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", text.html_parts("html").alias("h"))
    return p.select("page_id", F.size("h.links").alias("links"), F.size("h.images").alias("images"), F.length("h.text").alias("n_chars"), url.resolve(F.col("url"), F.get("h.links", F.lit(0))).alias("first_link"))


@query()
def page_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind each page is, and the feeds and metadata that it declares."""
    return feed_sources.discovered(table(spark, sf_dir, "pages"))


@query("""SELECT source AS feed, CAST(doc_id AS VARCHAR) AS guid, 'Post ' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS subject, CAST(length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS INTEGER) AS n, 1700000000 + doc_id AS t FROM documents""")
def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written as one Atom document per feed and parsed again."""
    p = posts(spark, sf_dir, words=False).withColumn("subject", F.concat(F.lit("Post "), F.col("post_idx").cast("string"))).withColumn("guid", F.col("doc_id").cast("string"))
    return feed_sources.parsed(sinks.atom(p)).select("feed", F.explode("items").alias("i")).select("feed", "i.guid", "i.subject", F.length("i.body").alias("n"), F.unix_seconds("i.published").alias("t"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS "user", 'http://example.org/' || c_custkey AS url, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS folders FROM customer""")
def opml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions by customer written as OPML and parsed again."""
    c = table(spark, sf_dir, "customer")
    subs = c.select(F.col("c_nationkey").cast("string").alias("user"), F.concat(F.lit("http://example.org/"), F.col("c_custkey")).alias("url"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("c_mktsegment"))).alias("folders"))
    return feed_sources.opml(sinks.opml(subs)).select("user", "url", "title", F.array_join("folders", ",").alias("folders"))


# --- streams


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT) ORDER BY event_id) AS n, arg_max(event_type, event_id) OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT)) AS last FROM events)
SELECT CAST(user_id AS VARCHAR) AS feed, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS guid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx, last AS hash FROM e WHERE n = 1""")
def streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed as items: a known guid keeps its index and takes the new content, a new one gets the next."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = upsert.file_stream(spark, f"{sf_dir}/events.parquet", schema)
    items = source.select(F.col("user_id").cast("string").alias("feed"), F.floor("value").cast("string").alias("guid"), F.col("event_type").alias("hash"), F.col("event_id").alias("seq"))
    return upsert.run_to_table(spark, items)


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def streamed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = upsert.file_stream(spark, f"{sf_dir}/events.parquet", schema)
    counts = source.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return upsert.complete(spark, counts).select("event_type", "n", F.round("total", 2).alias("total"))


_HOP = "CASE WHEN page_id % 30 = 9 THEN concat('p', page_id - 4) WHEN page_id % 30 IN (4, 29) THEN 'x' ELSE concat('p', page_id + 1) END"


@query(f"""WITH RECURSIVE l AS (SELECT concat('p', page_id) AS u, {_HOP} AS t FROM pages),
w AS (SELECT u AS s, t AS e, [u] AS seen FROM l UNION ALL SELECT s, l.t, list_append(seen, l.u) FROM w JOIN l ON l.u = w.e WHERE NOT list_contains(seen, w.e) AND len(seen) <= 10)
SELECT s AS url, arg_max(e, len(seen)) AS "end", bool_or(list_contains(seen, e)) AS loops, CAST(max(len(seen)) AS INTEGER) AS hops, max(len(seen)) > 10 AS too_long FROM w GROUP BY s""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of five and of twenty hops, and rings of five."""
    return trees.redirect_paths(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("url"), F.expr(_HOP).alias("target")))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT user_id AS u, CAST(floor(value / 4) AS BIGINT) AS f FROM events), n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
p AS (SELECT a.u AS a, b.u AS b FROM s a JOIN s b ON a.f = b.f AND a.u < b.u JOIN n na ON na.u = a.u JOIN n nb ON nb.u = b.u GROUP BY a.u, b.u, na.n, nb.n HAVING 100 * count(*) >= 70 * greatest(na.n, nb.n)),
o AS (SELECT u, row_number() OVER (ORDER BY u) AS k FROM n), g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL
 SELECT g.k + 1, CASE WHEN list_contains(g.gone, o.u) THEN g.gone ELSE list_distinct(list_concat(g.gone, coalesce((SELECT list(b) FROM p WHERE p.a = o.u), []))) END FROM g JOIN o ON o.k = g.k + 1)
SELECT unnest(gone) AS "user" FROM g WHERE k = (SELECT max(k) FROM g)""")
def duplicate_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_subscribers(events(spark, sf_dir).select(F.col("user_id").alias("user"), F.floor(F.col("value") / 4).alias("feed")))


# --- hits, saved queries, deltas, lookups, schedule


@query("""WITH c AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS n FROM conversations), h AS (SELECT * FROM c WHERE (conv_id % 4 = 0 OR (conv_id + turn) % 3 = 0) AND conv_id % 7 <> 1),
v AS (SELECT conv_id, greatest(max(turn) - 1, 0) AS cnt FROM c GROUP BY conv_id), k AS (SELECT h.conv_id, count(*) AS k FROM h WHERE turn > 0 GROUP BY h.conv_id)
SELECT conv_id AS post_idx, CAST(NULL AS INTEGER) AS idx FROM h WHERE turn = 0
UNION ALL SELECT v.conv_id, CAST(unnest(generate_series(0, cnt - 1)) AS INTEGER) FROM v JOIN k USING (conv_id) WHERE k >= cnt AND cnt > 0
UNION ALL SELECT h.conv_id, CAST(turn - 1 AS INTEGER) FROM h JOIN v USING (conv_id) JOIN k USING (conv_id) WHERE k < cnt AND turn > 0 AND turn - 1 < cnt""")
def hits_to_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns found by guid, the first as post and the others as comments, the last of which came later."""
    c = table(spark, sf_dir, "conversations").withColumn("feed", F.lit("f")).withColumn("guid", F.concat_ws("/", "conv_id", "turn"))
    first = F.concat_ws("/", F.col("conv_id"), F.lit(0))
    hits = c.filter("(conv_id % 4 = 0 OR (conv_id + turn) % 3 = 0) AND conv_id % 7 <> 1").select("feed", first.alias("post_guid"), F.expr("CASE WHEN turn > 0 THEN guid END").alias("comment_guid"))
    p = c.filter("turn = 0").select("feed", F.col("conv_id").alias("post_idx"), "guid", F.lit(10**9).alias("total"))
    comments = c.filter("turn > 0").select("feed", F.col("conv_id").alias("post_idx"), (F.col("turn") - 1).alias("idx"), "guid")
    versions = c.groupBy("feed", F.col("conv_id").alias("post_idx")).agg(F.greatest(F.max("turn") - 1, F.lit(0)).alias("count"))
    posts_, found = masks.from_hits(hits, p, comments, versions)
    return posts_.select("post_idx", F.lit(None).cast("int").alias("idx")).unionByName(found.select("post_idx", "idx"))


@query("""WITH s AS (SELECT user_id % 15 AS u, event_type AS q, event_id % 2 = 0 AS neg, 'f' || (event_id % 6) AS f FROM events WHERE value < 20 OR event_id % 3 = 0)
SELECT u AS "user", q AS query, neg AS negate, string_agg(DISTINCT f, ',' ORDER BY f) AS feeds FROM s GROUP BY u, q, neg""")
def saved_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select((F.col("user_id") % 15).alias("user"), F.col("event_type").alias("query"), (F.col("event_id") % 2 == 0).alias("negate"), F.array(F.concat(F.lit("f"), F.col("event_id") % 6)).alias("feeds"), "value", "event_id")
    old, new = e.filter("value < 20").drop("value", "event_id"), e.filter("value >= 20 AND event_id % 3 = 0").drop("value", "event_id")
    return masks.save_query(old, new).withColumn("feeds", F.array_join("feeds", ","))


@query(f"""WITH {_POSTS}, d AS (SELECT feed, CAST(sum(CAST(doc_id % 4 = 0 AS INTEGER) - CAST(doc_id % 3 = 0 AS INTEGER)) AS BIGINT) AS delta FROM posts WHERE doc_id % 5 < 3 GROUP BY feed)
SELECT 'feed' AS kind, feed AS name, delta FROM d WHERE delta <> 0 UNION ALL SELECT 'folder', CASE WHEN feed < 'src3' THEN 'low' ELSE 'high' END AS f, CAST(sum(delta) AS BIGINT) FROM d GROUP BY f HAVING sum(delta) <> 0""")
def read_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir, words=False)
    before, after = p.select("feed", "post_idx", F.expr("doc_id % 3 = 0").alias("read")), p.filter("doc_id % 5 < 3").select("feed", "post_idx", F.expr("doc_id % 4 = 0").alias("read"))
    folders = p.select("feed").distinct().withColumn("folders", F.array(F.when(F.col("feed") < "src3", "low").otherwise("high")))
    return actions.read_deltas(before, after, folders)


@query("""SELECT DISTINCT user_id AS "user", event_type AS tag, event_id % 100 AS item_id FROM events WHERE event_type <> 'error' AND (user_id, event_type, event_id % 100) NOT IN (SELECT user_id, event_type, event_id % 100 FROM events WHERE value > 50)""")
def imported_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("user"), F.col("event_type").alias("tag"), (F.col("event_id") % 100).alias("item_id"), "value")
    return actions.imported(e.drop("value"), e.filter("value > 50"), e.select("user", F.lit("error").alias("folder")).distinct())


@query("""SELECT c_custkey AS feed, CASE WHEN c_custkey % 13 = 0 THEN 'Deleted posts' WHEN c_custkey % 11 = 0 THEN 'No more scanning' WHEN c_custkey % 7 = 0 AND c_custkey % 2 = 0 THEN 'A week of errors' WHEN c_custkey % 5 = 0 THEN 'No title'
WHEN c_mktsegment = 'BUILDING' THEN 'Bad title' WHEN c_nationkey = 0 THEN 'Empty feed' WHEN c_nationkey = 1 THEN 'Single post feed' END AS reason FROM customer""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    t = lambda days: F.timestamp_seconds(F.lit(int(NOW.timestamp()) - days * 86400))
    rows = c.select(
        F.col("c_custkey").alias("feed"), F.expr("c_custkey % 13 = 0").alias("is_deleted"), F.when(F.expr("c_custkey % 11 <> 0"), t(0)).alias("next_scan"), F.when(F.expr("c_custkey % 7 = 0"), F.when(F.expr("c_custkey % 2 = 0"), t(8)).otherwise(t(6))).alias("error_since"),
        F.when(F.expr("c_custkey % 5 <> 0"), F.col("c_name")).alias("title"), (F.col("c_mktsegment") == "BUILDING").alias("bad"), F.col("c_nationkey").alias("posts"),
    )
    return lookup.quality_gate(rows, NOW).select("feed", "reason")


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY floor((k - 1) / w), event_type, event_id) AS INTEGER) AS turn
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS w FROM events)""")
def dispatch_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("host"), F.col("event_type").alias("kind"), F.col("event_id").alias("time"), F.lit("").alias("url"))
    return schedule.dispatch_order(e, {"view": 3, "click": 2}).select(F.col("host").alias("user_id"), F.col("time").alias("event_id"), "turn")


@query("""WITH a AS (SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) * 3600 AS age FROM orders) SELECT k, round(CASE WHEN age < 10800 THEN 900 * (1 + age / 3600) WHEN age < 604800 THEN 3600 * (1 + age / 604800) WHEN age < 2592000 THEN 3600 * (2 + age / 2592000) ELSE least(604800, 3600 * (1 + 2 * age / 2592000)) END, 6) AS posts,
round(CASE WHEN age < 18000 THEN 1200 * (1 + age / 3600) ELSE 3600 * (2 + age / 86400) END, 6) AS comments FROM a""")
def scan_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 3600.0).alias("age"))
    return o.select("k", F.round(dates.next_posts_scan(F.col("age")), 6).alias("posts"), F.round(dates.next_comments_scan(F.col("age")), 6).alias("comments"))


@query(f"""WITH RECURSIVE w AS (SELECT conv_id AS tree, turn AS idx, [turn] AS ids FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, list_append(w.ids, c.turn) FROM conversations c JOIN w ON c.conv_id = w.tree AND w.idx = CASE WHEN c.turn % 3 = 0 THEN 0 ELSE c.turn - 1 END AND c.turn > 0)
SELECT k AS tree, lo, hi FROM ({_islands("SELECT tree AS k, idx AS x FROM w WHERE list_contains(ids, 1) AND idx < 5 UNION SELECT conv_id, turn FROM conversations WHERE turn = 0")})""")
def skipped_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    read = ranges.from_items(t.filter("idx = 0"), ["tree"], "idx")
    return actions.skipped(trees.paths(t), t.filter("idx = 1"), t.select("tree").distinct().withColumn("count", F.lit(5)), read)


# --- predicates and lookups


@query("""WITH d AS (SELECT source AS feed, max(doc_id) AS t FROM documents GROUP BY 1), w AS (SELECT *, right(feed, 1) IN ('1', '3', '5') AS expanded FROM d),
c AS (SELECT source AS feed, max(doc_id) + 7 AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT w.feed FROM w LEFT JOIN c USING (feed) WHERE t >= (SELECT max(doc_id) - 20 FROM documents) OR (expanded AND v >= (SELECT max(doc_id) - 20 FROM documents))""")
def newer_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("feed"), F.col("doc_id").alias("dl_time"))
    since = d.agg((F.max("dl_time") - 20).alias("since"))
    wanted = d.select("feed").distinct().withColumn("expanded", F.substring("feed", -1, 1).isin("1", "3", "5")).join(F.broadcast(since))
    return states.newer_feeds(d, d.filter("dl_time % 3 = 0").select("feed", (F.col("dl_time") + 7).alias("version")), wanted)


@query("SELECT l_orderkey AS owner, CASE WHEN bool_or(l_linenumber = 6) THEN true ELSE sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) = 0 END AS empty FROM lineitem GROUP BY 1")
def empty_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.expr("CASE WHEN l_linenumber = 6 THEN 'error' ELSE 'ok' END").alias("state"), F.expr("CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END").alias("size"))
    return states.empty_masks(m, ["owner"], on_error=True)


@query("""SELECT c_custkey AS "user", CASE c_custkey % 4 WHEN 0 THEN true WHEN 3 THEN false ELSE TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 60 AS INTEGER)) > TIMESTAMP '2024-02-01' END AS paid FROM customer""")
def paid_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'paid' WHEN 2 THEN 'trial' END").alias("state"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(c_custkey % 60 AS INT))").alias("till"))
    return c.select("user", states.is_paid(F.col("state"), F.col("till"), datetime(2024, 2, 1, tzinfo=UTC)).alias("paid"))


@query("""SELECT o_custkey AS "user", o_orderkey AS feed, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS ascending, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 = 0 ELSE true END AS unread_only, o_orderkey % 3 = 0 AS expanded FROM orders""")
def feed_view_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("feed"))
    chosen = o.filter("feed % 3 = 0").select("user", "feed", F.expr("feed % 2 = 0").alias("ascending"), F.expr("feed % 5 = 0").alias("unread_only"), F.lit(True).alias("expanded"))
    return states.view_modes(o, chosen, ["user", "feed"])


@query("""SELECT count(DISTINCT lower(role || (conv_id % 7))) AS authors, (SELECT coalesce(avg(n) FILTER (n < 6), 0.0) FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)) AS average FROM conversations""")
def author_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.expr("CASE WHEN turn % 2 = 0 THEN upper(concat(role, conv_id % 7)) ELSE concat(role, conv_id % 7) END").alias("author"))
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    return states.distinct_authors(c, "author").join(F.broadcast(states.average_size(sizes, "n", 6)))  # one row each


_TAGGED = "(SELECT user_id AS feed, CASE WHEN event_id % 5 = 0 THEN [] WHEN event_id % 3 = 0 THEN ['starred'] ELSE [event_type, 'starred'] END AS tags FROM events)"


def _tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.expr("CASE WHEN event_id % 5 = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN event_id % 3 = 0 THEN array('starred') ELSE array(event_type, 'starred') END")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("feed"), tags.alias("tags"))


@query(f"SELECT DISTINCT feed, unnest(CASE WHEN len(tags) > 1 THEN list_prepend(NULL, tags) ELSE tags END) AS tag FROM {_TAGGED}")
def feed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.tags_of_feeds(_tagged_events(spark, sf_dir))


@query(f"SELECT DISTINCT unnest(tags) AS tag, feed FROM {_TAGGED} WHERE feed % 2 = 0")
def tag_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _tagged_events(spark, sf_dir)
    return states.feeds_of_tag(items, items.select("feed").filter("feed % 2 = 0").distinct())


@query("""SELECT c_custkey AS "user", coalesce(n_name, '-') AS country, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS paid FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""")
def users_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_nationkey")
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    return states.users_by_country(c, c.join(n, "c_nationkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user")))


_LOGO_PATH = "CASE page_id % 4 WHEN 0 THEN '/assets/Logo.png' WHEN 1 THEN concat('/images/', page_id, '.png') WHEN 2 THEN '/favicon.gif?rss=icon' ELSE '' END"


@query(f"SELECT page_id, len(list_filter(regexp_split_to_array(lower({_LOGO_PATH}), '[/.\\-_?=&]'), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in states.LOGO_PARTS)}))) = 0 AND {_LOGO_PATH} <> '' AS logo FROM pages")
def logo_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", states.looks_like_logo(F.expr(_LOGO_PATH)).alias("logo"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), r AS (SELECT user_id AS "user", ts, CAST(floor(value / 10) AS BIGINT) AS url, event_id AS "to" FROM events, m WHERE epoch(now) - epoch(date_trunc('second', ts)) < 86400 + (epoch(now) - epoch(date_trunc('second', now)))),
k AS (SELECT *, row_number() OVER (PARTITION BY "user", url ORDER BY ts DESC, "to") AS n FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, url) AS i FROM k WHERE n = 1) SELECT "user", url, "to" FROM t WHERE i <= 5""")
def valid_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").alias("time"), F.floor(F.col("value") / 10).alias("url"), F.col("event_id").alias("to"))
    now = e.agg(F.max("time").alias("now"))
    return states.valid_renames(e.join(F.broadcast(now)), F.col("now"), 5).select("user", "url", "to")


@query("""WITH p AS (SELECT source, doc_id, doc_id - 40 * (doc_id % 3) AS dl, doc_id AS t FROM documents), b AS (SELECT CAST(max(doc_id) * 0.7 AS BIGINT) AS least FROM documents),
o AS (SELECT source, doc_id, bool_or(dl < least AND t < least) OVER (PARTITION BY source ORDER BY t DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS gone FROM p, b) SELECT source AS feed, doc_id FROM o WHERE NOT gone""")
def newest_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("feed"), "doc_id", F.col("doc_id").alias("post_idx"), F.expr("doc_id - 40 * (doc_id % 3)").alias("dl_time"), F.col("doc_id").alias("time"))
    least = d.agg(F.round(F.max("doc_id") * 0.7).cast("long").alias("least"))
    return states.until_older(d.join(F.broadcast(least)), F.col("least")).select("feed", "doc_id")
