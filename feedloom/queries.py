"""Registered queries over the driver's tables, each beside the SQL that it must equal.

documents serve as posts (feed = source), conversations as comment trees, events as actions, usage and subscriber logs,
lineitem as interval sets, customers and orders as subscriptions and catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import counters, listing, masks, model, ranges, trees
from .plans import textquery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, words: bool = True) -> DataFrame:
    return model.posts_of_documents(table(spark, sf_dir, "documents"), words)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, post_idx and doc_id of the posts alone."""
    return model.post_index(table(spark, sf_dir, "documents")).withColumnRenamed("source", "feed")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def fields() -> textquery.Fields:
    words = F.col("words")
    return textquery.Fields(words, {"text": words}, {"lang": F.col("lang")}, {"comment": F.lit(False)}, {"time": F.col("time")})


#: Saved queries: filters hide what they do not match in their feeds; streams are searches.
FILTERS = (
    {"id": 1, "query": "the OR de OR und", "negate": False, "feeds": [f"src{i}" for i in range(0, 8)]},
    {"id": 2, "query": 'lang:es "de la"', "negate": True, "feeds": [f"src{i}" for i in range(4, 14)]},
)
STREAMS = (
    {"id": 1, "query": "and of -lang:fr", "negate": False, "feeds": [f"src{i}" for i in range(0, 20)]},
    {"id": 2, "query": "(th* OR que) NOT \"of the\"", "negate": False, "feeds": [f"src{i}" for i in range(0, 10)]},
    {"id": 3, "query": "lang:de", "negate": True, "feeds": ["src1", "src2", "src3"]},
)


def compiled(queries: tuple[dict, ...]) -> list[dict]:
    return [q | {"predicate": textquery.compiled(q["query"], fields())} for q in queries]


def read_posts(p: DataFrame) -> DataFrame:
    """A read state for the posts: every third is read, every eleventh ignored; ranges (feed, kind, lo, hi)."""
    read = ranges.from_items(p.filter("doc_id % 3 = 0"), ["feed"], "post_idx").withColumn("kind", F.lit("post"))
    gone = ranges.from_items(p.filter("doc_id % 11 = 0"), ["feed"], "post_idx").withColumn("kind", F.lit("ignored"))
    return read.unionByName(gone)


_POSTS = r"""posts AS (
  SELECT source AS feed, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS post_idx, doc_id, lang, n_chars,
         list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS words,
         ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> ''), ' ') || ' ' AS line,
         1700000000 + doc_id AS t, (doc_id % 3 = 0 OR doc_id % 11 = 0) AS read
  FROM documents)"""
_FEEDS = lambda a, b: "(" + ", ".join(f"'src{i}'" for i in range(a, b)) + ")"
_STREAM = {
    1: f"(list_contains(words, 'and') AND list_contains(words, 'of') AND NOT lang = 'fr' AND feed IN {_FEEDS(0, 20)})",
    2: f"((line LIKE '% th%' OR list_contains(words, 'que')) AND NOT contains(line, ' of the ') AND feed IN {_FEEDS(0, 10)})",
    3: "(NOT lang = 'de' AND feed IN ('src1', 'src2', 'src3'))",
}
_VISIBLE = f"""((feed NOT IN {_FEEDS(0, 8)} OR list_has_any(words, ['the', 'de', 'und']))
  AND (feed NOT IN {_FEEDS(4, 14)} OR NOT (lang = 'es' AND contains(line, ' de la '))))"""
_MATCHES = "matches AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, feed, post_idx, t, read FROM posts WHERE {p}" for i, p in _STREAM.items()) + ")"


# --- search, masks, pages


@query(f"""WITH {_POSTS}
SELECT feed, post_idx, doc_id, t FROM posts WHERE {_STREAM[1]} AND {_VISIBLE} AND NOT read ORDER BY t DESC, CAST(substr(feed, 4) AS INTEGER), post_idx DESC LIMIT 15""")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved query behind the filters, unread only, newest first: one page."""
    p = posts(spark, sf_dir)
    found = p.filter(compiled(STREAMS)[0]["predicate"] & F.col("feed").isin(STREAMS[0]["feeds"]))
    shown = masks.unread(masks.globally_visible(found, compiled(FILTERS)), read_posts(index(spark, sf_dir)))
    page = listing.merged(shown.withColumn("feed_id", F.substring("feed", 4, 9).cast("int")), listing.PAGE)
    return page.select("feed", "post_idx", "doc_id", F.unix_seconds("time").alias("t"))


@query(f"""WITH {_POSTS}, hits AS (SELECT feed, read FROM posts WHERE {_STREAM[1]} AND {_VISIBLE})
SELECT feed, count(*) AS total, count(*) FILTER (NOT read) AS unread FROM hits GROUP BY feed""")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    found = masks.stream_matches(p, compiled(STREAMS[:1]), compiled(FILTERS)).select("feed", "post_idx")
    left = masks.unread(found, read_posts(index(spark, sf_dir))).withColumn("u", F.lit(1))
    return found.join(left, ["feed", "post_idx"], "left").groupBy("feed").agg(F.count("*").alias("total"), F.count("u").alias("unread"))


@query(f"WITH {_POSTS}, {_MATCHES} SELECT query_id, feed, post_idx FROM matches")
def saved_query_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.query_matches(posts(spark, sf_dir), compiled(STREAMS))


@query(f"WITH {_POSTS} SELECT feed, post_idx FROM posts WHERE {_VISIBLE}")
def filter_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.globally_visible(posts(spark, sf_dir), compiled(FILTERS)).select("feed", "post_idx")


@query(f"""WITH {_POSTS}, {_MATCHES}, vis AS (SELECT feed AS vf, post_idx AS vp FROM posts WHERE {_VISIBLE})
SELECT query_id AS stream, count(*) AS total, count(*) FILTER (NOT read) AS unread, count(DISTINCT feed) AS feeds
FROM matches JOIN vis ON feed = vf AND post_idx = vp GROUP BY query_id""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).withColumn("read", F.expr("doc_id % 3 = 0 OR doc_id % 11 = 0"))
    m = masks.stream_matches(p, compiled(STREAMS), compiled(FILTERS)).withColumnRenamed("query_id", "stream")
    return counters.stream_counters(m, p)


_QUERY_CASES = (
    (1, "ther* AND NOT in", "line LIKE '% ther%' AND NOT list_contains(words, 'in')"),
    (2, '"of the" || "de la"', "(contains(line, ' of the ') OR contains(line, ' de la '))"),
    (3, "lang:(en OR de) -the", "lang IN ('en', 'de') AND NOT list_contains(words, 'the')"),
    (4, "*", "true"),
    (5, "time:[2023-11-14T22:13:20 TO 2023-11-14T22:18:20}", "t >= 1700000000 AND t < 1700000300"),
    (6, "un?e text:de", "len(list_filter(words, lambda w: regexp_full_match(w, 'un.e'))) > 0 AND list_contains(words, 'de')"),
    (7, "comment:true", "false"),
    (8, "+and !of", "list_contains(words, 'and') AND NOT list_contains(words, 'of')"),
)


@query(f"WITH {_POSTS} " + " UNION ALL ".join(f"SELECT {i} AS case_id, doc_id FROM posts WHERE {s}" for i, _, s in _QUERY_CASES))
def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    hits = F.array(*(F.when(textquery.compiled(q, fields()), i) for i, q, _ in _QUERY_CASES))
    return p.select(F.explode(F.array_compact(hits)).alias("case_id"), "doc_id")


_MASK_SQL = """m AS (SELECT source AS feed, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS post_idx, doc_id FROM documents),
f AS (SELECT DISTINCT feed, CAST(substr(feed, 4) AS INTEGER) AS n FROM m),
ma AS (SELECT feed, n, CASE WHEN n = 3 THEN 'error' ELSE 'ok' END AS state, n % 2 = 0 AS e FROM f WHERE n < 15),
mb AS (SELECT feed, n, CASE WHEN n = 8 THEN 'error' ELSE 'ok' END AS state, n % 3 = 0 AS e FROM f WHERE n >= 2),
pa AS (SELECT feed, post_idx FROM m JOIN ma USING (feed) WHERE doc_id % 2 = 0), pb AS (SELECT feed, post_idx FROM m JOIN mb USING (feed) WHERE doc_id % 3 = 0),
ca AS (SELECT feed, post_idx, k AS idx FROM m JOIN ma USING (feed), (VALUES (0), (1)) v(k) WHERE e AND doc_id % 2 = 0 AND (doc_id + k) % 4 <> 0),
cb AS (SELECT feed, post_idx, k AS idx FROM m JOIN mb USING (feed), (VALUES (0), (1)) v(k) WHERE e AND doc_id % 3 = 0 AND (doc_id + k) % 5 <> 0)"""


def _two_masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p = posts(spark, sf_dir, words=False).select("feed", "post_idx", "doc_id")
    n = F.substring("feed", 4, 9).cast("int")
    feeds = p.select("feed").distinct().withColumn("n", n)
    a = feeds.filter("n < 15").select(F.lit("a").alias("owner"), "feed", F.expr("CASE WHEN n = 3 THEN 'error' ELSE 'ok' END").alias("state"), F.expr("n % 2 = 0").alias("expanded"))
    b = feeds.filter("n >= 2").select(F.lit("b").alias("owner"), "feed", F.expr("CASE WHEN n = 8 THEN 'error' ELSE 'ok' END").alias("state"), F.expr("n % 3 = 0").alias("expanded"))
    m = a.unionByName(b)
    rows = p.join(m.select("owner", "feed", "expanded"), "feed").filter("(owner = 'a' AND doc_id % 2 = 0) OR (owner = 'b' AND doc_id % 3 = 0)")
    c = rows.filter("expanded").withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1)))).filter("(owner = 'a' AND (doc_id + idx) % 4 <> 0) OR (owner = 'b' AND (doc_id + idx) % 5 <> 0)")
    return p, m, rows.select("owner", "feed", "post_idx"), c.select("owner", "feed", "post_idx", "idx")


def _mask_rows(made: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    m, p, c = made
    none = F.lit(None).cast("int")
    return (
        m.select("feed", none.alias("post_idx"), none.alias("idx"), "state", "expanded")
        .unionByName(p.select("feed", "post_idx", none.alias("idx"), F.lit("post").alias("state"), F.lit(False).alias("expanded")))
        .unionByName(c.select("feed", "post_idx", "idx", F.lit("comment").alias("state"), F.lit(False).alias("expanded")))
    )


@query(f"""WITH {_MASK_SQL}, both_ AS (SELECT ma.feed, ma.state = 'error' OR mb.state = 'error' AS err, ma.e AS ea, mb.e AS eb FROM ma JOIN mb USING (feed)), ok AS (SELECT * FROM both_ WHERE NOT err)
SELECT feed, CAST(NULL AS INTEGER) AS post_idx, CAST(NULL AS INTEGER) AS idx, CASE WHEN err THEN 'error' ELSE 'ok' END AS state, NOT err AND (ea OR eb) AS expanded FROM both_
UNION ALL SELECT feed, post_idx, NULL, 'post', false FROM ok JOIN pa USING (feed) JOIN pb USING (feed, post_idx)
UNION ALL SELECT feed, post_idx, idx, 'comment', false FROM ok JOIN ca USING (feed) JOIN cb USING (feed, post_idx, idx) WHERE ea AND eb
UNION ALL SELECT feed, post_idx, idx, 'comment', false FROM ok JOIN ca USING (feed) JOIN pb USING (feed, post_idx) WHERE ea AND NOT eb
UNION ALL SELECT feed, post_idx, idx, 'comment', false FROM ok JOIN cb USING (feed) JOIN pa USING (feed, post_idx) WHERE eb AND NOT ea""")
def mask_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_rows(masks.intersect(*_two_masks(spark, sf_dir)[1:], "a", "b", "c"))


@query(f"""WITH {_MASK_SQL}, both_ AS (SELECT feed, bool_or(state = 'error') AS err, bool_or(e) AS e FROM (SELECT * FROM ma UNION ALL SELECT * FROM mb) GROUP BY feed), ok AS (SELECT * FROM both_ WHERE NOT err)
SELECT feed, CAST(NULL AS INTEGER) AS post_idx, CAST(NULL AS INTEGER) AS idx, CASE WHEN err THEN 'error' ELSE 'ok' END AS state, NOT err AND e AS expanded FROM both_
UNION ALL SELECT feed, post_idx, NULL, 'post', false FROM (SELECT * FROM pa UNION SELECT * FROM pb) JOIN ok USING (feed)
UNION ALL SELECT feed, post_idx, idx, 'comment', false FROM (SELECT * FROM ca UNION SELECT * FROM cb) JOIN ok USING (feed)""")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mask_rows(masks.unite(*_two_masks(spark, sf_dir)[1:], "a", "b", "c"))


@query(f"""WITH {_MASK_SQL}, c AS (SELECT feed, post_idx, k AS idx FROM m, (VALUES (0), (1)) v(k))
SELECT feed, post_idx, idx, coalesce(CASE WHEN ma.e THEN ca.feed IS NOT NULL ELSE pa.feed IS NOT NULL END, false) AND coalesce(ma.state = 'ok', false) AS visible
FROM c LEFT JOIN ma USING (feed) LEFT JOIN pa USING (feed, post_idx) LEFT JOIN ca USING (feed, post_idx, idx)""")
def comment_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, m, mp, mc = _two_masks(spark, sf_dir)
    comments = p.select("feed", "post_idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    ok = m.filter("state = 'ok'").select("owner", "feed")
    return masks.comment_visible(comments, m, mp.join(ok, ["owner", "feed"]), mc.join(ok, ["owner", "feed"]), "a")


@query(f"""WITH {_POSTS}, feeds AS (SELECT feed, max(post_idx) - 29 AS lo FROM posts GROUP BY feed)
SELECT posts.feed, post_idx FROM posts JOIN feeds USING (feed) WHERE (post_idx >= lo AND doc_id % 2 = 0 AND posts.feed NOT IN ('src1', 'src2')) OR doc_id % 7 = 0""")
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old matches without two edited feeds and evicted posts, and the new matches."""
    p = posts(spark, sf_dir, words=False)
    feeds = model.feeds_of(p).withColumn("lo", F.col("hi") - 29)
    edited = spark.createDataFrame([("src1",), ("src2",)], "feed string")
    return masks.appended(p.filter("doc_id % 2 = 0"), p.filter("doc_id % 7 = 0"), edited, feeds)


@query("""WITH s AS (SELECT DISTINCT source AS feed, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)
SELECT feed FROM s WHERE (n < 10) <> (n < 8) OR (n % 2 = 0) <> (n % 4 = 0)""")
def edited_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "documents").select(F.col("source").alias("feed")).distinct().withColumn("n", F.substring("feed", 4, 9).cast("int"))
    q = lambda a, b: feeds.filter(a).select("feed", F.lit(1).alias("query_id")).unionByName(feeds.filter(b).select("feed", F.lit(2).alias("query_id")))
    return masks.edited_feeds(q("n < 10", "n % 2 = 0"), q("n < 8", "n % 4 = 0"))


@query("""WITH s AS (SELECT DISTINCT user_id % 20 AS u, event_type AS f FROM events), qf AS (SELECT u, u % 3 AS q, f FROM s WHERE f <> 'error' OR u % 2 = 0),
big AS (SELECT u, q FROM qf GROUP BY u, q HAVING 2 * count(DISTINCT f) > (SELECT count(DISTINCT f) FROM s s2 WHERE s2.u = qf.u))
SELECT CAST(u AS BIGINT) AS "user", CAST(q AS BIGINT) AS query_id, f AS feed FROM (SELECT * FROM qf UNION SELECT u, q, 'new' FROM big)""")
def widened_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select((F.col("user_id") % 20).alias("user"), F.col("event_type").alias("feed")).distinct()
    qf = s.filter("feed <> 'error' OR user % 2 = 0").select("user", (F.col("user") % 3).alias("query_id"), "feed")
    return masks.widened(qf, s, s.select("user", F.lit("new").alias("feed")).distinct())


@query(f"""WITH {_POSTS}, {_MATCHES}, hidden AS (SELECT feed, post_idx FROM posts WHERE NOT {_VISIBLE}), x AS (SELECT feed, post_idx FROM posts WHERE doc_id % 3 = 0 UNION SELECT * FROM hidden),
r AS (SELECT feed, post_idx, post_idx - row_number() OVER (PARTITION BY feed ORDER BY post_idx) AS g FROM x)
SELECT feed, CAST(min(post_idx) AS BIGINT) AS lo, CAST(max(post_idx) AS BIGINT) AS hi FROM r GROUP BY feed, g""")
def masks_over_read_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return masks.overlaid(p, masks.globally_visible(p, compiled(FILTERS)), read_posts(index(spark, sf_dir)))


# --- interval sets: per order, the line numbers of cheap and of discounted lines

_SETS = """a AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS x FROM lineitem WHERE l_quantity < 30),
b AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS x FROM lineitem WHERE l_discount >= 0.05)"""


def _islands(rel: str) -> str:
    return f"SELECT k, min(x) AS lo, max(x) AS hi FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM ({rel})) GROUP BY k, g"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    return tuple(ranges.from_items(li.filter(c), ["k"], "l_linenumber") for c in ("l_quantity < 30", "l_discount >= 0.05"))


@query(f"WITH {_SETS} {_islands('SELECT * FROM a')}")
def range_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir)[0]


@query(f"WITH {_SETS} {_islands('SELECT * FROM a UNION SELECT * FROM b')}")
def range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.union(*_sets(spark, sf_dir), ["k"])


@query(f"WITH {_SETS} {_islands('SELECT * FROM a INTERSECT SELECT * FROM b')}")
def range_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.intersection(*_sets(spark, sf_dir), ["k"])


@query(f"WITH {_SETS} {_islands('SELECT * FROM a EXCEPT SELECT * FROM b')}")
def range_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.difference(*_sets(spark, sf_dir), ["k"])


@query(f"WITH {_SETS} {_islands('SELECT * FROM a UNION SELECT k, e FROM (SELECT DISTINCT k FROM b), (SELECT unnest(generate_series(0, 6)) AS e) WHERE e <= k % 5 - 1')}")
def range_read_till(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return ranges.read_till(a, b.select("k").distinct().withColumn("end", F.col("k") % 5 - 1), ["k"], "end")


@query(f"WITH {_SETS} {_islands('SELECT a.k, x FROM a LEFT JOIN (SELECT DISTINCT k AS kb FROM b) ON k = kb WHERE kb IS NULL OR x > k % 5 - 1')}")
def range_clear_till(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return ranges.clear_till(a, b.select("k").distinct().withColumn("end", F.col("k") % 5 - 1), ["k"], "end")


@query(f"WITH {_SETS}, i AS ({_islands('SELECT * FROM a')}) SELECT k, CAST(sum(hi - lo + 1) AS BIGINT) AS size, count(*) AS ranges, max(hi) AS max_item FROM i GROUP BY k")
def range_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.sizes(_sets(spark, sf_dir)[0], ["k"])


@query(f"WITH {_SETS} SELECT l_orderkey AS k, l_linenumber, EXISTS (SELECT 1 FROM a WHERE a.k = l_orderkey AND a.x = l_linenumber) AS member FROM lineitem")
def range_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return ranges.member(items, _sets(spark, sf_dir)[0], ["k"], "l_linenumber")


@query(f"""WITH {_SETS}, s AS (SELECT k, list(x ORDER BY x) AS xs FROM a GROUP BY k), i AS ({_islands('SELECT * FROM a')}),
o AS (SELECT k, list([hi, hi - lo] ORDER BY lo DESC) AS o FROM i GROUP BY k)
SELECT k, CAST(rank() OVER (ORDER BY o) AS INTEGER) AS place FROM o""")
def range_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets ranked by their total order."""
    arrays = ranges.as_array(_sets(spark, sf_dir)[0], ["k"])
    keyed = arrays.select("k", ranges.order_key(F.col("ranges")).alias("o"))
    sizes = keyed.groupBy("o").agg(F.count("*").alias("n"), F.collect_list("k").alias("ks"))  # few different sets
    ranked = sizes.withColumn("place", (F.coalesce(F.sum("n").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int"))
    return ranked.select(F.explode("ks").alias("k"), "place")


# --- counters


@query(f"""WITH {_POSTS} SELECT feed, count(*) AS total, count(*) FILTER (read) AS read, arg_min(post_idx, (t, post_idx)) FILTER (NOT read) AS first_unread,
arg_max(post_idx, (t, post_idx)) FILTER (NOT read) AS last_unread FROM posts GROUP BY feed""")
def feed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.feed_counters(posts(spark, sf_dir, words=False).withColumn("read", F.expr("doc_id % 3 = 0 OR doc_id % 11 = 0")))


_FOLDERS = """c AS (SELECT source AS feed, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS read, CAST(sum(n_chars) AS BIGINT) AS comments, CAST(substr(source, 4) AS INTEGER) AS n FROM documents GROUP BY source),
x AS (SELECT *, n % 4 = 0 AS expanded, CASE WHEN n % 5 = 0 THEN [] WHEN n % 3 = 0 THEN ['red', 'blue'] ELSE ['blue'] END AS folders FROM c)"""


@query(f"""WITH {_FOLDERS}, e AS (SELECT *, unnest(folders) AS folder FROM x)
SELECT folder, CAST(sum(total) AS BIGINT) AS total, CAST(sum(read) AS BIGINT) AS read, CAST(sum(CASE WHEN expanded THEN comments ELSE 0 END) AS BIGINT) AS comments, count(*) AS feeds FROM e GROUP BY folder
UNION ALL SELECT NULL, CAST(sum(total) AS BIGINT), CAST(sum(read) AS BIGINT), CAST(sum(CASE WHEN expanded THEN comments ELSE 0 END) AS BIGINT), count(*) FROM x""")
def folder_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("feed")).agg(F.count("*").alias("total"), F.count_if(F.expr("doc_id % 3 = 0")).alias("read"), F.sum("n_chars").alias("comments"))
    d = d.withColumn("n", F.substring("feed", 4, 9).cast("int")).withColumn("expanded", F.expr("n % 4 = 0"))
    return counters.folder_rollup(d.withColumn("folders", F.expr("CASE WHEN n % 5 = 0 THEN array() WHEN n % 3 = 0 THEN array('red', 'blue') ELSE array('blue') END")))


@query("SELECT user_id, CAST(sum((event_type = 'view')::INT) AS BIGINT) AS subscribed, CAST(sum((event_type = 'click')::INT) AS BIGINT) AS scanning, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS error FROM events GROUP BY user_id")
def state_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(*map(F.lit, ("view", "subscribed", "click", "scanning", "error", "error")))[F.col("event_type")]
    rows = events(spark, sf_dir).withColumn("state", state)
    flags = rows.select("user_id", *counters.state_counters(rows))
    return flags.groupBy("user_id").agg(*(F.sum(c).alias(c) for c in ("subscribed", "scanning", "error")))


@query("""WITH t AS (SELECT 't' || (turn % 3) AS tag, conv_id, turn FROM conversations WHERE (conv_id + turn) % 2 = 0), p AS (SELECT tag, conv_id FROM t WHERE turn = 0),
r AS (SELECT t.* FROM t LEFT JOIN p ON p.tag = 't0' AND t.tag = p.tag AND t.conv_id = p.conv_id WHERE turn = 0 OR p.tag IS NULL)
SELECT tag, count(*) AS total, count(*) FILTER (conv_id % 10 = 0 OR conv_id % 4 = 0) AS read FROM r GROUP BY tag""")
def tag_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tagged items of one feed; the first turn is the post, the others its comments; tenth posts are unknown."""
    conv = table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 2 = 0")
    tagged = conv.select(F.concat(F.lit("t"), (F.col("turn") % 3).cast("string")).alias("tag"), F.lit("f").alias("feed"), F.col("conv_id").alias("post_idx"), F.expr("CASE WHEN turn > 0 THEN turn END").alias("comment_idx"), F.lit(True).alias("expanded"))
    known = table(spark, sf_dir, "conversations").filter("conv_id % 10 <> 0").select(F.lit("f").alias("feed"), F.col("conv_id").alias("post_idx"), F.expr("conv_id % 4 = 0").alias("read")).distinct()
    return counters.tag_counters(tagged, known)


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY user_id UNION ALL SELECT -1, 5)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n FROM a FULL JOIN b ON a.user_id = b.user_id WHERE coalesce(a.n, 0) IS DISTINCT FROM b.n""")
def changed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    count = lambda d: d.groupBy("user_id").agg(F.count("*").alias("n"))
    client = count(e.filter("event_id % 50 <> 0")).unionByName(spark.createDataFrame([(-1, 5)], "user_id long, n long"))
    return counters.changed(count(e), client, "user_id", ["n"])


# --- listings


@query(f"""WITH {_POSTS} SELECT feed, post_idx, t FROM posts WHERE (t, -CAST(substr(feed, 4) AS INTEGER), post_idx) < (1700000500, -3, 20)
ORDER BY t DESC, CAST(substr(feed, 4) AS INTEGER), post_idx DESC LIMIT 100""")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred posts that follow a cursor, newest first."""
    p = posts(spark, sf_dir, words=False).withColumn("feed_id", F.substring("feed", 4, 9).cast("int"))
    page = listing.merged(p, 100, point=(datetime.fromtimestamp(1_700_000_500, UTC), 3, 20))
    return page.select("feed", "post_idx", F.unix_seconds("time").alias("t"))


@query(f"""WITH {_POSTS}, o(feed, pos) AS (VALUES ('src7', 1), ('src3', 2), ('src12', 3))
SELECT feed, post_idx FROM posts LEFT JOIN o USING (feed) ORDER BY pos NULLS LAST, CAST(substr(feed, 4) AS INTEGER), t DESC, post_idx DESC LIMIT 120""")
def grouped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.createDataFrame([("src7", 1), ("src3", 2), ("src12", 3)], "feed string, pos int")
    return listing.grouped(posts(spark, sf_dir, words=False).withColumn("feed_id", F.substring("feed", 4, 9).cast("int")), order, 120).select("feed", "post_idx")


@query("""WITH f AS (SELECT DISTINCT source AS feed FROM documents), o(feed, pos) AS (VALUES ('src7', 1), ('src3', 2))
SELECT feed, CAST(row_number() OVER (ORDER BY CASE feed WHEN 'src9' THEN 1 WHEN 'src4' THEN 2 END NULLS LAST, pos NULLS LAST, feed) AS INTEGER) AS place FROM f LEFT JOIN o USING (feed)""")
def user_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "documents").select(F.col("source").alias("feed")).distinct()
    return listing.user_order(feeds, spark.createDataFrame([("src7", 1), ("src3", 2)], "feed string, pos int"), "feed", ["src9", "src4"])


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 + 1 AS n, sum(o_orderkey % 4 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders)
SELECT o_custkey, o_orderkey FROM s WHERE coalesce(b, 0) < 7""")
def visible_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items until seven are shown, each with its shown comments."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4 + 1).alias("n"))
    return listing.visible_budget(o, ["o_custkey"], [F.col("o_orderkey")], "n", 7).select("o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT user_id AS item_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(event_id % 7 AS INTEGER) AS feed_id FROM events WHERE event_type IN ('click', 'view')),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY t DESC, feed_id, event_id) AS n FROM e WHERE t <= 1706000000 AND t >= 1704500000)
SELECT item_id, t FROM r WHERE n = 1""")
def tag_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("event_type IN ('click', 'view')").select(F.col("user_id").alias("item_id"), F.unix_seconds("ts").alias("tag_time"), (F.col("event_id") % 7).cast("int").alias("feed_id"))
    return listing.tag_listing(e, 1_706_000_000, since=1_704_500_000).select("item_id", F.col("tag_time").alias("t"))


@query("SELECT o_custkey, o_orderkey, CAST(ceil(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) / 3.0) AS INTEGER) AS batch FROM orders")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return listing.batches(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 3).drop("o_orderdate")


@query("SELECT source AS feed, CAST(rank() OVER (ORDER BY CAST(substr(source, 4) AS INTEGER)) AS INTEGER) AS place FROM (SELECT DISTINCT source FROM documents)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "documents").select(F.col("source").alias("feed")).distinct()
    return feeds.select("feed", F.rank().over(Window.orderBy(listing.natural_key(F.col("feed")))).alias("place"))


# --- trees: turns answer the one before, every third the first


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") == 0, -1).when(F.col("turn") % 3 == 0, 0).otherwise(F.col("turn") - 1)
    return c.select(F.col("conv_id").alias("tree"), F.col("turn").alias("idx"), parent.cast("long").alias("parent_idx"), (100 - F.col("turn") % 2).cast("long").alias("time"), F.length("text").cast("long").alias("size"))


_WALK = """n AS (SELECT conv_id AS tree, turn AS idx, CASE WHEN turn = 0 THEN -1 WHEN turn % 3 = 0 THEN 0 ELSE turn - 1 END AS parent_idx, 100 - turn % 2 AS time, length(text) AS size FROM conversations),
w AS (SELECT tree, idx, 0 AS depth, [(time, idx)] AS path, [idx] AS ids, size FROM n WHERE parent_idx = -1
  UNION ALL SELECT n.tree, n.idx, w.depth + 1, list_append(w.path, (n.time, n.idx)), list_append(w.ids, n.idx), n.size FROM n JOIN w ON n.tree = w.tree AND n.parent_idx = w.idx)"""


@query(f"WITH RECURSIVE {_WALK} SELECT tree, idx, depth, CAST(row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS INTEGER) AS rank FROM w")
def tree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.preorder(_tree(spark, sf_dir)).select("tree", "idx", "depth", "rank")


@query(f"WITH RECURSIVE {_WALK} SELECT tree, idx FROM w WHERE list_contains(ids, 3)")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return trees.descendants(trees.paths(t), t.filter("idx = 3")).select("tree", "idx")


@query(f"WITH RECURSIVE {_WALK}, r AS (SELECT tree, idx, row_number() OVER (PARTITION BY tree ORDER BY path) AS k FROM w) SELECT r.tree, r.idx FROM r JOIN r p ON r.tree = p.tree AND p.idx = 2 AND r.k > p.k")
def tree_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return trees.below(trees.preorder(t), t.filter("idx = 2")).select("tree", "idx")


@query(f"WITH RECURSIVE {_WALK} SELECT tree, i AS idx, CAST(sum(size) AS BIGINT) AS size FROM (SELECT tree, unnest(ids) AS i, size FROM w) GROUP BY tree, i HAVING sum(size) <> 0")
def tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return trees.subtree_sums(trees.paths(t).join(t.select("tree", "idx", "size"), ["tree", "idx"]), "size")
