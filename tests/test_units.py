from __future__ import annotations

import io
import itertools
import random
import zipfile
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import dates, ids, text, url
from feedloom.operators import actions, catalog, listing, lookup, masks, merge, ordered, ranges, rollups, schedule, trees
from feedloom.plans import requests, textquery
from feedloom.sources import feeds, sinks
from feedloom.streaming import upsert


def values(spark, expressions: dict, row: str = "SELECT 1 AS one") -> dict:
    return spark.sql(row).select(*(e.alias(k) for k, e in expressions.items())).first().asDict()


# --- interval sets


def runs(items: set[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted(items):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


def test_range_algebra_equals_plain_sets(spark):
    r = random.Random(1)
    a = {k: {r.randint(0, 30) for _ in range(r.randint(0, 25))} for k in range(60)}
    b = {k: {r.randint(0, 30) for _ in range(r.randint(0, 25))} for k in range(60)}
    table = lambda s: spark.createDataFrame([(k, lo, hi) for k, x in s.items() for lo, hi in runs(x)], "k int, lo long, hi long")
    for op, plain in ((ranges.union, set.union), (ranges.intersection, set.intersection), (ranges.difference, set.difference)):
        got: dict = {}
        for row in op(table(a), table(b), ["k"]).collect():
            got.setdefault(row.k, []).append((row.lo, row.hi))
        for k in a:
            assert sorted(got.get(k, [])) == runs(plain(a[k], b[k]))
    assert ranges.from_items(ranges.to_items(table(a), ["k"]), ["k"], "item").exceptAll(ranges.canonical(table(a), ["k"])).count() == 0
    # the literal case: insert 1,4,1,7,3,6,1,2,6,0; delete 1; insert 5; delete 10
    empty = table({0: set()})
    items = lambda *xs: spark.createDataFrame([(0, x) for x in xs], "k int, x long")
    s = ranges.insert(empty, items(1, 4, 1, 7, 3, 6, 1, 2, 6, 0), ["k"], "x")
    s = ranges.delete(ranges.insert(ranges.delete(s, items(1), ["k"], "x"), items(5), ["k"], "x"), items(10), ["k"], "x")
    assert sorted((x.lo, x.hi) for x in s.collect()) == [(0, 0), (2, 7)]


@given(st.integers(-100, 100), st.integers(-100, 100), st.integers(1, 10))
@settings(max_examples=500, deadline=None)
def test_split_covers_the_range(s, e, step):
    first, whole, last = rollups.split_range(s, e, step)
    assert [*first, *(x for w in whole for x in range(w * step, (w + 1) * step)), *last] == list(range(s, e + 1))


# --- text queries


@pytest.mark.parametrize(
    ("query", "cleaned"),
    [("a/b", "a\\/b"), ("“x y”", '"x y"'), ("*foo", "foo"), ("?foo bar", "foo bar"), ("foo***", "foo*"), ("*", "*"), ("a ? b", "a * b"), ("tag:x", "tags:x"), ("link:https://www.a.b", "link:a.b"), ("so­ft", "soft"), ("a\\/b", "a\\/b"), ("(*x)", "(x)")],
)
def test_cleaning(query, cleaned):
    assert textquery.clean(query) == cleaned


def test_time_and_syntax(spark):
    assert textquery.is_time_based("x time:[now-1d TO *]") and not textquery.is_time_based("x now")
    assert textquery.check("a AND (b OR -c) tags:news") is None
    for bad in ("(a", "a AND", "nofield:x", "text:(author:x)", "OR a"):
        assert textquery.check(bad)


def test_matching(spark):
    rows = spark.createDataFrame([(1, "Red fox jumps"), (2, "red-brown dog"), (3, ""), (4, "fox red")], "id int, text string")
    rows = rows.withColumn("words", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    fields = textquery.Fields(F.col("words"), {"text": F.col("words")}, {}, {}, {})
    for q, want in {"red": {1, 2, 4}, '"red fox"': {1}, "fox OR dog": {1, 2, 4}, "red -fox": {2}, "f?x": {1, 4}, "br*": {2}, "red-brown": {2}, "": {1, 2, 3, 4}, "text:(fox jumps)": {1}, "NOT red": {3}}.items():
        assert {r.id for r in rows.filter(textquery.compiled(q, fields)).collect()} == want, q


# --- scalar functions


def test_dates(spark):
    want = datetime(2012, 11, 20, 5, 50, 1, tzinfo=UTC).timestamp()
    said = ["Tue, 20 Nov 2012 05:50:01 +0000", "20 Nov 2012 05:50:01 GMT", "20 Nov 2012 00:50:01 EST", "2012-11-20T05:50:01Z", "2012-11-20T07:50:01+02:00", "2012-11-20 05:50:01"]
    got = values(spark, {str(i): F.unix_seconds(dates.rfc822(F.lit(s))) for i, s in enumerate(said)})
    assert set(got.values()) == {want}
    more = values(spark, {"y": F.unix_seconds(dates.rfc3339(F.lit("2015"))), "s": F.unix_seconds(dates.rfc3339(F.lit("2015/1/20 16:29:00"))), "n": dates.rfc822(F.lit("rubbish")), "leap": dates.add_year(F.lit(datetime(2020, 2, 29))), "d": dates.clock_duration(F.lit("1:02:03")), "i": dates.iso_duration(F.lit("P1Y2M3DT4H5M6S")), "x": dates.iso_duration(F.lit("x"))})
    assert more["y"] == datetime(2015, 1, 1, tzinfo=UTC).timestamp() and more["s"] == datetime(2015, 1, 20, 16, 29, tzinfo=UTC).timestamp()
    assert more["n"] is None and (more["leap"].month, more["leap"].day) == (3, 1) and more["d"] == 3723
    assert more["i"] == 365 * 86400 + 2 * 30 * 86400 + 3 * 86400 + 4 * 3600 + 5 * 60 + 6 and more["x"] is None
    scan = values(spark, {str(a): dates.next_posts_scan(F.lit(float(a))) for a in (0, 7200, 86400 * 8)})
    assert scan["0"] == 900 and scan["7200"] == 2700 and round(scan[str(86400 * 8)]) == round(3600 * (2 + 8 / 30))


def test_urls(spark):
    assert url.normalised("feed://ExAmple.com:80/ä b?utm_source=x#f") == "http://example.com/%C3%A4%20b"
    for x in ("http://президент.рф/ä?q=я", "https://bücher.example/ß"):
        assert url.readable(url.normalised(x)) == x
    got = values(
        spark,
        {
            "host": url.host(F.lit("http://u:p@WWW.a.co.uk:81/x")), "dom": url.registered_domain(F.lit("www.a.co.uk")), "mask": url.masked_password(F.lit("http://u:p@h/")), "var": F.size(url.variants(F.lit("http://www.a.b/c"))),
            "red": url.unwrapped(F.lit("http://g.com/url?url=http%3A%2F%2Fa.b%2Fc&x=1")), "vid": url.video_id(F.lit("https://youtu.be/abcdefghijk"))["id"], "data": url.data_uri(F.lit("data:text/plain;base64,aGk="))["data"].cast("string"),
            "mail": url.email(F.lit(" A.b+x@GMail.com ")), "p": url.with_parameter(F.lit("http://a/?x=1&y=2#f"), "x", "3 4"), "rel": url.resolve(F.lit("http://a/b/c"), F.lit("../d")), "ref": url.meta_refresh(F.lit("<meta http-equiv=refresh content='0; url=http://x/'>")),
            "dom2": url.in_domain(F.lit("x.a.b"), "a.b"), "dom3": url.in_domain(F.lit("xa.b"), "a.b"),
        },
    )
    assert got == {"host": "www.a.co.uk", "dom": "a.co.uk", "mask": "http://u:***@h/", "var": 4, "red": "http://a.b/c", "vid": "abcdefghijk", "data": "hi", "mail": "ab@gmail.com", "p": "http://a/?y=2&x=3%204#f", "rel": "http://a/d", "ref": "http://x/", "dom2": True, "dom3": False}


def test_texts(spark):
    got = values(
        spark,
        {
            "short": text.first_words(F.lit("one two three four"), 9), "all": text.first_words(F.lit("one two"), 99), "long": text.first_words(F.lit("x" * 80), 20), "n": text.short_number(F.lit(1234)), "k": text.short_number(F.lit(3000)), "small": text.short_number(F.lit(949)),
            "dur": text.duration(F.lit(3723)), "size": text.file_size(F.lit(1536)), "one": text.file_size(F.lit(1)), "int": text.integer(F.lit(" 42 ")), "bad": text.integer(F.lit("4x")), "sent": text.sentences(F.lit("Is 3.5 it? Yes! so")), "words": text.words(F.lit("(Don't stop, x-ray! 5th a.b")),
            "tri": text.trigrams(F.lit("a-b")), "css": text.css(F.lit("Color: red; width:1px;color:blue")), "tag": text.tag(F.lit("01. News"), {"news": "news!"}), "b58": text.base58(F.unhex(F.lit("0000287fb4cd"))), "html": text.html_text(F.lit("<p>a &amp; b<br>c</p><script>x</script>")),
            "link": text.linkify(F.lit("see www.a.com. <b>")), "safe": text.sanitise(F.lit("<p onclick='x'>a</p><script>b</script>")), "ua": text.browser(F.lit("Mozilla Chrome/1 Safari/2")), "set": text.srcset(F.lit("a.png 1x, b.png 2x"))[1]["descriptor"], "nfc": text.nfc(F.lit("é")),
        },
    )
    assert got["short"] == "one two three …" and got["all"] == "one two" and got["long"] == "x" * 50 + "…"
    assert (got["n"], got["k"], got["small"], got["dur"], got["size"], got["one"], got["int"], got["bad"]) == ("1.2K", "3K", "949", "1:02:03", "2kB", "1 byte", 42, None)
    assert got["sent"] == ["Is 3.5 it?", "Yes!", "so"] and got["words"] == ["don't", "stop", "x-ray"] and got["tri"] == [" a ", "a b", " b "]
    assert got["css"] == {"color": "blue", "width": "1px"} and got["tag"] == "news!" and got["b58"] == "11233QC4" and got["html"] == "a & b\nc"
    assert got["link"] == 'see <a href="http://www.a.com">www.a.com</a>. &lt;b&gt;' and got["safe"] == "<p>a</p>" and got["ua"] == "Chrome" and got["set"] == "2x" and got["nfc"] == "é"


def test_openings(spark):
    assert text.opening("One two. Three four.\nNext one.", 100) == "One two. Three four. Next one."
    assert text.opening("One two. Three four.\nNext one.", 20) == "One two. Three four."
    assert text.opening("aa bb cc dd ee ff gg.", 9) == "aa bb cc dd …" and text.opening(None, 5) == ""
    assert values(spark, {"p": text.first_paragraph(F.lit("A b.\nC"), 50)})["p"] == "A b. C"


def test_ids(spark):
    rows = spark.createDataFrame([(0, 0, None), (5, 7, None), (5, 7, 0), (1, 2, 16383), (3, (1 << 26) - 1, 9)], "f long, p long, c long")
    got = rows.withColumn("item", ids.pack(F.col("f"), F.col("p"), F.col("c"))).withColumn("u", ids.unpack(F.col("item"))).collect()
    for r in got[1:]:
        assert tuple(r.u) == (r.f, r.p, r.c) and (r.item < 0) == (r.c is not None)
    assert got[0].item == 0 and got[0].u.comment == 0  # zero reads as a comment
    same = values(spark, {"e": ids.unescaped(ids.escaped(F.lit("a\\n\nb\\"))), "h": ids.content_hash(F.lit("x"))})
    assert same["e"] == "a\\n\nb\\" and len(same["h"]) == 27


# --- feeds

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>A &amp;amp; B</title><link>/home</link>
<item><guid>1</guid><title>One</title><link>/1</link><pubDate>Tue, 20 Nov 2012 05:50:01 +0000</pubDate><dc:creator>Me</dc:creator><category>x</category><category>x</category><description>short</description><content:encoded>&lt;p&gt;long&lt;/p&gt;</content:encoded><enclosure url="/a.mp3" type="audio/mpeg" length="5"/><enclosure url="/a.mp3"/></item></channel></rss>"""


def test_feed_parsers():
    f = feeds.feed(RSS, "http://h/x")
    i = f["items"][0]
    assert (f["kind"], f["title"], f["link"]) == ("rss", "A & B", "http://h/home")
    assert (i["guid"], i["link"], i["author"], i["tags"], i["body"], i["summary"]) == ("1", "http://h/1", "Me", ["x"], "<p>long</p>", "short")
    assert i["enclosures"] == [{"url": "http://h/a.mp3", "mime": "audio/mpeg", "size": 5}] and i["published"] == datetime(2012, 11, 20, 5, 50, 1, tzinfo=UTC)
    a = feeds.feed('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><link rel="hub" href="http://hub/"/><entry><id>e</id><title type="html">x &amp;lt; y</title><link href="p"/><updated>2012-11-20T05:50:01Z</updated><content type="xhtml"><b>z</b></content></entry></feed>', "http://h/")
    assert a["hub"] == "http://hub/" and a["items"][0]["subject"] == "x < y" and a["items"][0]["link"] == "http://h/p" and "z" in a["items"][0]["body"]
    assert feeds.feed("<rss><channel>", None)["error"] and feeds.feed(None, None)["kind"] == "" and feeds.sniffed(" {}") == "json" and feeds.sniffed("<!DOCTYPE html><html>") == "html"
    to, parse = feeds.route("https://www.reddit.com/r/x")
    assert to.endswith("/r/x/.json") and parse("{}", to)["items"] == []
    assert feeds.json_feed('{"title": "t", "items": [{"id": 1, "content_text": "c"}]}', "")["items"][0]["body"] == "c"


def test_opml_and_takeout():
    body = '<opml><body><outline text="F"><outline xmlUrl="u1" title="a"/></outline><outline text="G"><outline xmlUrl="u1"/></outline><outline xmlUrl="u2" text="b"/></body></opml>'
    assert feeds.subscriptions(body) == [{"url": "u1", "title": "a", "folders": ["F", "G"]}, {"url": "u2", "title": "b", "folders": []}]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x/subscriptions.xml", body)
    assert feeds.takeout(data.getvalue()) == body and feeds.takeout(b"no") is None
    assert feeds.text_of("é".encode("cp1251", "replace")) is not None and feeds.text_of(b'<?xml encoding="koi8-r"?>\xc1').endswith("а")
    info = feeds.page_info('<head><title> T </title><link rel=alternate type="application/rss+xml" href="/f"><meta property="og:image" content="i.png"><link rel="icon" href="a.ico"><link rel="icon" sizes="32x32" href="b.ico"></head>', "http://h/p/")
    assert (info["title"], info["feeds"][0]["url"], info["image"], info["icon"]) == ("T", "http://h/f", "http://h/p/i.png", "http://h/p/b.ico")


def test_reader_subscriptions(spark):
    row = 'SELECT \'{"subscriptions": [{"id": "feed/http://a", "title": "A", "categories": [{"label": "x"}]}, {"id": "user/1"}]}\' AS j'
    got = values(spark, {"s": feeds.reader_subscriptions(F.col("j"))}, row)["s"]
    assert [(s.url, s.title, s.folders) for s in got] == [("http://a", "A", ["x"])]


# --- operators


def test_redirects_and_orphans(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")], "url string, target string")
    got = {r.url: (r.end, r.loops) for r in trees.redirect_paths(links).collect()}
    assert got["a"] == ("c", False) and got["b"] == ("c", False) and got["x"][1] and got["y"][1] and got["s"][1]
    nodes = spark.createDataFrame([(1, 0, -1, 5), (1, 1, 0, 9), (1, 2, 0, 7), (1, 4, 3, 1)], "tree long, idx long, parent_idx long, time long")
    assert [r.idx for r in trees.preorder(nodes).orderBy("rank").collect()] == [0, 2, 1]


def test_trees_of_any_number_and_depth(spark):
    ids = lambda n: spark.range(n).select(F.col("id").alias("tree"), F.lit(0).alias("idx"), F.lit(-1).alias("parent_idx"), F.lit(0).alias("time"))
    assert trees.paths(ids(2_000_000)).filter("depth = 0").count() == 2_000_000
    chain = spark.range(5000).select(F.lit(1).alias("tree"), F.col("id").alias("idx"), (F.col("id") - 1).alias("parent_idx"), F.lit(0).alias("time"))
    ring = spark.createDataFrame([(2, 0, 1, 0), (2, 1, 0, 0), (2, 2, 1, 0), (2, 3, -1, 0), (2, 4, 3, 0)], chain.schema)
    got = {(r.tree, r.idx): r.depth for r in trees.paths(chain.unionByName(ring)).select("tree", "idx", "depth").collect()}
    assert got == {(1, i): i for i in range(5000)} | {(2, 3): 0, (2, 4): 1}
    assert trees.paths(chain.limit(0)).count() == 0


def test_stream_is_within_filters(spark, sf):
    from feedloom import queries as q

    p = q.posts(spark, sf)
    shown = masks.globally_visible(p, q.compiled(q.FILTERS)).select("feed", "post_idx")
    m = masks.stream_matches(p, q.compiled(q.STREAMS), q.compiled(q.FILTERS))
    assert m.join(shown, ["feed", "post_idx"], "left_anti").count() == 0


def test_duplicate_users_are_greedy(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    assert sorted(r.user for r in catalog.duplicate_users(pairs).collect()) == [2, 4, 6]


def _written(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def _subscriptions(spark, copies=3):
    """Lists near each other and apart, some of several users, with null feeds, null users and repeated rows."""
    rng = random.Random(7)
    lists = [sorted(rng.sample(range(12), rng.randint(1, 8))) for _ in range(40)] + [[None], [1, None], [1, 2, 3, 4, None], [100, 101]]
    rows = [(u, f) for u, x in enumerate(x for x in lists for _ in range(copies)) for f in x] + [(None, 1), (None, 2), (0, lists[0][0])]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "user long, feed long")


def _alike(rows, percent):
    own = {u: {f for v, f in rows if v == u} for u in {u for u, _ in rows} - {None}}
    both = {(a, b): len((own[a] & own[b]) - {None}) for a in own for b in own if a < b}
    return sorted((a, b, n, 100 * n // max(len(own[a]), len(own[b]))) for (a, b), n in both.items() if n and 100 * n >= percent * max(len(own[a]), len(own[b])))


@pytest.mark.parametrize("percent", [50, 70, 100])
def test_similar_users_equal_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(catalog, "GROUP", 2)
    monkeypatch.setattr(catalog, "TILE", 5)
    rows, subs = _subscriptions(spark)
    pairs = _alike(rows, percent)
    assert sorted(map(tuple, catalog.similar_users(subs, percent).collect())) == pairs
    gone = set()
    for a, b, *_ in pairs:
        if a not in gone:
            gone.add(b)
    assert sorted(r.user for r in catalog.duplicate_subscribers(subs, percent).collect()) == sorted(gone)


@pytest.fixture
def copies(spark, tmp_path):
    """Events of 700 users who all have the same ten feeds; joins shuffle, as they do on large tables."""
    path = str(tmp_path)
    users = spark.range(700).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    users.select("user_id", F.lit(datetime(2024, 1, 1)).alias("ts"), (F.col("k") * 4.0).alias("value")).write.parquet(f"{path}/events.parquet")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield path
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_pairs_of_similar_users_are_not_shuffled(spark, copies):
    from feedloom import queries, queries_more  # noqa: F401

    before = _written(spark)
    got = queries.QUERIES["similar_users"](spark, copies).agg(F.count("*").alias("n"), F.sum("shared").alias("shared")).first()
    assert (got.n, got.shared) == (700 * 699 // 2, 10 * 700 * 699 // 2)
    assert _written(spark) - before < 50_000


def test_duplicate_users_make_no_pairs_of_copies(spark, copies):
    from feedloom import queries, queries_more  # noqa: F401

    before = _written(spark)
    assert sorted(r.user for r in queries.QUERIES["duplicate_users"](spark, copies).collect()) == [*range(1, 700)]
    assert _written(spark) - before < 50_000


@pytest.fixture
def near_lists(spark):
    """Subscriptions of 600 users whose lists of 20 feeds all differ and are all alike; joins shuffle."""
    lists = [{*range(24)} - {*x} for x in itertools.islice(itertools.combinations(range(24), 4), 0, None, 17)][:600]
    rows = [(u, f) for u, x in enumerate(lists) for f in sorted(x)]
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield rows, spark.createDataFrame(rows, "user long, feed long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_lists_that_meet_everywhere_are_compared_once(spark, near_lists):
    rows, subs = near_lists
    before = _written(spark)
    assert sorted(map(tuple, catalog.similar_users(subs, 50).collect())) == _alike(rows, 50)
    assert _written(spark) - before < 40_000


@pytest.mark.parametrize(("words", "apart"), [(0, 1), (1, 1), (1, 40)])
def test_feeds_without_a_bit_count(spark, monkeypatch, words, apart):
    """Few words for the bits, and many small communities, which meet at their rare feeds."""
    monkeypatch.setattr(catalog, "WORDS", words)
    rows, _ = _subscriptions(spark, 1)
    rows = [(u + 100 * k, f if f is None else f + 200 * k) for k in range(apart) for u, f in rows if u is not None]
    own = _alike([x for x in rows if x[0] < 100], 70)
    want = sorted((a + 100 * k, b + 100 * k, n, same) for k in range(apart) for a, b, n, same in own)
    assert sorted(map(tuple, catalog.similar_users(spark.createDataFrame(rows, "user long, feed long"), 70).collect())) == want


def test_duplicates_of_different_lists_need_few_pairs(spark, monkeypatch, near_lists):
    monkeypatch.setattr(catalog, "BLOCK", 900, raising=False)
    before = _written(spark)
    assert sorted(r.user for r in catalog.duplicate_subscribers(near_lists[1]).collect()) == [*range(1, 600)]
    assert _written(spark) - before < 100_000


@pytest.mark.parametrize("block", [1, 40])
def test_duplicates_in_blocks_are_greedy(spark, monkeypatch, block):
    monkeypatch.setattr(catalog, "BLOCK", block, raising=False)
    rng = random.Random(3)
    rows = [(u, f) for u in range(24) for f in rng.sample(range(7), rng.randint(3, 6))]
    gone = set()
    for a, b, *_ in _alike(rows, 70):
        if a not in gone:
            gone.add(b)
    assert sorted(r.user for r in catalog.duplicate_subscribers(spark.createDataFrame(rows, "user long, feed long")).collect()) == sorted(gone)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, lo long, hi long")
    for op in (ranges.union, ranges.intersection, ranges.difference):
        assert op(none, none, ["k"]).count() == 0
    assert ordered.retained(spark.createDataFrame([], "feed string, post_idx int"))[0].count() == 0
    assert catalog.duplicate_users(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookups_and_schedule(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert [r.v for r in lookup.get_many(t, "k", ["b", "z", "a"]).collect()] == [2, None, 1]
    links = spark.createDataFrame([("https://www.a.b/c",), ("http://z/",)], "link string")
    known = spark.createDataFrame([("http://a.b/c",)], "guid string")
    assert [r.seen for r in lookup.by_variant(links, known, "link", "guid").orderBy("link").collect()] == [False, True]
    pages = spark.createDataFrame([("http://h/", "i", "f", "d"), ("http://h/x", "i", "g", "e")], "url string, image string, icon string, description string")
    got = {r.url: (r.image, r.icon, r.description) for r in lookup.without_site_parts(pages).collect()}
    assert got == {"http://h/": ("i", "f", "d"), "http://h/x": (None, "g", "e")}
    q = spark.createDataFrame([("h", "new", 1, "a"), ("h", "new", 2, "b"), ("h", "old", 0, "c")], "host string, kind string, time int, url string")
    assert [r.url for r in schedule.dispatch_order(q, {"new": 2, "old": 1}).orderBy("turn").collect()] == ["a", "b", "c"]
    assert values(spark, {"p": schedule.scanned_percent(F.lit(8), F.lit(3), F.lit(10)), "h": schedule.scanned_percent(F.lit(8), F.lit(3), F.lit(4000))}) == {"p": 37, "h": 100}


def test_merge_ties_go_to_the_earlier(spark):
    a, b = (spark.createDataFrame([(1, 5, s)], "k int, n int, s string") for s in ("left", "right"))
    assert merge.max_by(merge.replicas(a, b), ["k"], ["n"]).first().s == "left"


def test_upsert_state():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    s, frame = State(), lambda *rows: iter([pd.DataFrame(rows, columns=["feed", "guid", "hash", "seq"])])
    out = list(upsert.upsert(("f",), frame(("f", "a", "1", 1), ("f", "b", "1", 2), ("f", "a", "1", 3)), s))[0]
    assert out[["guid", "idx"]].values.tolist() == [["a", 0], ["b", 1]]
    out = list(upsert.upsert(("f",), frame(("f", "a", "2", 4), ("f", "c", "1", 5), ("f", "b", "1", 6)), s))[0]
    assert out[["guid", "idx", "hash"]].values.tolist() == [["a", 0, "2"], ["c", 2, "1"]]


def reader(spark, sf) -> requests.Reader:
    from feedloom import queries as q
    from feedloom.operators import model

    p = q.posts(spark, sf).withColumn("feed_id", F.substring("feed", 4, 9).cast("int"))
    feed_id = F.substring("feed", 4, 9).cast("int")
    subs = p.select("feed").distinct().withColumns({"title": F.col("feed"), "folders": F.when(feed_id < 5, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))})
    tagged = p.filter("doc_id % 10 = 0").select(ids.pack(F.col("feed_id"), F.col("post_idx")).alias("item_id"), F.lit("starred").alias("tag"), F.col("time").alias("tag_time"), "feed", "feed_id", "post_idx")
    return requests.Reader(p, model.feeds_of(p), q.read_posts(p), subs, tagged, q.fields(), [dict(f) for f in q.FILTERS], {"s": dict(q.STREAMS[0])})


def test_requests(spark, sf):
    r = reader(spark, sf)
    page = r.folder("low").collect()
    assert len(page) == 15 and page == sorted(page, key=lambda x: (-x.time.timestamp(), x.feed_id, -x.post_idx))
    last = page[-1]
    nxt = r.folder("low", requests.Page(after=(last.time, last.feed_id, last.post_idx))).collect()
    assert not {(x.feed, x.post_idx) for x in page} & {(x.feed, x.post_idx) for x in nxt}
    assert all(not x.read for x in r.stream("s", requests.Page(unread_only=True, size=500)).collect())
    bar = {(x.kind, x.name): (x.total, x.unread) for x in r.sidebar().collect()}
    assert bar["all", ""][0] == r.visible().count() and all(u >= 0 for _, u in bar.values())
    assert bar["folder", "low"][0] == sum(bar["feed", f"src{i}"][0] for i in range(5) if ("feed", f"src{i}") in bar)
    s = requests.Selection(streams=[requests.STARRED], without=[requests.READ])
    got = r.item_ids(s)
    assert r.contents(got.select("item_id")).count() == got.count() > 0
    assert r.search("the", ["src1"]).count() <= 15 and r.tag("starred", datetime(2030, 1, 1, tzinfo=UTC)).count() == 15
    assert requests.refresh_mode(datetime(2024, 1, 1, tzinfo=UTC), None, None, 1, False, False) == "full"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.save(df, f"{tmp_path}/t", ["k"], append=False)
    sinks.save(df.filter("v = 2").withColumn("v", F.lit(3)), f"{tmp_path}/t", ["k"], append=False)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 1), ("b", 3)]
    sinks.csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    assert sorted(r.json for r in sinks.json_items(df, ["k", "v"]).collect()) == ['{"k":"a","v":1}', '{"k":"b","v":2}']
    assert actions.surrogate_ids and listing.limit_of(None) == 20 and listing.limit_of(10**9, bodies=False) == 50_000
