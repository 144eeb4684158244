"""Outputs: OPML, Atom and JSON documents, CSV histograms, partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")


def atom(posts: DataFrame) -> DataFrame:
    """One Atom document per feed, newest first; posts(feed, guid, subject, time, text)."""
    when = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.concat(F.lit("<entry><id>"), xml_escaped(F.col("guid")), F.lit("</id><title>"), xml_escaped(F.col("subject")), F.lit("</title><published>"), when, F.lit('</published><content type="html">'), xml_escaped(F.col("text")), F.lit("</content></entry>"))
    lists = posts.groupBy("feed").agg(F.reverse(F.sort_array(F.collect_list(F.struct("time", "guid", entry.alias("e"))))).alias("es"))
    body = F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>'), xml_escaped(F.col("feed")), F.lit("</title>"), F.array_join(F.col("es.e"), ""), F.lit("</feed>"))
    return lists.select("feed", body.alias("body"))


def opml(subs: DataFrame) -> DataFrame:
    """One OPML document per user: feeds without folder first, then folders by name, letters' case aside."""
    rows = subs.select("user", "url", "title", F.explode_outer("folders").alias("folder"))
    one = F.concat(F.lit('<outline type="rss" text="'), xml_escaped(F.col("title")), F.lit('" title="'), xml_escaped(F.col("title")), F.lit('" xmlUrl="'), xml_escaped(F.col("url")), F.lit('"/>'))
    listed = rows.groupBy("user", "folder").agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.lower("title").alias("k"), "url", one.alias("o"))))["o"], "").alias("o"))
    name = xml_escaped(F.col("folder"))
    block = F.when(F.col("folder").isNull(), F.col("o")).otherwise(F.concat(F.lit('<outline text="'), name, F.lit('" title="'), name, F.lit('">'), F.col("o"), F.lit("</outline>")))
    blocks = F.sort_array(F.collect_list(F.struct(F.col("folder").isNotNull().alias("f"), F.lower(F.coalesce("folder", F.lit(""))).alias("k"), "folder", block.alias("b"))))
    whole = listed.groupBy("user").agg(F.array_join(blocks["b"], "").alias("b"))
    return whole.select("user", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><opml version="1.0"><head><title>Subscriptions</title></head><body>'), "b", F.lit("</body></opml>")).alias("body"))


def json_items(posts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON objects."""
    return posts.select(F.to_json(F.struct(*columns)).alias("json"))


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save(df: DataFrame, path: str, by: list[str] | None = None, append: bool = True) -> None:
    """A Parquet table, partitioned where told; overwriting replaces only the partitions at hand."""
    w = df.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def vacuumed(table: DataFrame, expire: str, now) -> DataFrame:
    return table.filter(F.col(expire) >= F.lit(now))


def newest_per_link(messages: DataFrame) -> DataFrame:
    """What a link index keeps of repeated links."""
    return messages.groupBy("link").agg(F.max_by(F.struct(*[c for c in messages.columns if c != "link"]), "time").alias("_m")).select("link", "_m.*")
