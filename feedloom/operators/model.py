"""Messages, feeds and read state in Spark tables.

A message is a post (comment_idx null) or a comment of one; feeds hold lo (first retained post) and hi (last); read
state is a table of ranges (kind: post, comment, ignored); masks are rows with a state (ok or error) and an expanded
flag: collapsed masks let a post decide for its comments, expanded ones list comments, and may list none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE_SECONDS = 1_700_000_000


def post_index(docs: DataFrame) -> DataFrame:
    """(doc_id, source, post_idx): each source's documents numbered from 0 by doc_id, in a window of two columns."""
    idx = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return docs.select("doc_id", "source", idx.cast("int").alias("post_idx"))


def posts_of_documents(docs: DataFrame, words: bool = True) -> DataFrame:
    """documents as posts: feed = source, idx from 0 by doc_id, time = a fixed base + doc_id seconds.

    Texts are not sorted by feed to be numbered: what a query asks of them is answered before the join with the index,
    and only the columns that are left move. The words come out of a generator of one row: predicates on them stay above
    it, so a text is split once however often a query names its words."""
    rows = docs.select("doc_id", "source", "lang", "text", F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("doc_id")).alias("time"), "n_chars")
    if words:
        split = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
        rows = rows.select("*", F.explode(F.array(split)).alias("words"))
    return rows.join(post_index(docs), ["doc_id", "source"]).withColumnRenamed("source", "feed")


def comments_of_conversations(conv: DataFrame) -> DataFrame:
    """conversations as comment trees: post = conv_id, idx = turn, each turn below the one before it."""
    return conv.select(F.col("conv_id").alias("post_idx"), F.col("turn").alias("idx"), (F.col("turn") - 1).alias("parent_idx"), "role", "text")


def feeds_of(posts: DataFrame) -> DataFrame:
    return posts.groupBy("feed").agg(F.min("post_idx").alias("lo"), F.max("post_idx").alias("hi"), F.count("*").alias("posts"), F.max("time").alias("max_time"))


def retained(posts: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` posts of each feed."""
    w = Window.partitionBy("feed").orderBy(F.col("post_idx").desc())
    return posts.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
