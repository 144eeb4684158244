"""Trigram language detection.

A word's probability for a language is the product of its trigrams' relative frequencies; it is normalised over the
languages and summed over a text's words. A language is accepted if the text has enough words and it leads clearly.
Profiles are one row per trigram (bounded by the alphabet, and checked before they are broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import trigrams, words

MIN_WORDS, LEAD = 10, 3.0
#: Trigrams that a broadcast profile may have.
MOST_TRIGRAMS = 2_000_000


def train(texts: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, trigram, freq) over all texts."""
    w = texts.select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    # a word's trigrams are cut once, however often it is said
    return w.select("lang", F.explode(trigrams(F.col("w"))).alias("trigram"), "n").groupBy("lang", "trigram").agg(F.sum("n").alias("freq"))


def detect(texts: DataFrame, profile: DataFrame, key: str, text: str) -> DataFrame:
    """(key, detected, words): the language, or null where none leads; texts without words are left out."""
    langs = sorted(r["lang"] for r in profile.select("lang").distinct().collect())  # a handful
    total = profile.groupBy("lang").agg(F.sum("freq").alias("total"))
    share = profile.join(F.broadcast(total), "lang").select("trigram", "lang", (F.col("freq") / F.col("total")).alias("p"))
    wide = share.groupBy("trigram").pivot("lang", langs).agg(F.first("p"))
    if wide.count() <= MOST_TRIGRAMS:
        wide = F.broadcast(wide)
    per_word = texts.select(F.col(key), F.explode(words(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    # every distinct word is scored once; a language that lacks one of its trigrams is out
    marks = per_word.select("w").distinct().select("w", F.explode(trigrams(F.col("w"))).alias("trigram")).join(wide, "trigram", "left")
    product = lambda x: F.when(F.count(x) == F.count("*"), F.sum(F.ln(x))).alias(x)
    score = marks.groupBy("w").agg(*(product(x) for x in langs))
    top = F.greatest(*(F.col(x) for x in langs)) if len(langs) > 1 else F.col(langs[0])
    rel = score.select("w", *(F.coalesce(F.exp(F.col(x) - top), F.lit(0.0)).alias(x) for x in langs))
    whole = sum((F.col(x) for x in langs[1:]), F.col(langs[0]))
    rel = rel.select("w", *(F.coalesce(F.try_divide(F.col(x), whole), F.lit(0.0)).alias(x) for x in langs))
    sums = per_word.join(rel, "w").groupBy(key).agg(F.sum("n").alias("words"), *(F.sum(F.col(x) * F.col("n")).alias(x) for x in langs), *(F.sum(F.when(F.col(x) > 0, F.col("n")).otherwise(0)).alias(f"n_{x}") for x in langs))
    ranked = F.reverse(F.sort_array(F.array(*(F.struct(F.col(x).alias("s"), F.col(f"n_{x}").alias("n"), F.lit(x).alias("l")) for x in langs))))
    best, second = ranked[0], F.get(ranked, F.lit(1))
    sure = (F.col("words") >= MIN_WORDS) & (second.isNull() | ((best["s"] > LEAD * second["s"]) & (2 * best["n"] > second["n"])))
    return sums.select(key, F.when(sure, best["l"]).alias("detected"), "words")
