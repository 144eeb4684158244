"""Queries over the driver's tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, media, ngram_lm, packing, quality_rules, secrets, simhash, substring, url_filters
from .common import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    """Where the public tokenizer's file lies, on the driver as on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Rules of the URL filter, and sites that it blocks besides.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
BLOCKED_SITES = [f"{site}.example.{top}" for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, BLOCKED_SITES)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


@query
def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are written, and what is read back is decoded and stored as tensors."""
    return media.features(staged(media.stored(documents(spark, sf_dir)), "media"))


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.spans(documents(spark, sf_dir))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary())


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scored(documents(spark, sf_dir))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "__passages.n_words", "__passages.n_removed", F.sha2("__passages.kept", 256).alias("kept_sha256"))


_RULES = " AND ".join(f"(n_words < {r.min_words} OR (CAST({r.measure} AS DOUBLE) >= CAST({r.least} AS DOUBLE) * {r.per} AND CAST({r.measure} AS DOUBLE) <= CAST({r.most} AS DOUBLE) * {r.per}))" for r in quality_rules.RULES)
_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws.split()}))

SQL["op2_quality_rules"] = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM base WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
m AS (
  SELECT base.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda w: lower(w) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
         CAST(len(ls) AS BIGINT) AS n_lines
  FROM base LEFT JOIN reps ON base.doc_id = reps.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_RULES} AS kept FROM f
"""

_RULE_ROWS = ", ".join(f"('{k}', '{k.partition('/')[0]}', '{k[len(k.partition('/')[0]):]}', '{v}')" for k, v in URL_RULES.items())
_SITES = ", ".join(f"('{h}')" for h in BLOCKED_SITES)

SQL["op1_url_filter"] = rf"""
WITH rules(rule, h, p, verdict) AS (VALUES {_RULE_ROWS}), sites(h) AS (VALUES {_SITES}),
cut AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 2, 's') AS raw, regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)([^?#]*)', 3, 's') AS path FROM pages),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
fit AS (SELECT u.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.page_id),
bad AS (SELECT DISTINCT u.page_id FROM u JOIN sites s ON u.host = s.h OR ends_with(u.host, '.' || s.h))
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, CASE WHEN bad.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN fit ON u.page_id = fit.page_id LEFT JOIN bad ON u.page_id = bad.page_id
"""

SQL["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM c, (SELECT unnest(generate_series(0, 34)) AS k)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i WHERE gone.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
