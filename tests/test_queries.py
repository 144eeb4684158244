"""Every registered query with SQL equals DuckDB's answer on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from feedloom import queries, queries_accounts, queries_more  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, con, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_languages_are_found(spark, sf):
    rows = queries.QUERIES["detected_languages"](spark, sf).filter("detected IS NOT NULL").collect()
    assert len(rows) > 100 and sum(r.right for r in rows) >= 0.98 * len(rows)


def test_feed_round_trip(spark, sf):
    docs = {str(r.doc_id): r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["feed_round_trip"](spark, sf).collect()
    assert {r.guid for r in got} == set(docs)
    assert all(r.feed == docs[r.guid].source and r.t == 1_700_000_000 + int(r.guid) for r in got)


def test_opml_round_trip(spark, sf):
    got = {r.url: r for r in queries.QUERIES["opml_round_trip"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/customer.parquet").collect():
        x = got[f"http://example.org/{r.c_custkey}"]
        assert (x.user, x.title, x.folders) == (str(r.c_nationkey), r.c_name, "" if r.c_custkey % 3 == 0 else r.c_mktsegment)


def test_rows_only_queries(spark, sf):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, sf).count() > 0, name
