"""Interval sets: rows (key..., lo, hi) of whole numbers, both ends included.

Canonical form: within a key, ranges in order, neither overlapping nor adjacent. Every operation returns it, so equal
sets are equal rows. Sets are never expanded to members: a range of a billion items is one row all the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merges overlapping and adjacent ranges by a running maximum; inverted ranges are empty."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    up = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(up.isNull() | (F.col("lo") > up + 1), 1).otherwise(0)
    runs = df.filter("lo <= hi").select(*keys, F.col("lo").cast("long"), F.col("hi").cast("long")).withColumn("_new", new)
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def from_items(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Gaps and islands: members to ranges."""
    items = df.select(*keys, F.col(item).cast("long").alias("_x")).distinct()
    w = Window.partitionBy(*keys).orderBy("_x")
    runs = items.withColumn("_run", F.col("_x") - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).drop("_run")


def to_items(df: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    return df.select(*keys, F.explode(F.sequence("lo", "hi")).alias(item))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return canonical(a.select(*keys, "lo", "hi").unionByName(b.select(*keys, "lo", "hi")), keys)


def _sweep(a: DataFrame, b: DataFrame, keys: list[str], wanted) -> DataFrame:
    """One sorted pass over both sets' boundaries: the stretches whose cover (in a, in b) is wanted."""

    def edges(df: DataFrame, side: str) -> DataFrame:
        both = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d"))))
        one = canonical(df, keys).select(*keys, both.alias("e"))
        return one.select(*keys, "e.at", *((F.col("e.d") if s == side else F.lit(0)).alias(s) for s in ("a", "b")))

    at = edges(a, "a").unionByName(edges(b, "b")).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("at")
    cover = at.select(*keys, "at", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"), F.lead("at").over(w).alias("next"))
    found = cover.filter(wanted(F.col("a") > 0, F.col("b") > 0) & F.col("next").isNotNull())
    return canonical(found.select(*keys, F.col("at").alias("lo"), (F.col("next") - 1).alias("hi")), keys)


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sweep(a, b, keys, lambda x, y: x & y)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _sweep(a, b, keys, lambda x, y: x & ~y)


def insert(df: DataFrame, items: DataFrame, keys: list[str], item: str) -> DataFrame:
    return union(df, items.select(*keys, F.col(item).alias("lo"), F.col(item).alias("hi")), keys)


def delete(df: DataFrame, items: DataFrame, keys: list[str], item: str) -> DataFrame:
    return difference(df, items.select(*keys, F.col(item).alias("lo"), F.col(item).alias("hi")), keys)


def read_till(df: DataFrame, till: DataFrame, keys: list[str], end: str) -> DataFrame:
    """Adds 0..end; a negative end adds nothing."""
    return union(df, till.select(*keys, F.lit(0).alias("lo"), F.col(end).alias("hi")), keys)


def clear_till(df: DataFrame, till: DataFrame, keys: list[str], end: str) -> DataFrame:
    """Removes 0..end; a negative end removes nothing."""
    return difference(df, till.select(*keys, F.lit(0).alias("lo"), F.col(end).alias("hi")), keys)


def sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Members, ranges and largest member of each set."""
    return df.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("size"), F.count("*").alias("ranges"), F.max("hi").alias("max_item"))


def member(items: DataFrame, df: DataFrame, keys: list[str], item: str, flag: str = "member", bin_size: int = 4096) -> DataFrame:
    """Adds ``flag``: whether the item lies in its key's set. Ranges are cut at bins, so the join is on equal values."""
    lo, hi = F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size)
    bins = df.select(*keys, "lo", "hi", F.explode(F.sequence(lo, hi)).alias("_bin"))
    bins = bins.select(*keys, "_bin", F.greatest("lo", F.col("_bin") * bin_size).alias("_lo"), F.least("hi", F.col("_bin") * bin_size + bin_size - 1).alias("_hi"))
    tables = bins.groupBy(*keys, "_bin").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_ranges"))
    x = F.col(item)
    joined = items.withColumn("_bin", F.floor(x / bin_size)).join(tables, [*keys, "_bin"], "left")
    inside = F.exists("_ranges", lambda r: (r["_lo"] <= x) & (x <= r["_hi"]))
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("_bin", "_ranges")


def order_key(ranges: Column) -> Column:
    """Sorts sets (arrays of struct lo, hi, in canonical form) from their last range on: by end, then by length."""
    return F.reverse(F.transform(ranges, lambda r: F.struct(r["hi"], r["hi"] - r["lo"])))


def as_array(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
