"""URL filters by a Bloom filter cascade.

Listed keys (rules and blocked hosts) are encoded by the first filter; its false positives over the complete set of
keys that the corpus holds by the second; the listed keys that pass that one by the third, and so on until none is
left. For every key of the corpus the answer is then exact, and rows are judged without a join.

The first filter's rate is the listed keys' share of the universe, so about as many false positives as listed keys come
to the driver and every later filter is no larger: what is broadcast is bounded by the list (LISTED keys at most, some
bytes each) and grows with the logarithm of the corpus only. The universe is one distinct aggregate with map-side
combine; a hot host is one key of it.

Defined results: a null url, or one without ://, has empty host and path, no rule, and is allowed. Rows are judged one
by one, so repeated rows, null ids and very long urls need no care; an empty table gives an empty result, an empty list
of rules or hosts fits nothing. Columns besides page_id and url are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

#: Listed keys at most.
LISTED = 1_000_000
SEED = 42  # of Spark's xxhash64
SECOND = "second"
_SEED2 = xxhash.xxh64_intdigest(SECOND, SEED)


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(SECOND), key)


def hashed(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What ``hashes`` gives in the JVM."""
    b = [k.encode() for k in keys]
    return np.array([xxhash.xxh64_intdigest(k, SEED) for k in b], np.uint64), np.array([xxhash.xxh64_intdigest(k, _SEED2) for k in b], np.uint64)


class Bloom:
    def __init__(self, h1: np.ndarray, h2: np.ndarray, rate: float, salt: int) -> None:
        n = max(1, len(h1))
        self.salt = np.uint64(salt)
        self.probes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(n * self.probes / math.log(2)))
        self.bits = np.zeros(self.size, bool)
        for at in self._places(h1, h2):
            self.bits[at] = True
        self.bits = np.packbits(self.bits)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        """The level's salt makes every level's probes independent of the others'."""
        a = (h1 ^ (h2 * (self.salt * np.uint64(2) + np.uint64(1)))) * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(29)
        b = (h2 + a * self.salt) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
        for k in range(self.probes):
            x = a + np.uint64(k) * b
            yield ((x ^ (x >> np.uint64(32))) % np.uint64(self.size)).astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self._places(h1, h2):
            out &= (self.bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return out


class Cascade:
    """Exact over the listed keys and the universe that it was made for."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, alive = np.zeros(len(h1), bool), np.arange(len(h1))
        for n, level in enumerate(self.levels):
            alive = alive[level.holds(h1[alive], h2[alive])]
            out[alive] = n % 2 == 0  # passing a level of listed keys says yes until the next one passes too
        return out


def build(listed: list[str], universe: DataFrame) -> Cascade:
    """universe(h1 long, h2 long, distinct): every key of the corpus."""
    if len(listed) > LISTED:
        raise ValueError(f"more than {LISTED} listed keys")
    if not listed:
        return Cascade([])
    yes = hashed(listed)
    rate = min(0.5, max(1e-9, len(listed) / max(1, universe.count())))
    own = set(zip(*(x.tolist() for x in yes), strict=True))
    bound = 4 * len(listed) + 1000
    while True:  # as a rule once: about as many false positives as listed keys are expected
        first = Bloom(*yes, rate, 1)

        def passing(batches: Iterator[pa.RecordBatch], first: Bloom = first) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h1, h2 = (np.asarray(b.column(k), np.int64).view(np.uint64) for k in (0, 1))
                at = np.flatnonzero(first.holds(h1, h2))
                at = [i for i in at.tolist() if (int(h1[i]), int(h2[i])) not in own]
                yield b.take(pa.array(at, pa.int64()))

        wrong = universe.select("h1", "h2").mapInArrow(passing, "h1 long, h2 long").limit(bound + 1).toArrow()
        if wrong.num_rows <= bound:
            break
        rate /= 8
    no = tuple(np.asarray(wrong.column(k), np.int64).view(np.uint64) for k in (0, 1))
    levels, inside, outside = [first], no, yes
    while len(inside[0]):
        levels.append(Bloom(*inside, 0.5, len(levels) + 1))
        at = levels[-1].holds(*outside)
        inside, outside = tuple(x[at] for x in outside), inside
    return Cascade(levels)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", ascii_lower).withColumn("path", F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def candidates(host: Column, path: Column, listed: list[str]) -> Column:
    """Every key that could fit: the host's last labels with the path's beginnings, of the lengths that the list has."""
    if not listed:
        return F.array().cast("array<string>")
    hosts, paths = zip(*((k.partition("/")[0], k[len(k.partition("/")[0]) :]) for k in listed), strict=True)
    most, lengths = max(h.count(".") + 1 for h in hosts), sorted({len(p) for p in paths})
    labels = F.split(host, r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(labels))), lambda k: F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k)))
    begins = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(ends, lambda e: F.transform(begins, lambda b: F.concat(e, b))))


def judged(pages: DataFrame, rules: dict[str, str], blocked: list[str]) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule's, else block where a blocked host fits, else allow."""
    listed = list(dict.fromkeys([*rules, *blocked]))
    rows = with_parts(pages.select("page_id", "url")).select("page_id", "host", "path")
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), listed))
    pair = lambda k: F.struct(*(h.alias(n) for h, n in zip(hashes(k), ("h1", "h2"), strict=True)))
    universe = staged(rows.select(F.explode("keys").alias("k")).select(pair(F.col("k")).alias("h")).select("h.h1", "h.h2").distinct(), "universe")
    cascade = build(listed, universe)
    dropped(universe)

    @F.arrow_udf("array<boolean>")
    def holds(h1: pa.Array, h2: pa.Array) -> pa.Array:
        flat = [np.asarray(h.flatten(), np.int64).view(np.uint64) for h in (h1, h2)]
        ends = np.append(0, np.cumsum(np.asarray(h1.value_lengths().fill_null(0))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cascade.holds(*flat)))

    told = rows.withColumn("in", holds(F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])))
    hits = F.filter("keys", lambda k, i: F.get(F.col("in"), i))
    told = told.withColumn("hits", hits)
    of_rules = F.filter("hits", lambda k: k.isin(list(rules)))
    told = told.withColumn("rule", F.aggregate(of_rules, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a)))
    verdicts = F.create_map(*[F.lit(x) for kv in (rules or {"": ""}).items() for x in kv])
    method = F.when(F.size("hits") > 0, "block").otherwise("allow")
    return told.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")]).otherwise(method).alias("verdict"))
