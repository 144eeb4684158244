"""SimHash near-duplicates: tiled exact comparison by numpy exclusive-or and bit counts.

Equal fingerprints are one node (a combine before the shuffle), so groups of exact copies cost nothing further. Nodes
fall into tiles by the population counts of their two halves; tiles are cut into chunks of CHUNK nodes at most. Two
fingerprints within the radius differ in each half's count by no more than in its bits, so a tile pair whose counts
differ by more than the radius in sum is never formed; within a pair, the same bound on the four quarters skips
blocks. What remains is compared exactly. A pair's links go out as a spanning forest: as many rows at most as the
pair has nodes, whatever the number of links, and the same components.

The work is a fixed share of all pairs of different fingerprints, as an exact tiled comparison must be; at any size it
is spread over chunk pairs of bounded memory.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other. A document of one or
two words has its whole sequence for a shingle. Rows with a null id get their component's smallest id, null where it has
none. Repeated rows and ids are rows of their own. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free, staged, texts, tidy
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Nodes of a chunk; a chunk pair holds twice as many, 2 MB. A chunk travels once for each pair that it is in.
CHUNK = 131_072
_STEP = 65_536
_HALF = np.uint64(0xFFFFFFFF)
_QUARTERS = [np.uint64(0xFFFF << 16 * k) for k in range(4)]


def fingerprint(text: str, seed: int = SEED, size: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - size + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = words[at : at + _STEP + size - 1]
        h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int, find: dict) -> None:
    """Unites in ``find`` what is linked between the blocks ``a`` and ``b``."""
    step = max(1, (1 << 20) // len(b))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        near = np.bitwise_count(part[:, None] ^ b[None, :]) <= radius
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        cols = np.flatnonzero(near.any(axis=0))
        near = near[np.ix_(rows, cols)]
        label = np.arange(len(cols))
        while True:  # smallest label around, rows and columns in turn
            of_row = np.where(near, label[None, :], len(cols)).min(axis=1)
            new = np.minimum(label, np.where(near, of_row[:, None], len(cols)).min(axis=0))
            new = new[new]
            if (new == label).all():
                break
            label = new
        for x, r in zip(b[cols].tolist(), b[cols[label]].tolist(), strict=True):
            _unite(find, x, r)
        for x, r in zip(part[rows].tolist(), b[cols[of_row]].tolist(), strict=True):
            _unite(find, x, r)


def _root(find: dict, x: int) -> int:
    while (up := find.setdefault(x, x)) != x:
        find[x] = find[up]
        x = find[x]
    return x


def _unite(find: dict, x: int, y: int) -> None:
    x, y = _root(find, x), _root(find, y)
    if x != y:
        find[max(x, y)] = min(x, y)


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct quarter counts, and the fingerprints that have each."""
    counts = np.stack([np.bitwise_count(fp & q) for q in _QUARTERS], axis=1).astype(np.int16)
    keys, which = np.unique(counts, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.argsort(which, kind="stable")
    return keys, np.split(fp[order], np.cumsum(np.bincount(which, minlength=len(keys)))[:-1])


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within chunk ``a``, or between ``a`` and ``b``."""
    find: dict[int, int] = {}
    ka, xa = _blocks(a)
    kb, xb = _blocks(b) if b is not None else (ka, xa)
    for i in range(len(ka)):
        apart = np.abs(kb - ka[i]).sum(axis=1)
        for j in np.flatnonzero(apart <= radius):
            if b is not None or j >= i:
                _forest(xa[i], xb[j], radius, find)
    return [(x, r) for x in find if (r := _root(find, x)) != x]


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """nodes(fp long, distinct) -> edges (u, v) whose components are those of all links."""
    half = lambda n: F.bit_count(F.shiftrightunsigned("fp", 32) if n else F.col("fp").bitwiseAND(0xFFFFFFFF))
    tiled = nodes.select("fp", half(1).alias("hi"), half(0).alias("lo"))
    sizes = {(r["hi"], r["lo"]): r["n"] for r in tiled.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 33 * 33 rows at most
    chunks = {t: math.ceil(n / chunk) for t, n in sizes.items()}
    if not chunks:
        return nodes.sparkSession.createDataFrame([], "u long, v long")
    parts = F.create_map(*[F.lit(x) for (hi, lo), n in chunks.items() for x in (hi * 64 + lo, n)])
    chunked = tiled.withColumn("part", F.pmod(F.xxhash64("fp"), parts[F.col("hi") * 64 + F.col("lo")]).cast("int"))
    packed = staged(chunked.groupBy("hi", "lo", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    first = dict(zip(chunks, accumulate([0, *chunks.values()]), strict=False))  # a tile's first chunk number
    total = sum(chunks.values())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk once for every chunk pair that it is part of."""
        for b in batches:
            for i in range(b.num_rows):
                hi, lo, part = (b.column(k)[i].as_py() for k in ("hi", "lo", "part"))
                own = first[hi, lo] + part
                with_ = [first[t] + p for dh in range(-radius, radius + 1) for dl in range(abs(dh) - radius, radius - abs(dh) + 1) if (t := (hi + dh, lo + dl)) in chunks for p in range(chunks[t])]
                keys = [min(own, x) * total + max(own, x) for x in with_]
                fps = b.column("fps").slice(i, 1)
                for k in keys:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), fps], ["pair", "fps"])

    def compare(t: pa.Table) -> pa.Table:
        """One chunk against itself, or two against each other."""
        fp = [np.asarray(x.values, np.int64).view(np.uint64) for x in t.column("fps")]
        found = linked(*fp) if len(fp) == 2 else linked(fp[0], None)
        u, v = (np.array([e[k] for e in found], np.uint64).view(np.int64) for k in (0, 1))
        return pa.table({"u": u, "v": v})

    return packed.mapInArrow(tidy(pairs), "pair long, fps array<long>").groupBy("pair").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = staged(fingerprints(docs), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), radius))
    rooted = staged(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    dropped(nodes)
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = staged(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that of the smallest id, and of rows with that id the one of the smallest text hash."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), key.alias("key"))
    own_key, once, best_id, best_key = (free(docs, x) for x in ("key", "once", "best_id", "best_key"))
    best = near_duplicates(docs.select(own.alias("doc_id"), "text")).select("component_id").distinct()
    best = staged(best.select(F.col("component_id.id").alias(best_id), F.col("component_id.key").alias(best_key)), "kept")
    rows = docs.withColumn(own_key, key).join(best, F.col("doc_id").eqNullSafe(F.col(best_id)) & (F.col(own_key) == F.col(best_key)), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", own_key).orderBy(own_key))
    return rows.withColumn(once, rank).filter(F.col(once) == 1).drop(own_key, once)
