"""Repeated passages by De Bruijn compaction.

Edges are the runs of SPAN words (the k-mers); an edge's nodes are its first and last SPAN - 1 words. Edges are dealt by
their minimiser (the least hash of the ANCHOR-word runs in them), so that equal edges meet, and travel as stretches of
successive edges with one minimiser: one source coordinate and a few bytes an edge. Where an edge has two sources or
more, it may be repeated, and the source of the least name is its pattern; successive such edges of a stretch with one
pattern are a segment. Segments that end and begin at one node, without a branch, are compacted to paths by Spark joins,
and what follows one another on a path in a text is one long span of it.

Spans are then verified at their source coordinates: the words of each, and those at its pattern's place, are hashed
anew, to 128 bits from the text's bytes. A span whose words differ from its pattern's is none.

Frequent passages crowd no task. Minimisers of more than HOT stretches (or a millionth of all, if that is more, so that
the list has a bound) are counted beforehand, and their edges dealt one by one, by their own hash. Of a stretch that a
task meets again, two sources travel; the others are settled where they are.

A row's name is a 64-bit hash of its id and text; rows whose names agree by chance share spans, and only those that
their own words bear out are applied. Defined results: null, empty and blank texts have no words and lose none. A text
of fewer than SPAN words loses none; very long texts are taken whole, by one worker. Rows with equal or null ids are
documents of their own: two equal rows of SPAN words or more repeat each other, and lose every word covered. All
occurrences go, the first included. Columns besides doc_id and text are not read, and stay whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free, partitions, staged, texts, tidy

SPAN = 35
#: Words of a minimiser; any SPAN words hold SPAN - ANCHOR + 1 runs of so many.
ANCHOR = 12
#: Words that a worker hashes at once, texts' bytes for each shard of edges, and edges of a stretch at most: its first and last edge cover all its words.
STEP, SHARD_BYTES, STRETCH = 200_000, 8 << 20, 32
#: Bytes of an edge's own hash that travel.
TAG = 6
#: Stretches of a minimiser from which its edges are dealt one by one, and the part of all stretches, if that is more.
HOT, HOT_PART = 5_000, 1_000_000
#: Stretches that a task remembers having sent.
SENT = 200_000
#: An occurrence: ref, first word << 32 | edges, segment, tail, tip, the pattern's ref and first word; 0 for no node.
FOUND = ("ref", "at", "segment", "tail", "tip", "pattern", "pattern_first")


class _Hashes(dict):
    """Words to 64-bit hashes; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit mix of two arrays of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the powers of two that it is made of."""
    out, done, power, width = None, 0, h, 1
    rest = size
    parts = []
    while rest:
        if rest & 1:
            parts.append((width, power))
        rest >>= 1
        if rest:
            power = _mix(power[:-width], power[width:]) if len(power) > width else power[:0]
            width *= 2
    for width, power in reversed(parts):
        if out is None:
            out, done = power, width
        else:
            n = max(0, len(h) - done - width + 1)
            out = _mix(out[:n], power[done : done + n])
            done += width
    return out


def _least(a: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` successive values."""
    width = 1
    while 2 * width <= size:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    if width < size:
        a = np.minimum(a[: len(a) - (size - width)], a[size - width :])
    return a


def stretches(docs: list[list[bytes]], span: int, anchor: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of edges: document, first word, edges, minimiser, first and last node; and all their edges' hashes in
    that order. Edges whose minimiser is in ``hot`` (sorted) are stretches of their own."""
    known = _hashes()
    sizes = np.array([len(ws) for ws in docs], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.uint64))
    if total < span:
        return none
    h = np.fromiter((known[w] for ws in docs for w in ws), np.uint64, total)
    edges, nodes = _runs(h, span), _runs(h, span - 1)
    least = _least(_runs(h, anchor), span - anchor + 1)
    doc = np.repeat(np.arange(len(docs)), sizes)[: len(edges)]
    at = np.flatnonzero(np.arange(len(edges)) + span <= ends[doc])  # edges within one document
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero((since % STRETCH == 0) | _among(least[at], hot))
    n = np.diff(np.append(first, len(at)))
    begin = at[first]
    return doc[begin], begin - (ends - sizes)[doc[begin]], n, least[begin], nodes[begin], nodes[begin + n], edges[at]


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _spread(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _number(first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A segment's number, by its first and last edge and its length."""
    return _mix(_mix(first, last), n.astype(np.uint64)).view(np.int64)


class _Sent:
    """Stretches that this task has sent with two sources, and the first of these; bounded."""

    def __init__(self) -> None:
        self.keys, self.refs, self.starts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.refs[at], self.starts[at]

    def add(self, keys: np.ndarray, refs: np.ndarray, starts: np.ndarray) -> None:
        if len(self.keys) + len(keys) > SENT:
            self.__init__()
            keys, refs, starts = keys[:SENT], refs[:SENT], starts[:SENT]
        keys, refs, starts = (np.append(old, new) for old, new in ((self.keys, keys), (self.refs, refs), (self.starts, starts)))
        self.keys, first = np.unique(keys, return_index=True)
        self.refs, self.starts = refs[first], starts[first]


_COLUMNS = ("shard", "least", "n", "sources", "nodes", "tags", "ref", "start", "found")


def _emit(refs: np.ndarray, docs: list[list[bytes]], shards: int, span: int, anchor: int, hot: np.ndarray, sent: _Sent) -> pa.RecordBatch | None:
    """One row per shard: equal stretches once, with two sources at most; and the other sources' occurrences, settled."""
    doc, start, n, least, tail, tip, edges = stretches(docs, span, anchor, hot)
    if not len(n):
        return None
    begin = np.cumsum(n) - n
    tagged = edges & np.uint64((1 << 8 * TAG) - 1)  # what the other end sees
    content = _mix(_mix(_mix(least ^ n.astype(np.uint64), edges[begin]), edges[begin + n - 1]), edges[begin + n // 2])
    shard = np.where(_among(least, hot), edges[begin] >> np.uint64(8), least >> np.uint64(8)) % np.uint64(shards)
    ref = refs[doc]
    order = np.lexsort((start, ref, content, shard))
    content, shard = content[order], shard[order]
    head = np.ones(len(order), bool)
    head[1:] = (content[1:] != content[:-1]) | (shard[1:] != shard[:-1])
    heads = np.flatnonzero(head)
    sources = np.diff(np.append(heads, len(order)))
    rank = _spread(sources)  # of a source among its stretch's
    before, ref0, start0 = sent.find(content[heads])
    rows: dict[str, list] = {k: [] for k in _COLUMNS}
    # sources that are settled here: the stretch went with two sources before, or goes with two now
    settled = np.flatnonzero(np.repeat(before, sources) | (rank >= 2))
    if len(settled):
        of = (np.cumsum(head) - 1)[settled]  # stretch
        own = order[settled]
        low = lambda x: (x & np.uint64((1 << 8 * TAG) - 1)).view(np.int64)
        keys = [_mix(least[own], tagged[at]) for at in (begin[own], begin[own] + n[own] - 1)]
        pattern = np.where(before[of], ref0[of], ref[order[heads[of]]])
        pattern_start = np.where(before[of], start0[of], start[order[heads[of]]])
        packed = np.stack([ref[own], start[own] << 32 | n[own], _number(*keys, n[own]), low(tail[own]), low(tip[own]), pattern, pattern_start], axis=1).astype("<i8")
        for at in range(0, len(packed), 4096):  # to any shards
            for k in rows:
                rows[k].append(b"")
            rows["shard"][-1], rows["found"][-1] = int(packed[at, 2]) % shards, packed[at : at + 4096].tobytes()
    twice = np.flatnonzero(~before & (sources >= 2))
    sent.add(content[heads[twice]], ref[order[heads[twice]]], start[order[heads[twice]]])
    heads, sources = heads[~before], np.minimum(sources[~before], 2)
    own = order[heads]  # a stretch for each content
    picked = np.repeat(begin[own], n[own]) + _spread(n[own])
    short = lambda x: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TAG]
    tags, nodes = short(edges[picked]), short(np.stack([tail[own], tip[own]], axis=1).ravel())
    kept = order[np.repeat(heads, sources) + _spread(sources)]
    of = shard[heads]
    bounds = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
    edge_at, source_at = np.append(0, np.cumsum(n[own])), np.append(0, np.cumsum(sources))
    least_, n_, sources_, ref_, start_ = least[own].astype("<u8"), n[own].astype(np.uint8), sources.astype(np.uint8), ref[kept].astype("<i8"), start[kept].astype("<u4")
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows["shard"].append(int(of[a]))
        rows["found"].append(b"")
        for k, x in (("least", least_[a:b]), ("n", n_[a:b]), ("sources", sources_[a:b]), ("nodes", nodes[2 * a : 2 * b]), ("tags", tags[edge_at[a] : edge_at[b]]), ("ref", ref_[source_at[a] : source_at[b]]), ("start", start_[source_at[a] : source_at[b]])):
            rows[k].append(x.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in _COLUMNS[1:])], list(_COLUMNS))


def _segments(t: pa.Table) -> pa.Table:
    """The repeated edges of a shard as segments, an occurrence for each of their sources (see FOUND).

    An edge's pattern is its source of the least name; that source itself has the next one for a pattern."""
    join = lambda k, kind: np.frombuffer(b"".join(t.column(k).to_pylist()), kind)

    def wide(k: str) -> np.ndarray:
        x = join(k, np.uint8).reshape(-1, TAG)
        return np.concatenate([x, np.zeros((len(x), 8 - TAG), np.uint8)], axis=1).reshape(-1).view("<u8")

    settled = join("found", "<i8").reshape(-1, len(FOUND))
    least, n, sources = join("least", "<u8"), join("n", np.uint8).astype(np.int64), join("sources", np.uint8).astype(np.int64)
    ref, start, tags, nodes = join("ref", "<i8"), join("start", "<u4").astype(np.int64), wide("tags"), wide("nodes").reshape(-1, 2)
    _, which = np.unique(least, return_inverse=True)
    alone = (np.bincount(which, sources * n) < 2)[which]  # one edge with this minimiser
    busy = np.flatnonzero(np.repeat(~alone, n))
    _, which = np.unique(_mix(np.repeat(least, n)[busy], tags[busy]), return_inverse=True)
    content, offset = np.repeat(np.arange(len(n)), n)[busy], _spread(n)[busy]
    many = np.bincount(which, sources[content]) >= 2 if len(which) else np.zeros(0, bool)
    twice = np.flatnonzero(many[which])
    busy, content, offset = busy[twice], content[twice], offset[twice]
    if not len(twice):
        return pa.table({k: pa.array(settled[:, i]) for i, k in enumerate(FOUND)})
    _, which = np.unique(which[twice], return_inverse=True)
    # a stretch's sources are sorted: its first and second
    at = np.cumsum(sources) - sources
    second = np.where(sources > 1, at + 1, at)
    order = np.lexsort((start[at[content]] + offset, ref[at[content]], which))
    heads = np.searchsorted(which[order], np.arange(int(which.max()) + 1))
    size = np.diff(np.append(heads, len(order)))
    best = order[heads]  # the edge that has the pattern
    other = order[np.where(size > 1, heads + 1, heads)]
    c1, c2 = content[best], content[other]
    by_second = (size < 2) | ((sources[c1] > 1) & (ref[second[c1]] <= ref[at[c2]]))  # the pattern's own pattern is its stretch's second source
    next_ref = np.where(by_second, ref[second[c1]], ref[at[c2]])
    next_first = np.where(by_second, start[second[c1]] + offset[best], start[at[c2]] + offset[other])
    is_best = best[which] == np.arange(len(which))
    pattern, pattern_first = ref[at[c1]][which], (start[at[c1]] + offset[best])[which]
    next_ref, next_first = next_ref[which], next_first[which]
    # segments: successive edges of a stretch with one pattern
    new = np.ones(len(busy), bool)
    step = lambda x, by: x[1:] != x[:-1] + by
    new[1:] = step(busy, 1) | step(content, 0) | step(pattern, 0) | step(pattern_first, 1) | step(is_best.astype(np.int8), 0)
    new[1:] |= is_best[1:] & (step(next_ref, 0) | step(next_first, 1))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(busy)))
    last = first + length - 1
    of, begin = content[first], offset[first]
    key = _mix(np.repeat(least, n)[busy], tags[busy])
    number = _number(key[first], key[last], length)
    copies = sources[of]
    rank = _spread(copies)
    source = np.repeat(at[of], copies) + rank
    itself = np.repeat(is_best[first], copies) & (rank == 0)
    each = lambda x: np.repeat(x, copies)
    node = lambda side, open_: each(np.where(open_, nodes[of, side].view(np.int64), 0))
    own = [
        ref[source],
        (start[source] + each(begin)) << 32 | each(length),
        each(number),
        node(0, begin == 0),
        node(1, begin + length == n[of]),
        np.where(itself, each(next_ref[first]), each(pattern[first])),
        np.where(itself, each(next_first[first]), each(pattern_first[first])),
    ]
    return pa.table({k: pa.array(np.append(x, settled[:, i])) for i, (k, x) in enumerate(zip(FOUND, own, strict=True))})


def compacted(segments: DataFrame) -> DataFrame:
    """segments(segment, tail, tip; 0 for no node) -> (segment, path): segments that follow one another at unbranched nodes.

    One join finds each segment's only successor; further ones double the pointers, twice a step, until all have reached their path's
    end. Paths that close upon themselves stay in segments."""
    own = segments.groupBy("segment").agg(F.max(F.nullif("tail", F.lit(0))).alias("tail"), F.max(F.nullif("tip", F.lit(0))).alias("tip"))
    one = lambda side: own.filter(F.col(side).isNotNull()).groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n"), F.first("segment").alias(side)).filter("n = 1")
    nexts = staged(one("tip").select("node", F.col("tip").alias("segment")).join(one("tail").select("node", F.col("tail").alias("next")), "node").select("segment", "next").filter("segment <> next"), "successors")
    now, rounds = nexts, max(1, nexts.count()).bit_length() // 2 + 2  # the last one moves nothing but rings
    for _ in range(rounds):
        to = now.select(F.col("segment").alias("next"), F.col("next").alias("after"))
        twice = now.join(to, "next", "left").select("segment", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("on"))
        far = twice.select(F.col("segment").alias("next"), F.col("next").alias("after"))
        moved = staged(twice.join(far, "next", "left").select("segment", F.coalesce("after", "next").alias("next"), (F.col("on") | F.col("after").isNotNull()).alias("more")), "paths")
        dropped(now)
        now = moved.select("segment", "next")
        if not moved.filter("more").limit(1).count():
            break
    else:  # what still moves is a ring
        ends = moved.filter("NOT more").select("segment", "next")
        return ends.select("segment", F.col("next").alias("path"))
    return now.select("segment", F.col("next").alias("path"))


def _ref() -> Column:
    """Names a row for the joins: equal rows have equal results."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def _batches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Rows' names and words, some rows at a time; rows of fewer than ``span`` words left out."""
    refs: list[int] = []
    held: list[list[bytes]] = []
    n = 0
    for b in batches:
        for ref, text in zip(b.column("ref").to_pylist(), texts(b), strict=True):
            ws = text.encode().split()  # bytes: split() knows ASCII white space only
            if len(ws) < span:
                continue
            refs.append(ref)
            held.append(ws)
            n += len(ws)
            if n >= STEP:
                yield refs, held
                refs, held, n = [], [], 0
    if held:
        yield refs, held


def frequent(rows: DataFrame, span: int, anchor: int, least: int = HOT, part: int = HOT_PART) -> np.ndarray:
    """Minimisers of more than ``least`` stretches, and of more than the ``part``-th part of all: ``part`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _batches(batches, span):
            keys, n = np.unique(stretches(held, span, anchor, np.zeros(0, np.uint64))[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["least", "n"])

    counted = rows.mapInArrow(tidy(count), "least long, n long").groupBy("least").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    counted = staged(counted, "minimisers")
    bound = max(least, (counted.agg(F.sum("n")).first()[0] or 0) // part)
    found = counted.filter(F.col("n") > bound).select("least").toArrow()
    dropped(counted)
    return np.sort(np.asarray(found.column("least"), np.int64).view(np.uint64))


def occurrences(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Sources of repeated edges, as segments (see FOUND)."""
    spark = docs.sparkSession
    rows = docs.select(_ref().alias("ref"), "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(2 * partitions(spark), -(-size // SHARD_BYTES))
    crowded = frequent(rows, span, anchor, hot)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent()
        for refs, held in _batches(batches, span):
            if out := _emit(np.array(refs, np.int64), held, shards, span, anchor, crowded, sent):
                yield out

    dealt = rows.mapInArrow(tidy(edges), "shard long, " + ", ".join(f"{k} binary" for k in _COLUMNS[1:]))
    return staged(dealt.groupBy("shard").applyInArrow(_segments, ", ".join(f"{k} long" for k in FOUND)), "segments")


def spans(found: DataFrame) -> DataFrame:
    """(ref, at, pattern, pattern_at): the long spans of each text (first word << 32 | edges), and where their patterns are."""
    paths = staged(compacted(found.select("segment", "tail", "tip")), "segment-paths")
    on = found.join(paths, "segment", "left")
    on = on.select("ref", F.coalesce("path", "segment").alias("path"), F.shiftright("at", 32).alias("first"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("n"), "pattern", "pattern_first")
    # where a path's segments do follow one another in a text, and in their pattern, they are one span of it
    in_text = Window.partitionBy("ref", "path", "pattern").orderBy(F.col("pattern_first") - F.col("first"), "first")
    before = lambda c: F.lag(c).over(in_text)
    goes_on = (before(F.col("first") + F.col("n")) == F.col("first")) & (before(F.col("pattern_first") - F.col("first")) == F.col("pattern_first") - F.col("first"))
    whole = on.repartition("ref").distinct().withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("span", F.sum("new").over(in_text))
    whole = whole.groupBy("ref", "path", "pattern", "span").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("pattern_first").alias("pattern_first"))
    at = lambda first: F.shiftleft(first, 32).bitwiseOR(F.col("n"))
    return whole.select("ref", at("first").alias("at"), "pattern", at("pattern_first").alias("pattern_at"))


def words_hash(ws: list[bytes], at: int, span: int) -> bytes:
    """128 bits of a span's words; of what there is of them, if the text is not that long."""
    first = at >> 32
    return xxhash.xxh3_128_digest(b" ".join(ws[first : first + (at & 0xFFFFFFFF) + span - 1]))


def refuted(joined: DataFrame, ref: str, text: str, own: str, asked: str, span: int) -> DataFrame:
    """(ref, at, hash) of spans whose words are not their patterns', with the hash of their own words.

    joined: texts with their names, spans (at, pattern, pattern_at) and the spans that others have for a pattern."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ws = (r["text"] or "").encode().split()
                out += [(r["ref"], x["at"], words_hash(ws, x["at"], span), x["pattern"], x["pattern_at"]) for x in r["own"] or ()]
                out += [(r["ref"], x, words_hash(ws, x, span), None, None) for x in r["asked"] or ()]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ref", "at", "hash", "pattern", "pattern_at"])

    rows = joined.filter(F.col(own).isNotNull() | F.col(asked).isNotNull()).select(F.col(ref).alias("ref"), F.col(text).alias("text"), F.col(own).alias("own"), F.col(asked).alias("asked"))
    told = staged(rows.mapInArrow(tidy(hashed), "ref long, at long, hash binary, pattern long, pattern_at long"), "span-hashes")
    keys = ["pattern", "pattern_at", "hash"]
    own_ = told.filter("pattern IS NOT NULL")
    patterns = told.filter("pattern IS NULL").select(F.col("ref").alias("pattern"), F.col("at").alias("pattern_at"), "hash").distinct()
    # as a rule there are none; spans of one frequent pattern are combined before they are dealt
    false = staged(own_.select(*keys).distinct().join(patterns, keys, "left_anti"), "false-patterns")
    wrong = own_.join(false, keys, "left_semi").select("ref", "at", "hash").distinct()
    if not false.limit(1).count():
        return wrong.limit(0)
    # of two patterns one may be right
    return wrong.join(own_.join(false, keys, "left_anti").select("ref", "at", "hash"), ["ref", "at", "hash"], "left_anti")


def strip(text: str | None, at: list[int] | None, span: int = SPAN, wrong: list[dict] | None = None) -> tuple[int, int, str]:
    """Words, words covered by the spans ``at``, but for those that are ``wrong`` in this very text, and the other words
    joined by spaces."""
    ws = (text or "").encode().split()
    if wrong:
        false = {(x["at"], bytes(x["hash"])) for x in wrong}
        at = [x for x in at or () if (x, words_hash(ws, x, span)) not in false]
    if not at:
        return len(ws), 0, b" ".join(ws).decode()
    gone = np.zeros(len(ws) + 1, np.int64)
    x = np.array(at, np.int64)
    np.add.at(gone, np.minimum(x >> 32, len(ws)), 1)
    np.add.at(gone, np.minimum((x >> 32) + (x & 0xFFFFFFFF) + span - 1, len(ws)), -1)
    kept = np.cumsum(gone)[:-1] == 0
    return len(ws), int(len(ws) - kept.sum()), b" ".join([w for w, k in zip(ws, kept.tolist(), strict=True) if k]).decode()


def deduplicated(docs: DataFrame, into: str = "__passages", span: int = SPAN, hot: int = HOT) -> DataFrame:
    """Adds the struct ``into``: n_words, n_removed, kept (text without repeated spans, words joined by one space)."""
    ref, own, asked, wrong = (free(docs, x) for x in ("ref", "own_spans", "asked_spans", "wrong_spans"))
    found = staged(spans(occurrences(docs, span, hot=hot)), "spans")
    told = found.groupBy(F.col("ref").alias(ref)).agg(F.collect_list(F.struct("at", "pattern", "pattern_at")).alias(own))
    asks = found.groupBy(F.col("pattern").alias(ref)).agg(F.collect_set("pattern_at").alias(asked))
    lists = staged(told.join(asks, ref, "full"), "span-lists")
    rows = docs.withColumn(ref, _ref())
    joined = staged(rows.join(lists, ref, "left").select(*rows.columns, own, asked), "span-texts")
    out = staged(refuted(joined, ref, "text", own, asked, span), "refuted")
    if out.limit(1).count():
        by_ref = out.groupBy(F.col("ref").alias(ref)).agg(F.collect_list(F.struct("at", "hash")).alias(wrong))
        joined = joined.join(by_ref, ref, "left")
    else:
        joined = joined.withColumn(wrong, F.lit(None).cast("array<struct<at:bigint,hash:binary>>"))

    @F.arrow_udf("n_words long, n_removed long, kept string")
    def cut(text: pa.Array, at: pa.Array, wrong: pa.Array) -> pa.Array:
        out = [strip(t, a, span, w) for t, a, w in zip(text.to_pylist(), at.to_pylist(), wrong.to_pylist(), strict=True)]
        n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])

    cut_ = cut("text", F.transform(own, lambda x: x["at"]), wrong)
    return joined.withColumn(into, cut_).drop(ref, own, asked, wrong)


def remove_passages(docs: DataFrame) -> DataFrame:
    """The documents with their columns; text (and n_chars, if there) without the repeated passages, unchanged where there are none."""
    into = free(docs, "passages")
    done = deduplicated(docs, into)
    cut = F.col(into)["n_removed"] > 0
    new = F.when(cut, F.col(into)["kept"]).otherwise(F.col("text"))
    out = done.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(into)
