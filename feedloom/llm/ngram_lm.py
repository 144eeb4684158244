"""Language-model scores from an Elias-Fano n-gram trie of order three.

Level one holds the training words, level two the successors of each word, level three those of each bigram. A
successor is coded relative to its context: on level two as its word's number, on level three as its place among the
successors of the context's last word. Added to where the context before ends, they are monotone, as are sorted word
hashes, prefix sums of counts and pointers, and all are Elias-Fano coded; the probabilities of levels two and three are
absolute-discounted and quantised to 16 bits. An n-gram is found by its context's pointers and a successor search among
the codes between them.

p(w | a b) = (c(abw) - D) / c(ab) + D * kinds(ab) / c(ab) * p(w | b), likewise p(w | b) down to p(w) = (c(w) + 1) / (N + V + 1);
D is DISCOUNT. A text's first word has its beginning for a context, and no longer one.

Texts are read twice: to count words, and to write every text as the numbers of its words, from which all else is made.
Levels are files in the shared folder, one for each range of keys; workers map them into memory and read the pages that
they need, so what a worker holds is bounded by one batch of texts. Ranges are cut by token mass, inside a context too,
so frequent words and word pairs crowd no task; counts are combined per batch before the shuffle. The driver holds a
few numbers for each file. All counts cover the whole training set, without cut-offs.

Defined results: null, empty and blank texts are one end token; very long texts are one batch. A null id is in the
training set. With an empty training set every count is zero. Repeated rows and ids are documents of their own. Columns
besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, staged, tidy

FOLDS, HELD = 7, 2
DISCOUNT = 0.75
#: Bytes of text that a worker takes at once, and of text for each file of a level.
AT_ONCE, FILE_BYTES = 4 << 20, 16 << 20
#: The end token's hash: no word has a line break.
END = xxhash.xxh3_64_intdigest(b"\n")
#: Quantised log10 probabilities reach down to this.
DEEPEST = -16.0


#: Place of the r-th bit that is set, by byte and r.
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + 8 * [0])[:8] for b in range(256)], np.uint8).ravel()
#: The lowest and the highest bit of every byte of a word.
_LOWEST, _HIGHEST = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Probabilities by their codes.
_SHARES = 10 ** (np.arange(65536) * (DEEPEST / 65535))


class EliasFano:
    """A sorted array of unsigned 64-bit integers: low bits packed, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, x: np.ndarray) -> EliasFano:
        n = len(x)
        top = int(x[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        high = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-((top >> width) + n + 1) // 64) * 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
        if width:
            value, at = x & np.uint64((1 << width) - 1), np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, value << shift)
            over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
            np.bitwise_or.at(low, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
        return cls(n, width, low, words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.uint32)).astype(np.uint32))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        if self.width <= 57:  # lies in the eight bytes from its first on
            x = self._bytes()[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7))
        else:
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            x = self.low[word] >> shift
            over = shift + np.uint64(self.width) > np.uint64(64)
            x = np.where(over, x | self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), x)
        return x & np.uint64((1 << self.width) - 1)

    def _bytes(self) -> np.ndarray:
        """The eight bytes from each byte of the low bits on, as a number."""
        if not hasattr(self, "_eights"):
            self._eights = np.ndarray((self.low.nbytes - 7,), "<u8", self.low, 0, (1,))
        return self._eights

    def _select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the i-th (from 0) bit that is set, or not."""
        before = self.ones if one else self._zeros()
        word = np.searchsorted(before, i.astype(before.dtype), "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        bits = self.high[word] if one else ~self.high[word]
        rest = (i - before[word]).astype(np.uint64)
        upto = np.bitwise_count(bits.view(np.uint8)).view(np.uint64) * _LOWEST  # in each byte: set bits up to its end
        byte = np.bitwise_count(((rest * _LOWEST | _HIGHEST) - upto) & _HIGHEST) * np.uint64(8)  # bytes that end before it
        rest -= upto << np.uint64(8) >> byte & np.uint64(255)
        at = (bits >> byte & np.uint64(255)) << np.uint64(3) | rest & np.uint64(7)
        return word * 64 + byte.astype(np.int64) + _IN_BYTE[at.astype(np.int64)]

    def _next(self, at: np.ndarray, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the bit that is set, or not, after the i-th one, which is at ``at``."""
        bits = self.high[at >> 6] if one else ~self.high[at >> 6]
        rest = (bits >> (at & 63).astype(np.uint64)) >> np.uint64(1)
        out = at + 1 + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        if len(far := np.flatnonzero(rest == 0)):
            out[far] = self._select(i[far] + 1, one)
        return out

    def _zeros(self) -> np.ndarray:
        if not hasattr(self, "_cached"):
            self._cached = (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones).astype(np.uint32)
        return self._cached

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def get2(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th and the next."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = self._select(i, True)
        width = np.uint64(self.width)
        return (at - i).astype(np.uint64) << width | self._low(i), (self._next(at, i, True) - i - 1).astype(np.uint64) << width | self._low(i + 1)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Where each of ``x`` is, in [begin, end) if told; -1 where it is not."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        most = len(self.high) * 64 - int(self.ones[-1])
        known = high < most
        high = np.where(known, high, 0)
        before = np.maximum(high - 1, 0)
        at = self._select(before, False)
        first = np.where(high > 0, at - before, 0)
        last = np.where(high > 0, self._next(at, np.where(high > 0, before, 0), False) - high, at) if most > 1 else at
        if begin is not None:
            first, last = np.maximum(first, begin), np.minimum(last, end)
        last = np.where(known, np.minimum(last, self.n), first)
        low = x & np.uint64((1 << self.width) - 1)
        stop = last.copy()
        while (open_ := np.flatnonzero(first < last)).size:  # successor search among equal high bits
            mid = (first[open_] + last[open_]) // 2
            less = self._low(mid) < low[open_]
            first[open_] = np.where(less, mid + 1, first[open_])
            last[open_] = np.where(less, last[open_], mid)
        hit = np.flatnonzero(first < stop)
        out = np.full(len(x), -1)
        same = hit[self._low(first[hit]) == low[hit]]
        out[same] = first[same]
        return out


def _write(path: str, parts: dict[str, EliasFano | np.ndarray]) -> None:
    """One file with all arrays, put in place whole."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    head, arrays, at = {}, [], 0
    for k, x in parts.items():
        own = x.arrays() if isinstance(x, EliasFano) else [x]
        spec = []
        for a in own:
            spec.append((a.dtype.str, len(a), at))
            arrays.append(a)
            at += -(-a.nbytes // 8) * 8
        head[k] = {"n": getattr(x, "n", None), "width": getattr(x, "width", None), "arrays": spec}
    said = json.dumps(head).encode()
    said += b" " * (-(len(said) + 8) % 8)
    new = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(new) as f:
        f.write(len(said).to_bytes(8, "little") + said)
        for a in arrays:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    if store.get_file_info(name).type == fs.FileType.NotFound:
        store.move(new, name)
    else:  # another attempt of the same task was first
        store.delete_file(new)


@lru_cache(maxsize=4096)
def _mapped(path: str) -> dict:
    """The file's arrays, mapped into memory; from a store that cannot be mapped, by an unlinked local copy."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)
    if isinstance(store, fs.LocalFileSystem):
        whole = np.memmap(name, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as f, store.open_input_stream(name) as s:
            while part := s.read(1 << 22):
                f.write(part)
            f.flush()
            whole = np.memmap(f.name, np.uint8, "r")
    n = int.from_bytes(whole[:8].tobytes(), "little")
    out = {}
    for k, x in json.loads(whole[8 : 8 + n].tobytes()).items():
        own = [np.asarray(whole[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize]).view(kind) for kind, size, at in x["arrays"]]  # still mapped
        out[k] = EliasFano(x["n"], x["width"], *own) if x["width"] is not None else own[0]
    return out


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: first and last text, distinct hashes, every token's number among them, texts' ends."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(at, end - at)))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist
        empty = distinct.index("") if "" in distinct else -1  # what white space at a text's edge leaves
        which = np.asarray(coded.indices, np.int64)
        stops = np.cumsum(np.asarray(words.value_lengths(), np.int64))
        if empty >= 0:
            kept = which != empty
            stops = np.append(0, np.cumsum(kept))[stops]
            which = which[kept]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [*distinct, "\n"]), np.uint64, len(distinct) + 1)
        which = np.insert(which, stops, len(distinct))  # an end after each text
        yield at, end, hashes, which, stops + np.arange(1, len(stops) + 1)
        at = end


def _held(doc_ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD for i in doc_ids], bool)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


_BLOBS = "shard long, first decimal(20,0), steps binary, step_bytes int, counts binary, count_bytes int"


def _narrow(x: np.ndarray) -> tuple[bytes, int]:
    """As few bytes for each as the largest needs."""
    size = next(s for s in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * s)
    return x.astype(f"<u{size}").tobytes(), size


def _blobs(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Sorted keys and counts, a row for each shard."""
    from decimal import Decimal

    bounds = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
    rows = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows.append((int(shard[a]), Decimal(int(keys[a])), *_narrow(np.diff(keys[a:b])), *_narrow(counts[a:b])))
    kinds = [pa.int64(), pa.decimal128(20, 0), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "first", "steps", "step_bytes", "counts", "count_bytes"])


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [], []
    for r in t.to_pylist():
        steps = np.frombuffer(r["steps"], f"<u{r['step_bytes']}").astype(np.uint64)
        keys.append(np.cumsum(np.append(np.uint64(int(r["first"])), steps), dtype=np.uint64))
        counts.append(np.frombuffer(r["counts"], f"<u{r['count_bytes']}").astype(np.int64))
    return _sum(np.concatenate(keys), np.concatenate(counts))


def _groups(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(sorted_):
        return []
    bounds = [*np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])).tolist(), len(sorted_)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


class Words:
    """Level one: every training word's number and count."""

    def __init__(self, files: list[tuple[int, str, int, int]], shards: int) -> None:
        """files: shard, path, words, tokens."""
        self.files, self.shards = {s: (p, n) for s, p, n, _ in files}, shards
        self.firsts, self.tokens, at, mass = {}, {}, 0, 0
        for s, _, n, t in sorted(files):
            self.firsts[s], self.tokens[s] = at, mass
            at, mass = at + n, mass + t
        self.n, self.total = at, mass

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each hash's number (-1: unknown) and count."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        shard = _shard(hashes[order], self.shards)
        for a, b in _groups(shard):
            s = int(shard[a])
            if s not in self.files:
                continue
            level = _mapped(self.files[s][0])
            own = order[a:b]
            at = level["hashes"].find(hashes[own])
            own, at = own[at >= 0], at[at >= 0]
            number[own] = self.firsts[s] + at
            low, high = level["sums"].get2(at)
            count[own] = (high - low).astype(np.int64)
        return number, count

    def counts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words by their numbers, which are in order, 0 beyond the last; and the tokens of all words before."""
        out, before = np.zeros(len(numbers), np.int64), np.full(len(numbers), self.total, np.int64)
        for s, (path, n) in self.files.items():
            a, b = np.searchsorted(numbers, [self.firsts[s], self.firsts[s] + n])
            if b > a:
                sums, at = _mapped(path)["sums"], numbers[a:b] - self.firsts[s]
                low, high = (x.astype(np.int64) for x in sums.get2(at))
                out[a:b], before[a:b] = high - low, self.tokens[s] + low
        return out, before


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _texts(b: pa.RecordBatch) -> pa.Array:
    return b.column("text").fill_null("")


def words(docs: DataFrame, path: str, shards: int) -> Words:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            train = b.filter(pa.array(~_held(b.column("doc_id").to_pylist())))
            for _, _, hashes, which, _ in _tokens(_texts(train)):
                keys, counts = _sum(hashes, np.bincount(which, minlength=len(hashes)))
                yield _blobs(keys[counts > 0], counts[counts > 0], _shard(keys[counts > 0], shards))

    def put(key: tuple, t: pa.Table) -> pa.Table:
        keys, counts = _merged(t)
        name = f"{path}/words-{key[0].as_py()}"
        _write(name, {"hashes": EliasFano.of(keys), "sums": EliasFano.of(np.append(0, np.cumsum(counts)).astype(np.uint64))})
        return pa.table({"shard": [key[0].as_py()], "path": [name], "n": [len(keys)], "tokens": [int(counts.sum())]})

    made = docs.mapInArrow(tidy(count), _BLOBS).groupBy("shard").applyInArrow(put, "shard long, path string, n long, tokens long")
    return Words([tuple(r) for r in made.collect()], shards)  # a row for each file


#: What the driver holds of a file of level two or three.
_FILE = ("first_context", "first_kinds", "last_context", "last_kinds", "widest", "n", "mass")


class Successors:
    """Level two or three: the successors of every context, a word or a bigram by its number."""

    def __init__(self, width: int, files: list[dict]) -> None:
        """width: more than any successor's code."""
        self.width = width
        self.files = sorted(files, key=lambda f: f["first"])
        self.firsts = np.array([f["first"] for f in self.files], np.uint64)
        self.begins = np.cumsum([0, *(f["n"] for f in self.files)])
        self.masses = np.cumsum([0, *(f["mass"] for f in self.files)])
        self.n, self.mass = int(self.begins[-1]), int(self.masses[-1])
        kinds: dict[int, list[int]] = {}
        self.skipped = []  # successors that a file's first context has in earlier files
        for f in self.files:
            self.skipped.append(sum(kinds.get(f["first_context"], [])))
            kinds.setdefault(f["first_context"], []).append(f["first_kinds"])
            if f["last_context"] != f["first_context"]:
                kinds.setdefault(f["last_context"], []).append(f["last_kinds"])
        self.split = {c: sum(k) for c, k in kinds.items() if len(k) > 1}  # contexts in more files than one

    def find(self, context: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs in order: the discounted share, the context's kinds of successors, the n-gram's number and its
        place among its context's successors (-1: unknown)."""
        share, kinds = np.zeros(len(context)), np.zeros(len(context), np.int64)
        number, place = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        if not len(context) or not self.files:
            return share, kinds, number, place
        key = context.astype(np.uint64) * np.uint64(self.width) + code.astype(np.uint64)
        file = np.maximum(np.searchsorted(self.firsts, key, "right") - 1, 0)
        for a, b in _groups(file):
            i = int(file[a])
            f, level = self.files[i], _mapped(self.files[i]["path"])
            own = context[a:b]
            new = np.append(True, own[1:] != own[:-1])
            each, back = own[new], np.cumsum(new) - 1
            inside = (each >= f["first_context"]) & (each <= f["last_context"])
            local = np.clip(each - f["first_context"], 0, level["pointers"].n - 2)
            begin, end = (x.astype(np.int64) for x in level["pointers"].get2(local))
            end = np.where(inside, end, begin)
            kinds[a:b] = (end - begin)[back]
            low, high = level["successors"].get2(np.maximum(begin - 1, 0))
            base = np.where(begin > 0, low + np.uint64(1), np.uint64(0))
            asked = code[a:b].astype(np.uint64) + base[back]
            at = np.where((kinds[a:b] == 1) & (np.where(begin > 0, high, low)[back] == asked), begin[back], -1)  # the only successor
            more = np.flatnonzero(kinds[a:b] > 1)
            at[more] = level["successors"].find(asked[more], begin[back[more]], end[back[more]])
            hit = np.flatnonzero(at >= 0)
            at = at[hit]
            share[a + hit] = _SHARES[level["shares"][at]]
            number[a + hit] = self.begins[i] + at
            place[a + hit] = at - begin[back[hit]] + np.where(own[hit] == f["first_context"], self.skipped[i], 0)
        for c, n in self.split.items():
            kinds[slice(*np.searchsorted(context, [c, c + 1]))] = n
        return share, kinds, number, place

    def counts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams by their numbers, which are in order, and the mass of all before."""
        out, before = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for a, b in _groups(np.searchsorted(self.begins, numbers, "right") - 1):
            i = int(np.searchsorted(self.begins, numbers[a], "right") - 1)
            sums, at = _mapped(self.files[i]["path"])["sums"], numbers[a:b] - self.begins[i]
            low, high = (x.astype(np.int64) for x in sums.get2(at))
            out[a:b], before[a:b] = high - low, self.masses[i] + low
        return out, before


class Model:
    """The trie, and the number of training texts."""

    def __init__(self, words: Words, pairs: Successors, triples: Successors, texts: int) -> None:
        self.words, self.pairs, self.triples, self.texts = words, pairs, triples, texts


_NUMBERED = "held_out boolean, n_tokens long, n_known long, base_score double, numbers binary"


def numbered(docs: DataFrame, level: Words) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, and the numbers of the text's words and end (unsigned, in 4 or
    8 bytes; level.n + 1: unknown)."""
    kind = _number_kind(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_all = np.log10(level.total + level.n + 1.0)
        for b in batches:
            ids, held = b.column("doc_id"), _held(b.column("doc_id").to_pylist())
            for at, end, hashes, which, ends in _tokens(_texts(b)):
                number, count = level.find(hashes)
                first = np.append(0, ends[:-1])
                add = lambda x, first=first: np.add.reduceat(x, first)
                own = (np.log10(count + 1.0) - log_all)[which]
                coded = np.where(number >= 0, number, level.n + 1).astype(kind)[which].tobytes()
                size = np.dtype(kind).itemsize
                parts = [coded[size * i : size * j] for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(held[at:end]), pa.array(ends - first), pa.array(add((count > 0)[which].astype(np.int64))), pa.array(add(own)), pa.array(parts, pa.binary())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "numbers"],
                )

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_NUMBERED}")


def _number_kind(level: Words) -> str:
    return "<u4" if level.n + 2 < 1 << 32 else "<u8"


def _sequences(batches: Iterator[pa.RecordBatch], level: Words) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some texts at a time: their rows, all words' numbers, and where texts begin."""
    kind = _number_kind(level)
    size = np.dtype(kind).itemsize
    for whole in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(whole.column("numbers")), np.int64)) if whole.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE * size // 6, "right")))
            b = whole.slice(at, end - at)
            word = np.frombuffer(b"".join(b.column("numbers").to_pylist()), kind).astype(np.int64)
            first = (np.append(0, sizes[at : end - 1]) - (sizes[at - 1] if at else 0)) // size
            first[0] = 0
            yield b, word, first
            at = end


def _place(before: np.ndarray, own: np.ndarray, part: np.ndarray, shards: int, mass: int) -> np.ndarray:
    """Shards of n-grams by the mass before their contexts, cut further by their successors."""
    return np.minimum((before + own * part) * (shards / max(mass, 1)), shards - 1).astype(np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each given one's place among them."""
    keys = keys.astype(np.uint64)
    room = (len(keys) - 1).bit_length() if len(keys) else 0
    if len(keys) and int(keys.max()).bit_length() + room <= 64:  # sorted with their places, which is faster than argsort
        both = np.sort(keys << np.uint64(room) | np.arange(len(keys), dtype=np.uint64))
        order, keys = (both & np.uint64((1 << room) - 1)).astype(np.int64), both >> np.uint64(room)
    else:
        order = np.argsort(keys)
        keys = keys[order]
    first, place = _runs(keys)
    back = np.empty(len(keys), np.int64)
    back[order] = place
    return keys[first], back


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and each value's run."""
    new = np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _pairs_of(context: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of places in order, and each given one's place among them."""
    width = int(code.max()) + 1
    keys, back = _distinct(context * width + code)
    return (keys // np.uint64(width)).astype(np.int64), (keys % np.uint64(width)).astype(np.int64), back


def _bigrams_of(word: np.ndarray, first: np.ndarray, level: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in order and each one's place among them; distinct words (and the beginning) likewise."""
    each, at = _distinct(np.append(word, level.n))
    context = np.append(at[-1], at[:-2])
    context[first] = at[-1]
    of, to, back = _pairs_of(context, at[:-1])
    each = each.astype(np.int64)
    return each[of], each[to], back, each, at[:-1]


def _written(counted: DataFrame, width: int, path: str, name: str, total_of) -> list[dict]:  # noqa: ANN001
    """Files of a level from batches' counts by shard; ``total_of`` gives the counts of contexts in order."""
    spec = "path string, first decimal(20,0), " + ", ".join(f"{k} long" for k in _FILE)

    def put(key: tuple, t: pa.Table) -> pa.Table:
        from decimal import Decimal

        keys, counts = _merged(t)
        of, code = (keys // np.uint64(width)).astype(np.int64), keys % np.uint64(width)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        kinds = np.diff(np.append(first, len(of)))
        share = (counts - DISCOUNT) / np.repeat(total_of(of[first]), kinds)
        codes = np.rint(np.clip(np.log10(share) / DEEPEST, 0, 1) * 65535).astype("<u2")
        last = code[first + kinds - 1] + np.uint64(1)
        base = np.cumsum(last, dtype=np.uint64) - last  # where the context before ends
        pointers = np.zeros(int(of[-1] - of[0]) + 2, np.int64)
        pointers[of[first] - of[0] + 1] = kinds
        file = f"{path}/{name}-{key[0].as_py()}"
        sums = np.append(0, np.cumsum(counts)).astype(np.uint64)
        _write(file, {"successors": EliasFano.of(code + np.repeat(base, kinds)), "pointers": EliasFano.of(np.cumsum(pointers).astype(np.uint64)), "sums": EliasFano.of(sums), "shares": codes})
        row = {"path": file, "first": Decimal(int(keys[0]))} | dict(zip(_FILE, (int(of[0]), int(kinds[0]), int(of[-1]), int(kinds[-1]), int(kinds.max()), len(keys), int(counts.sum())), strict=True))
        return pa.Table.from_pylist([row], pa.schema([("path", pa.string()), ("first", pa.decimal128(20, 0)), *((k, pa.int64()) for k in _FILE)]))

    made = counted.groupBy("shard").applyInArrow(put, spec)
    return [r.asDict() | {"first": int(r["first"])} for r in made.collect()]  # a row for each file


def bigrams(rows: DataFrame, level: Words, texts: int, path: str, shards: int) -> Successors:
    """Level two, from the numbers of training texts."""
    width, mass = level.n + 2, level.total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, word, first in _sequences(batches, level):
            of, to, back, *_ = _bigrams_of(word, first, level)
            begin, at = _runs(of)
            each = of[begin]
            own, mass_before = level.counts(each)
            own = np.where(each == level.n, texts, own)
            keys = of.astype(np.uint64) * np.uint64(width) + to.astype(np.uint64)
            yield _blobs(keys, np.bincount(back, minlength=len(of)), _place(mass_before[at], own[at], to / float(width), shards, mass + texts))

    total = lambda of: np.where(of == level.n, texts, level.counts(of)[0])
    return Successors(width, _written(rows.mapInArrow(tidy(count), _BLOBS), width, path, "pairs", total))


def trigrams(rows: DataFrame, level: Words, pairs: Successors, path: str, shards: int) -> Successors:
    """Level three, from the numbers of training texts."""
    width = max([*(f["widest"] for f in pairs.files), *pairs.split.values(), 0]) + 1  # places, and one that is none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, word, first in _sequences(batches, level):
            of, to, back, *_ = _bigrams_of(word, first, level)
            _, _, number, place = pairs.find(of, to)
            later = np.ones(len(word), bool)
            later[first] = False
            later = np.flatnonzero(later)
            if not len(later):
                continue
            of, to, again = _pairs_of(back[later - 1], back[later])
            context, code = number[of], place[to]
            begin, at = _runs(context)
            own, mass_before = pairs.counts(context[begin])
            keys = context.astype(np.uint64) * np.uint64(width) + code.astype(np.uint64)
            yield _blobs(keys, np.bincount(again, minlength=len(context)), _place(mass_before[at], own[at], code / float(width), shards, pairs.mass))

    return Successors(width, _written(rows.mapInArrow(tidy(count), _BLOBS), width, path, "triples", lambda of: pairs.counts(of)[0]))


def _trained(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows that are not held out, and all rows by numbers."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(partitions(spark), -(-size // FILE_BYTES))
    path = new_path(spark, "ngrams")
    level = words(rows, path, shards)
    told = staged(numbered(rows, level), "numbers", "zstd")
    train = told.filter("NOT held_out").select("numbers")
    texts = train.count()
    pairs = bigrams(train, level, texts, path, 2 * shards) if level.n else Successors(2, [])
    triples = trigrams(train, level, pairs, path, 3 * shards) if level.n else Successors(2, [])
    return Model(level, pairs, triples, texts), told


def trained(docs: DataFrame) -> Model:
    return _trained(docs.select("doc_id", "text"))[0]


def _log10_p(m: Model, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Every token's log10 probability."""
    level, pairs, triples = m.words, m.pairs, m.triples
    of, to, back, each, at = _bigrams_of(word, first, level)
    own = level.counts(np.minimum(each, level.n))[0] * (each < level.n)
    p = ((own + 1.0) / (level.total + level.n + 1.0))[at]
    count = np.append(0, own[at][:-1])
    count[first] = m.texts

    def mixed(p: np.ndarray, share: np.ndarray, kinds: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.where((kinds > 0) & (count > 0), share + DISCOUNT * kinds / np.maximum(count, 1) * p, p)

    share, kinds, number, place = pairs.find(of, to)
    p = mixed(p, share[back], kinds[back], count)
    seen = np.append(-1, number[back][:-1])  # the bigram before
    seen[first] = -1
    later = np.flatnonzero(seen >= 0)
    if len(later):
        second = back[later]
        of, to, back = _pairs_of(back[later - 1], np.where(place[second] >= 0, second, len(place)))
        context = number[of]
        share, kinds, *_ = triples.find(context, np.append(place, triples.width - 1)[to])
        begin, at = _runs(context)
        p[later] = mixed(p[later], share[back], kinds[back], pairs.counts(context[begin])[0][at][back])
    return np.log10(p)


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select("doc_id", "text")
    m, told = (model, staged(numbered(rows, model.words), "numbers", "zstd")) if model else _trained(rows)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, word, first in _sequences(batches, m.words):
            score = np.add.reduceat(_log10_p(m, word, first), first)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names[:4]), pa.array(np.full(b.num_rows, m.words.total)), b.column("base_score"), pa.array(score)], names)

    return told.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
