"""BPE encoding by a pair occurrence index, and decoding.

A batch's texts are cut at ASCII white space, which no token of the vocabulary spans; each distinct piece is encoded
once. For the distinct words of these, the index maps every adjacent symbol pair that has a merge rank to
all its positions; a heap yields the active ranks in ascending order, and each merge updates the lists of the two
pairs it makes. The result is that of merging the lowest-ranked, leftmost pair of each word again and again.

Defined results: null and empty texts have no ids and decode to the empty text. Texts that hold a special token's
string give that token's id, as the library does by default. Rows are encoded one by one: repeated rows and ids, null
ids and empty tables need no care, and columns besides doc_id and text are not read. The memory of a worker is bounded
by ``CACHE`` pieces of some 30 bytes each and ``AT_ONCE`` bytes of text (or one text), whatever the input's size; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import tidy

#: Distinct pieces that a worker remembers, and bytes of text that it takes at once.
CACHE, AT_ONCE = 2_000_000, 6 << 20

#: Pieces that normalising only lower-cases, and how such pieces fall into words.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def merge_pairs(words: list[list[int]], ranks: dict[int, tuple[int, int]]) -> list[list[int]]:
    """Merges ``words`` (lists of symbol ids) by ``ranks``: left << 32 | right -> (rank, merged id)."""
    sym: list[int] = []
    word: list[int] = []
    starts: list[int] = []
    for n, w in enumerate(words):
        starts.append(len(sym))
        sym += w
        sym.append(-1)  # ends the word
        word += [n] * (len(w) + 1)
    nxt = list(range(1, len(sym) + 1))
    prv = list(range(-1, len(sym) - 1))
    index: dict[int, list[int]] = {}
    active: list[tuple[int, int]] = []
    get = ranks.get

    def note(pair: int, at: int) -> int:
        found = get(pair)
        if found is None:
            return -1
        if pair in index:
            index[pair].append(at)
        else:
            index[pair] = [at]
            heapq.heappush(active, (found[0], pair))
        return found[0]

    for i in range(len(sym) - 1):
        if sym[i] >= 0 and sym[i + 1] >= 0:
            note(sym[i] << 32 | sym[i + 1], i)
    while active:
        rank, pair = heapq.heappop(active)
        left, right, new = pair >> 32, pair & 0xFFFFFFFF, ranks[pair][1]
        later: list[int] = []
        stopped: set[int] = set()  # words in which a pair of a lower rank came up: that one is next there
        for p in sorted(index.pop(pair)):
            q = nxt[p]
            if sym[p] != left or sym[q] != right:
                continue
            if word[p] in stopped:
                later.append(p)
                continue
            sym[p] = new
            sym[q] = -2
            r = nxt[q]
            nxt[p] = r
            prv[r] = p
            before = prv[p]
            if sym[r] >= 0 and -1 < note(new << 32 | sym[r], p) < rank:
                stopped.add(word[p])
            if before >= 0 and sym[before] >= 0 and -1 < note(sym[before] << 32 | new, before) < rank:
                stopped.add(word[p])
        if later:
            index[pair] = later
            heapq.heappush(active, (rank, pair))
    out = []
    for p in starts:
        ids = []
        while sym[p] != -1:
            ids.append(sym[p])
            p = nxt[p]
        out.append(ids)
    return out


def _hashed(strings: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, one after the other."""
    done = np.cumsum(sizes)
    return np.repeat(starts - (done - sizes), sizes) + np.arange(int(done[-1]) if len(done) else 0)


class Store:
    """Id sequences by 64-bit hash, in a few plain arrays."""

    def __init__(self, id_type: str) -> None:
        self.keys, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, id_type)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each is known, where its ids start, and how many they are."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.starts[at].astype(np.int64), self.sizes[at].astype(np.int64)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if not len(keys):
            return
        starts = (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.uint32)
        self.ids = np.append(self.ids, ids.astype(self.ids.dtype))
        order = np.argsort(keys, kind="stable")  # few new ones among many
        keys = keys[order]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.starts, starts[order]), (self.sizes, sizes[order].astype(np.uint32))))


class Encoder:
    """Encodes and decodes as the library does with the vocabulary file ``path``.

    ``by_index``: distinct pieces by ``merge_pairs``, else by the library itself.
    """

    def __init__(self, path: str, by_index: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.by_index = by_index
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ranks = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.ranks.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, self.vocab[a + b]))
        self.id_type = "<u2" if max(self.tokens) < 1 << 16 else "<u4"
        self.known, self.merged = Store(self.id_type), Store(self.id_type)  # of pieces and of words
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        others = [b for b in range(256) if b not in plain]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}

    def words(self, piece: str) -> list[str]:
        """The piece's words: plain Latin pieces skip the library's own steps; words of other pieces are in the
        vocabulary's byte letters after a NUL."""
        if PLAIN.fullmatch(piece):
            return WORD.findall(piece.lower())
        return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def symbols(self, word: str) -> list[int]:
        if word[0] == "\0":
            word = word[1:]
        elif not word.isascii():
            word = "".join(map(self.letter.__getitem__, word.encode()))
        return [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + self.end]]

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one after the other, and how many each has."""
        hashes = _hashed(words)
        _, firsts = np.unique(hashes, return_index=True)
        firsts = firsts[~self.merged.find(hashes[firsts])[0]]
        new = [words[i] for i in firsts.tolist()]
        if self.by_index:
            found = merge_pairs([self.symbols(w) for w in new], self.ranks)
        else:
            back = {c: b for b, c in self.letter.items()}
            plain = [bytes(map(back.__getitem__, w[1:])).decode() if w[0] == "\0" else w for w in new]
            found = [e.ids for e in self.library.encode_batch_fast(plain, add_special_tokens=False)]
        self.merged.add(hashes[firsts], np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.uint32))
        _, starts, sizes = self.merged.find(hashes)
        return self.merged.ids[_places(starts, sizes)], sizes

    def encode(self, batch: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids, for an array of strings without nulls."""
        ends = np.cumsum(np.asarray(pc.binary_length(batch), np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            part = batch.slice(at, end - at)
            odd = self._special(part)
            flat, stops = self._plain(part)
            begin = 0
            for i, stop in enumerate(stops.tolist()):
                yield flat[begin:stop] if not odd[i] else self._cut(part[i].as_py())
                begin = stop
            at = end

    def _plain(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's end, leaving special tokens aside."""
        pieces = pc.ascii_split_whitespace(batch)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        hashes = _hashed(distinct)
        new = np.flatnonzero(~self.known.find(hashes)[0])
        if len(new) + len(self.known.keys) > CACHE:
            self.known, self.merged = Store(self.id_type), Store(self.id_type)
            new = np.arange(len(distinct))
        cut = [self.words(distinct[i]) for i in new.tolist()]
        ids, sizes = self.learn([w for ws in cut for w in ws])
        per_piece = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))]
        self.known.add(hashes[new], np.diff(per_piece), ids)
        _, starts, sizes = self.known.find(hashes)
        which = np.asarray(coded.indices, np.int64)
        sizes = sizes[which]
        flat = self.known.ids[_places(starts[which], sizes)].astype("<u4")
        ends = np.append(0, np.cumsum(sizes))
        return flat, ends[np.cumsum(np.asarray(pieces.value_lengths(), np.int64))]

    def _special(self, batch: pa.Array) -> list[bool]:
        odd = np.zeros(len(batch), bool)
        for t in self.special:
            odd |= np.asarray(pc.match_substring(batch, t).to_numpy(zero_copy_only=False), bool)
        return odd.tolist()

    def _cut(self, text: str) -> np.ndarray:
        """The ids of a text with special tokens."""
        parts = self.cut.split(text)
        flat, ends = self._plain(pa.array(parts, pa.string()))
        own = np.split(flat, ends[:-1])
        return np.concatenate([np.array([self.special[t]], "<u4") if t in self.special else x for t, x in zip(parts, own, strict=True)]).astype("<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens, special ones too, joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, by_index: bool = True) -> Encoder:
    """One for each worker process."""
    return Encoder(path, by_index)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) and decoded of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [x.tobytes() for x in e.encode(b.column("text").fill_null(""))]
            said = [e.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(said, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, without moving ids and texts out of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n, ids_sha, said_sha = [], [], []
            for x in e.encode(b.column("text").fill_null("")):
                n.append(len(x))
                ids_sha.append(hashlib.sha256(x.tobytes()).hexdigest())
                said_sha.append(hashlib.sha256(e.decode(x.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(said_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
