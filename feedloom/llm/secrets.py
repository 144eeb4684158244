"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order models over the characters of long tokens are trained from labelled samples; a token whose
log-likelihood ratio (random over ordinary), less PER_CHAR for each character, exceeds THRESHOLD is a secret. Every
whole run of LONG key characters is judged, whatever fixed patterns find in it; if it is none as a whole, so are its
stretches of LONG characters at least, the best first. The samples are SAMPLES strings of either label, drawn with a
fixed seed: random ones over the alphabets that keys use, ordinary ones joined from WORDS in the usual styles, and
lines of one character. So the models are the same for every corpus and size, and are made once in each worker.

Each row is judged alone: nothing is shuffled or collected. Defined results: null and empty texts have no spans; very
long texts are read whole; repeated rows and ids are judged each; columns besides doc_id and text are not read by
``spans`` and stay as they are in ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, texts, tidy

KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: Whole runs of the characters that keys are made of; every access and hex match lies in one.
LONG = 16
RUN = re.compile(f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LONG},}}")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")

SAMPLES, SEED = 20_000, 7
#: Nats by which random must be likelier than ordinary: for each character, and besides. Set on labelled samples of
#: another make (digests and encoded bytes; names in the standard library), as tests/llm has them.
PER_CHAR, THRESHOLD = 0.5, 6.0
MASK = "[secret]"

ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "0123456789ABCDEF",
)
#: Ordinary words of code and of four languages.
WORDS = """account action address article author background button cache channel client column comment configuration connection container content
context controller country current customer database default description destination development device directory document element encoding
environment error example exception execute expected factory feature filter folder format function generation handler header history identifier image
import index information initialize input instance integer interface international iterator language length library listener location manager
management message method minimum module name network notification number object operation option order output package page parameter parent
partition password path pattern performance position prefix previous process production product property provider question receive record reference
register relation remote request required resource response result return schedule schema search section security selection sequence service session
setting source standard statement status storage stream string structure subscription success system table target template temporary text thread
timestamp title transaction transformation update user validation value variable vector version visibility volume window with without writer
the and other there their that thing nation station ering under another between together nevertheless understanding
les entre avec leurs toujours maintenant gouvernement developpement quelque chose nouvelle nation pour dans elle
der die einer werden zwischen wirtschaft gesellschaft entwicklung verschiedene moglichkeit freundlich sicherheit
para entonces siempre trabajo desarrollo gobierno nacional importante conocimiento ciudad mientras""".split()


def samples(n: int = SAMPLES, seed: int = SEED) -> tuple[list[str], list[str]]:
    """Labelled strings: random, ordinary."""
    r = random.Random(seed)
    rand = ["".join(r.choices(ALPHABETS[i % len(ALPHABETS)], k=r.randint(LONG, 64))) for i in range(n)]
    plain = []
    for i in range(n):
        ws = [r.choice(WORDS) for _ in range(r.randint(2, 7))]
        ws = [str(r.randint(0, 9999)) if r.random() < 0.04 else w for w in ws]
        style = i % 8
        if style == 0:
            plain.append(ws[0] + "".join(w.capitalize() for w in ws[1:]))
        elif style == 1:
            plain.append("".join(w.capitalize() for w in ws))
        elif style == 5:
            plain.append("_".join(w.upper() for w in ws))
        elif style == 6:
            plain.append("".join(ws))
        elif style == 7:
            plain.append(r.choice(2 * "-=_+/" + ALPHABETS[3]) * r.randint(LONG, 80))
        else:
            plain.append("_-/"[style - 2].join(ws))
    return rand, plain


@lru_cache(maxsize=1)
def ratios() -> np.ndarray:
    """Log-likelihood ratio of each character (0-127) after each, less PER_CHAR; after 0 for a token's first."""
    out = []
    for strings in samples():
        counts = np.zeros((128, 128))
        for s in strings:
            codes = np.frombuffer(s.encode(), np.uint8)
            np.add.at(counts, (np.append(0, codes[:-1]), codes), 1)
        allowed = np.zeros(128)
        allowed[[ord(c) for c in ALPHABETS[4] + "-_="]] = 0.5
        smooth = counts + allowed
        out.append(np.log(np.maximum(smooth, 1e-9) / smooth.sum(axis=1, keepdims=True).clip(1e-9)))
    return out[0] - out[1] - PER_CHAR


def ratio(token: str) -> float:
    """Nats by which ``token`` is likelier random than ordinary, beyond PER_CHAR for each character."""
    codes = np.frombuffer(token.encode(), np.uint8)
    return float(ratios()[np.append(0, codes[:-1]), codes].sum())


def stretch(token: str) -> tuple[float, int, int]:
    """Best ratio of any stretch of LONG characters at least, each judged as a token of its own; its start and end."""
    codes = np.frombuffer(token.encode(), np.uint8)
    sums = np.append(0, np.cumsum(ratios()[codes[:-1], codes[1:]]))
    starts = ratios()[0, codes] - sums
    best = np.maximum.accumulate(starts[: len(codes) - LONG + 1]) + sums[LONG - 1 :]
    end = int(best.argmax()) + LONG
    return float(best[end - LONG]), int(starts[: end - LONG + 1].argmax()), end


def random_parts(text: str, start: int, end: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Secrets in a run: all of it, or its best stretches out to the next mark on either side."""
    todo = [(start, end)]
    while todo:
        a, b = todo.pop()
        if b - a < LONG:
            continue
        if ratio(text[a:b]) > threshold:
            yield a, b
            continue
        value, i, j = stretch(text[a:b])
        if value > threshold:
            i, j = a + i, a + j
            while i > a and text[i - 1].isalnum():
                i -= 1
            while j < b and text[j].isalnum():
                j += 1
            yield i, j
            todo += [(a, i), (j, b)]


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind."""
    spans = []
    low = text.encode().lower()
    if any(k in low for k in KEYWORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if max(map(len, low.split()), default=0) >= LONG:
        for run in RUN.finditer(text):
            spans += [("access", *m.span()) for m in ACCESS.finditer(text, *run.span())]
            spans += [("hex", *m.span()) for m in HEX.finditer(text, *run.span())]
            spans += [("markov", *x) for x in random_parts(text, *run.span(), threshold)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str | None) -> str | None:
    """``text`` with MASK for every maximal stretch of overlapping spans; the very text where there are none."""
    found = find(text or "")
    if not found:
        return text
    out, end = [], 0
    for _, a, b in found:
        if a >= end:
            out += [text[end:a], MASK]
        end = max(end, b)
    return "".join(out) + text[end:]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, all_ = {k: [] for k in KINDS[:3]}, [], []
            for t in texts(b):
                found = find(t)
                for k in n:
                    n[k].append(sum(s[0] == k for s in found))
                said = [(k, f"{k}:{x}:{y}") for k, x, y in found]
                base.append(hashlib.sha256(",".join(x for k, x in said if k in n).encode()).hexdigest())
                all_.append(",".join(x for _, x in said))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in n.values()), pa.array(base, pa.string()), pa.array(all_, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their columns, secrets in text masked and n_chars, if there, made to fit."""

    @F.arrow_udf("string")
    def mask(text: pa.Array) -> pa.Array:
        return pa.array([masked(t) for t in text.to_pylist()], pa.string())

    new = free(docs, "masked")
    out = docs.withColumn(new, mask("text"))
    if "n_chars" in docs.columns:
        fits = F.length(new).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(new) == F.col("text"), F.col("n_chars")).otherwise(fits))
    return out.withColumn("text", F.col(new)).drop(new)
