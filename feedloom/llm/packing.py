"""Cost-balanced packing of token documents into sequences of a fixed capacity.

A sequence costs LINEAR * tokens + QUADRATIC * (sum of its pieces' squared lengths): attention does not cross pieces.
Documents of a group are taken by descending cost; each goes to the lowest-cost sequence with remaining capacity for
it. A document that fits nowhere is cut at the room of the lowest-cost sequence that has any. A group opens just as
many sequences as its tokens need, so less than one sequence of padding is left in it, whatever the lengths are.

Groups hold GROUP documents each, dealt by row and not by any value: a hot source, a repeated id or a group of copies
cannot crowd one task. Whole sequences are cut from long documents beforehand and travel without their ids, so a
group's memory is bounded by GROUP * capacity ids.

Defined results: null and empty texts are a document of the one closing id. Rows with equal or null ids are documents
of their own. An empty table gives no pieces. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import tidy

CAPACITY = 2048
END_ID = 1
#: Documents of a group.
GROUP = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) for documents of fewer than ``capacity`` tokens each."""
    n = math.ceil(sum(lengths) / capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    out = []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[doc]
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room)
            at = int(fits[np.argmin(cost[fits])])
            part = min(left, int(room[at]))
            out.append((doc, start, part, at))
            room[at] -= part
            cost[at] += LINEAR * part + QUADRATIC * part * part
            start, left = start + part, left - part
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    groups = max(1, math.ceil(rows.count() / group))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, by_index=False)
        dealt = 0
        for b in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            out: dict[str, list] = {k: [] for k in ("doc_id", "g", "start", "length", "crc", "doc_tokens", "ids")}
            for doc_id, x in zip(b.column("doc_id").to_pylist(), e.encode(b.column("text").fill_null("")), strict=True):
                ids = np.append(x, np.uint32(END_ID)).astype("<u4")
                if not dealt:
                    dealt = zlib.crc32(ids.tobytes())  # tasks begin at different groups
                dealt += 1
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    whole = len(part) == capacity
                    for k, v in zip(out, (doc_id, dealt % groups, start, len(part), zlib.crc32(part.tobytes()), len(ids), None if whole else part.astype("<u2" if part.max() < 65536 else "<u4").tobytes()), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], b.column("doc_id").type), *(pa.array(out[k], pa.int64()) for k in ("g", "start", "length", "crc", "doc_tokens")), pa.array(out["ids"], pa.binary())], list(out))

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        c = {k: t.column(k).to_pylist() for k in t.column_names}
        base = key[0].as_py() << 32
        out, used = [], 0
        rest = [i for i, x in enumerate(c["ids"]) if x is not None]
        for i, x in enumerate(c["ids"]):
            if x is None:
                out.append((c["doc_id"][i], c["start"][i], c["length"][i], c["crc"][i], c["doc_tokens"][i], base + used, 0))
                used += 1
        filled: dict[int, int] = {}
        for d, start, length, at in assign([c["length"][i] for i in rest], capacity):
            i = rest[d]
            ids = np.frombuffer(c["ids"][i], "<u2" if len(c["ids"][i]) == 2 * c["length"][i] else "<u4")[start : start + length]
            offset = filled.get(at, 0)
            filled[at] = offset + length
            out.append((c["doc_id"][i], c["start"][i] + start, length, zlib.crc32(ids.astype("<u4").tobytes()), c["doc_tokens"][i], base + used + at, offset))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.Table.from_arrays([pa.array(columns[0], t.column("doc_id").type), *(pa.array(x, pa.int64()) for x in columns[1:])], names)

    pieces = rows.mapInArrow(tidy(tokens), f"doc_id {id_type}, g long, start long, length long, crc long, doc_tokens long, ids binary")
    return pieces.groupBy(F.col("g")).applyInArrow(fill, PIECES.format(id=id_type))
