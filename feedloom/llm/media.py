"""Media columns: bytes stored losslessly as progressive JPEGs, and full-resolution tensors decoded from them.

A JPEG loses nothing between its coefficients and its bytes, so the payload's unit is the quantised coefficient. A file
has three components at 4:2:0, quantised by ones, and fifteen scans, none interleaved: for each component a DC scan and
its refinement, the first five AC coefficients, the others, and a refinement of all (spectral selection and successive
approximation).

The decoder reads progressive files of any writer with Huffman coding and 8-bit samples: one to four components of any
sampling, interleaved DC scans, quantisation tables, restart intervals, sizes that are no multiple of a block. It
accumulates the scans into coefficient arrays, which are dequantised, inverse-transformed in numpy, chroma upsampled,
and turned to RGB. Scans whose Huffman table makes every symbol equally wide (as the writer's do) are read by numpy at
once; others symbol by symbol.

How a byte b becomes a coefficient: AC b from 128 on is b, below it -(b + 128), so the magnitude always has eight bits;
DC is b - 128, plus 767 in every even block, so differences always have nine bits after the shift.

The transform's matrix is whole numbers small enough that sums in doubles are exact, so equal texts have equal
features on any machine. Defined results: null and empty texts give one unit of bytes 255. A text of any length is one
image: rows widen where 64 units a row would exceed a JPEG's height, up to 6 GB, beyond what a Spark value holds. Rows
are handled one by one: repeated rows and ids, null ids and empty tables need no care. Columns besides doc_id and text
are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

#: Payloads are multiples of so many bytes.
UNIT = 576
WIDEST, TALLEST = 64, 4095  # MCUs in a row, unless that makes more rows than a JPEG has
EVEN_DC = 767
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
AHEAD = ((1, 5), (6, 63))  # AC bands
LENGTH_MARK = b"payload "
_BITS = 20  # of the transform's fraction
#: Bytes of texts or tensors that a worker hands on at once (or one row's).
AT_ONCE = 4 << 20


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _scan(component: int, dc: int, ac: int, band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, dc << 4 | ac, *band, high << 4 | low])) + data.replace(b"\xff", b"\xff\0")


def _filled(bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    return np.packbits(np.append(bits, np.ones(-len(bits) % 8, np.uint8)).astype(np.uint8)).tobytes()


def _runs(blocks: int) -> list[int]:
    """Lengths of the end-of-band runs that cover all blocks."""
    return [32767] * (blocks // 32767) + [blocks % 32767] * bool(blocks % 32767)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold ``payload``."""
    mcus = -(-len(payload) // 384)
    wide = max(min(WIDEST, mcus), -(-mcus // TALLEST))
    high = -(-mcus // wide)
    b = np.frombuffer(payload, np.uint8)
    b = np.append(b, np.zeros(wide * high * 384 - len(b), np.uint8)).reshape(-1, 64)
    luma = wide * high * 4
    parts = b[:luma], b[luma : luma + wide * high], b[luma + wide * high :]
    sizes = sorted({r.bit_length() - 1 for x in parts for r in _runs(len(x))})
    lengths = [0] * 16
    for i in range(len(sizes)):  # 0, 10, 110, ...
        lengths[i] += 1
    table = lambda kind, counts, symbols: bytes([kind, *counts, *symbols])
    out = [
        b"\xff\xd8",
        _segment(0xFE, LENGTH_MARK + struct.pack(">Q", len(payload))),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, table(0x00, [1] + [0] * 15, [9]) + table(0x10, [1] + [0] * 15, [7]) + table(0x11, lengths, [s << 4 for s in sizes])),
    ]
    dc_later, ac_first, ac_later = [], [], []
    for c, x in enumerate(parts, 1):
        dc = x[:, 0].astype(np.int32) - 128
        dc[::2] += EVEN_DC
        step = np.diff(dc >> 1, prepend=0)
        extra = np.where(step > 0, step, step + 511).astype(">u2")  # nine bits after the code 0
        out.append(_scan(c, 0, 0, (0, 0), 0, 1, _filled(np.unpackbits(extra.view(np.uint8).reshape(-1, 2), axis=1)[:, 6:].ravel())))
        dc_later.append(_scan(c, 0, 0, (0, 0), 1, 0, _filled(dc & 1)))
        half = np.where(x >= 128, x >> 1, 63 - (x >> 1)).astype(np.uint8)  # the code 0 and seven bits
        ac_first += [_scan(c, 0, 0, (a, z), 0, 1, half[:, a : z + 1].tobytes()) for a, z in AHEAD]
        low, at, bits = x[:, 1:] & 1, 0, []
        for r in _runs(len(x)):
            s = r.bit_length() - 1
            i = sizes.index(s)
            head = [1] * i + [0] + [int(v) for v in f"{r - (1 << s):0{s}b}"] * bool(s)
            bits += [np.array(head, np.uint8), low[at : at + r].ravel()]
            at += r
        ac_later.append(_scan(c, 0, 1, (1, 63), 1, 0, _filled(np.concatenate(bits))))
    return b"".join([*out, *ac_first, *dc_later, *ac_later, b"\xff\xd9"])


class _Bits:
    """Bits of a scan, most significant first; ones after its end."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.append(np.unpackbits(np.frombuffer(data, np.uint8)), np.ones(64, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        x = 0
        for b in self.bits[self.at : self.at + n]:
            x = x << 1 | b
        self.at += n
        return x

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        x = n = 0
        while (n, x) not in codes:
            x = x << 1 | self.bits[self.at]
            self.at += 1
            n += 1
            if n > 16:
                raise ValueError("no such code")
        return codes[n, x]


def _signed(x: int, size: int) -> int:
    return x if size and x >> size - 1 else x - (1 << size) + 1


def _read_dc(units: list[tuple[np.ndarray, dict]], data: bytes, last: list[int], high: int, low: int, which: list[int]) -> None:
    """DC values of blocks, in the order of ``units`` (block, table); ``which`` names each one's component."""
    bits = _Bits(data)
    for (block, table), c in zip(units, which, strict=True):
        if high:
            block[0] |= bits.take(1) << low
        else:
            size = bits.symbol(table)
            last[c] += _signed(bits.take(size), size) if size else 0
            block[0] = last[c] << low


def _read_ac(coefs: np.ndarray, data: bytes, ac: dict, a: int, z: int, high: int, low: int) -> None:
    """AC values of one component's blocks, symbol by symbol."""
    bits, blocks, rest = _Bits(data), coefs.tolist(), 0
    for block in blocks:
        k = a
        if high == 0:
            while k <= z and not rest:
                run, size = divmod(bits.symbol(ac), 16)
                if size:
                    k += run
                    block[k] = _signed(bits.take(size), size) * (1 << low)
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    rest = (1 << run) + bits.take(run)
            rest -= bool(rest)
            continue

        def mend(k: int, block: list[int] = block) -> None:
            if bits.take(1):
                block[k] += (1 << low) * (1 if block[k] > 0 else -1)

        while k <= z and not rest:
            run, size = divmod(bits.symbol(ac), 16)
            if not size and run < 15:
                rest = (1 << run) + bits.take(run)
                break
            new = (1 if bits.take(1) else -1) * (1 << low) if size else 0
            while k <= z:
                if block[k]:
                    mend(k)
                elif run == 0:
                    block[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if rest:
            for i in range(k, z + 1):
                if block[i]:
                    mend(i)
            rest -= 1
    coefs[:] = blocks


def _read_even(coefs: np.ndarray, data: bytes, dc: dict, ac: dict, a: int, z: int, high: int, low: int) -> bool:
    """The same by numpy, if all of the scan's symbols are equally wide; else nothing is done."""
    n = len(coefs)
    if a == 0 and high:
        coefs[:, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(np.int32) << low
        return True
    if a == 0 or high == 0:
        table = ac if a else dc
        if set(table) != {(1, 0)} or not 0 < (size := table[1, 0]) < 16:
            return False
        wide = 1 + size
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (z - a + 1) * wide).reshape(-1, wide)
        if bits[:, 0].any():
            return False
        if wide == 8:
            x = np.frombuffer(data, np.uint8, len(bits)).astype(np.int32)
        else:
            x = bits[:, 1:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        x = np.where(x >> (size - 1), x, x - (1 << size) + 1)
        if a:
            coefs[:, a : z + 1] = x.reshape(n, -1) * (1 << low)
        else:
            coefs[:, 0] = np.cumsum(x) << low
        return True
    if not coefs[:, a : z + 1].all() or any(s & 15 or s >> 4 == 15 for s in ac.values()):
        return False
    bits = np.append(np.unpackbits(np.frombuffer(data, np.uint8)), np.ones(64, np.uint8))
    done = at = 0
    while done < n:  # every coefficient is known, so a run of blocks is a run of bits
        x = k = 0
        while (k, x) not in ac:
            x, k, at = x << 1 | int(bits[at]), k + 1, at + 1
            if k > 16:
                return False
        size = ac[k, x] >> 4
        run = min(n - done, (1 << size) + int("".join(map(str, bits[at : at + size])) or "0", 2))
        at += size
        part = coefs[done : done + run, a : z + 1]
        more = bits[at : at + part.size].reshape(part.shape).astype(np.int32) << low
        part += np.where(part > 0, more, -more)
        at += part.size
        done += run
    return True


@dataclass
class Component:
    """Sampling factors, quantisation table's number, blocks a row and a column as scans of this component alone cover
    them, and all blocks' coefficients in zigzag order, by rows of ``stride`` blocks (whole MCUs)."""

    id: int
    h: int
    v: int
    table: int
    wide: int
    high: int
    stride: int
    coefs: np.ndarray

    def alone(self) -> np.ndarray:
        """The blocks of a scan of this component alone."""
        return (np.arange(self.high)[:, None] * self.stride + np.arange(self.wide)).ravel()


@dataclass
class Image:
    width: int = 0
    height: int = 0
    told: int | None = None
    parts: list[Component] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)

    def frame(self, body: bytes) -> None:
        deep, self.height, self.width, k = struct.unpack(">BHHB", body[:6])
        if deep != 8 or not self.height:
            raise ValueError("only 8-bit samples and told heights are read")
        specs = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        self.most = max(h for _, h, *_ in specs), max(v for *_, v, _ in specs)
        self.mcus = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        for id_, h, v, table in specs:
            wide, high = (-(-(-(-size * f // most)) // 8) for size, f, most in ((self.width, h, self.most[0]), (self.height, v, self.most[1])))
            self.parts.append(Component(id_, h, v, table, wide, high, self.mcus[0] * h, np.zeros((self.mcus[0] * h * self.mcus[1] * v, 64), np.int32)))

    def interleaved(self, parts: list[Component]) -> list[tuple[int, int]]:
        """(component, block) of a scan of several components, MCU by MCU."""
        return [
            (c, (my * p.v + y) * p.stride + mx * p.h + x)
            for my in range(self.mcus[1])
            for mx in range(self.mcus[0])
            for c, p in enumerate(parts)
            for y in range(p.v)
            for x in range(p.h)
        ]

    def scan(self, body: bytes, data: list[bytes], huffman: dict[int, dict], interval: int, by_symbol: bool) -> None:
        """One scan, its entropy-coded data cut at restart markers."""
        n = body[0]
        ids = {p.id: p for p in self.parts}
        parts = [ids[body[1 + 2 * i]] for i in range(n)]
        dc, ac = ([huffman.get(k(body[2 + 2 * i]), {}) for i in range(n)] for k in (lambda t: t >> 4, lambda t: 16 | t & 15))
        a, z, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n > 1 and a:
            raise ValueError("AC scans are of one component")
        if n == 1:
            p, blocks = parts[0], parts[0].alone()
            whole = len(blocks) == len(p.coefs)
            coefs = p.coefs if whole else p.coefs[blocks]
            step = interval or len(blocks)
            for i, at in enumerate(range(0, len(blocks), step)):
                own = coefs[at : at + step]
                if by_symbol or not _read_even(own, data[i], dc[0], ac[0], a, z, high, low):
                    if a:
                        _read_ac(own, data[i], ac[0], a, z, high, low)
                    else:
                        _read_dc([(b, dc[0]) for b in own], data[i], [0], high, low, [0] * len(own))
            if not whole:
                p.coefs[blocks] = coefs
            return
        order = self.interleaved(parts)
        step = (interval or len(order)) * sum(p.h * p.v for p in parts)
        for i, at in enumerate(range(0, len(order), step)):
            own = order[at : at + step]
            _read_dc([(parts[c].coefs[b], dc[c]) for c, b in own], data[i], [0] * n, high, low, [c for c, _ in own])


def _huffman(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    """Tables of a DHT segment: class and number, and symbols by (size, code)."""
    while body:
        counts, code, symbols, table = body[1:17], 0, iter(body[17:]), {}
        for size, c in enumerate(counts, 1):
            for _ in range(c):
                table[size, code] = next(symbols)
                code += 1
            code <<= 1
        yield body[0], table
        body = body[17 + sum(counts) :]


def _quantisers(body: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Tables of a DQT segment, in zigzag order."""
    while body:
        size = 128 if body[0] >> 4 else 64
        yield body[0] & 15, np.frombuffer(body, ">u2" if size == 128 else np.uint8, 64, 1).astype(np.int32)
        body = body[1 + size :]


def _entropy_coded(stored: bytes, at: int) -> tuple[list[bytes], int]:
    """A scan's data from ``at`` on, cut at restart markers, without stuffing; and where the next marker is."""
    parts, begin = [], at
    while True:
        at = stored.find(b"\xff", at)
        if at < 0 or at + 1 >= len(stored):
            raise ValueError("the file ends within a scan")
        after = stored[at + 1]
        if after == 0:
            at += 2
        elif after == 0xFF:
            at += 1
        else:
            parts.append(stored[begin:at].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= after <= 0xD7:
                return parts, at
            begin = at = at + 2


def read(stored: bytes, by_symbol: bool = False) -> Image:
    """The coefficients of a progressive JPEG, and what it tells of size, sampling and quantisation."""
    image, huffman, interval, at = Image(), {}, 0, 2
    while True:
        while stored[at + 1] == 0xFF:
            at += 1
        mark = stored[at + 1]
        if mark == 0xD9:
            return image
        if mark == 1 or 0xD0 <= mark <= 0xD8:  # alone
            at += 2
            continue
        n = int.from_bytes(stored[at + 2 : at + 4])
        body = stored[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xFE and body.startswith(LENGTH_MARK):
            image.told = int.from_bytes(body[len(LENGTH_MARK) :])
        elif mark == 0xC2:
            image.frame(body)
        elif mark == 0xC4:
            huffman.update(_huffman(body))
        elif mark == 0xDB:
            image.tables.update(_quantisers(body))
        elif mark == 0xDD:
            interval = int.from_bytes(body)
        elif mark == 0xDA:
            data, at = _entropy_coded(stored, at)
            image.scan(body, data, huffman, interval, by_symbol)
        elif 0xC0 <= mark <= 0xCF and mark != 0xC8:
            raise ValueError("only progressive files with Huffman coding are read")


def payload(image: Image) -> bytes:
    """The bytes that the coefficients of a file made by ``encode`` hold."""
    out = []
    for part in image.parts:
        x = part.coefs
        b = np.where(x > 0, x, -x - 128)
        b[:, 0] = x[:, 0] + 128
        b[::2, 0] -= EVEN_DC
        out.append(b.astype(np.uint8).tobytes())
    return b"".join(out)[: image.told]


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """From 64 coefficients in zigzag order to 64 samples, times 2 ** _BITS, in whole numbers."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * math.pi / 16) / 2
    one[0] /= math.sqrt(2)
    return np.rint(np.kron(one, one)[ZIGZAG] * (1 << _BITS))


def _plane(coefs: np.ndarray, blocks_wide: int) -> np.ndarray:
    out = np.empty((len(coefs), 64), np.uint8)
    for at in range(0, len(coefs), 16_384):
        x = coefs[at : at + 16_384].astype(np.float64) @ _inverse()
        out[at : at + 16_384] = np.clip(np.floor(x / (1 << _BITS) + 128.5), 0, 255)
    return out.reshape(-1, blocks_wide, 8, 8).swapaxes(1, 2).reshape(-1, blocks_wide * 8)


def _upsampled(plane: np.ndarray, image: Image, part: Component) -> np.ndarray:
    """The samples that lie at the image's full resolution."""
    for axis, (f, most, size) in enumerate(((part.v, image.most[1], image.height), (part.h, image.most[0], image.width))):
        if most % f == 0:
            plane = np.repeat(plane, most // f, axis=axis) if most != f else plane
        else:
            plane = np.take(plane, np.arange(size) * f // most, axis=axis)
    return plane[: image.height, : image.width].astype(np.int32)


def tensor(image: Image) -> np.ndarray:
    """RGB samples, (height, width, 3), chroma at full resolution; grey files have three equal ones, and of four
    components the first three count."""
    planes = []
    for part in image.parts[:3]:
        q = image.tables.get(part.table)
        coefs = part.coefs if q is None or (q == 1).all() else part.coefs * q
        planes.append(_upsampled(_plane(coefs, part.stride), image, part))
    rgb = np.empty((image.height, image.width, 3), np.uint8)
    if len(planes) < 3:
        rgb[:] = planes[0][..., None]
        return rgb
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb[..., 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    rgb[..., 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    rgb[..., 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return rgb


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary, a JPEG) of every row."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                data = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in data], pa.int64()), pa.array([encode(padded(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests of what is read back from a table made by ``stored``, and the full-resolution tensor: size, channel
    means, and rgb (binary, rows of interleaved samples)."""
    rows = media.select("doc_id", "n_bytes", "media")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "rgb"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def seen(file: bytes) -> tuple:
        image = read(file)
        back, rgb = payload(image), tensor(image)
        means = " ".join(f"{v / (image.width * image.height):.4f}" for v in rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist())
        told = f"{image.width}x{image.height} {means}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), told, image.width, image.height, rgb.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held, begin = [], 0, 0
            for i, x in enumerate(b.column("media")):
                out.append(seen(x.as_py()))
                held += len(out[-1][-1])
                if held >= AT_ONCE or i + 1 == b.num_rows:  # tensors of some rows at a time
                    own = b.slice(begin, len(out))
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *names])
                    out, held, begin = [], 0, i + 1

    spec = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, rgb binary"
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, {spec}")
