"""Brute-force versions of the operators, straight from their contracts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def simhash(text: str | None) -> int:
    ws = WORD.findall(lower(text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_components(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    fps = [simhash(t) for _, t in docs]
    arr = np.array(fps, np.uint64)
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            up[root(int(j))] = root(i)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(docs)]


def repeated(docs: list[str | None], size: int = 35) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept text of each document."""
    seen: dict[tuple, int] = {}
    cut = [WORD.findall(t or "") for t in docs]
    for ws in cut:
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for ws in cut:
        gone = set()
        for i in range(len(ws) - size + 1):
            if seen[tuple(ws[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def language_model(docs: list[tuple[int | None, str | None]], discount: float = 0.75, order: int = 3) -> list[tuple]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (without quantising)."""
    import math
    import zlib
    from collections import Counter

    cut = [[*WORD.findall(lower(t or "")), None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    one = Counter(w for ws, h in zip(cut, held, strict=True) if not h for w in ws)
    grams: Counter = Counter()
    for ws, h in zip(cut, held, strict=True):
        for k in range(2, order + 1):
            grams.update(() if h else zip(*(["<s>", *ws][j:] for j in range(k)), strict=False))
    n, v = sum(one.values()), len(one)
    total, kinds = Counter(), Counter()
    for g, c in grams.items():
        total[g[:-1]] += c
        kinds[g[:-1]] += 1
    out = []
    for (i, _), ws, h in zip(docs, cut, held, strict=True):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        score = 0.0
        for at, w in enumerate(ws):
            p = (one[w] + 1) / (n + v + 1)
            for k in range(2, order + 1):
                context = tuple(["<s>", *ws][max(0, at - k + 2) : at + 1])
                if len(context) == k - 1 and total[context]:
                    p = max(grams[*context, w] - discount, 0) / total[context] + discount * kinds[context] / total[context] * p
            score += math.log10(p)
        out.append((i, h, len(ws), sum(one[w] > 0 for w in ws), n, base, score))
    return out


def style_tree(pages: list[tuple[str, str | None]], judge: bool = True) -> list[str]:
    """Texts of (host, html), by dictionaries over whole hosts; ``judge`` false leaves the entropy out, not the priors."""
    import math
    from collections import Counter, defaultdict

    from feedloom.llm import html_extract as h

    roots = [h.parse(x) for _, x in pages]
    children = lambda n: [p for p in n.parts if not isinstance(p, str)]
    texts = lambda n: [p for p in n.parts if isinstance(p, str)]

    def all_text(n):
        return tuple(t for p in n.parts for t in ((p,) if isinstance(p, str) else all_text(p)))

    shows, said, gone, ups, size = defaultdict(set), defaultdict(set), defaultdict(set), {}, defaultdict(set)
    for (host, _), root in zip(pages, roots, strict=True):
        found = []

        def walk(n, up, found=found, host=host):
            for t in texts(n):
                found.append(("text", n.path, t))
                ups[host, n.path] = (up.path, ups.get((host, n.path), (0, False))[1] or up.role == 1)
            live = [c for c in children(n) if c.role != 0]
            if live:
                found.append(("children", n.path, tuple(c.path for c in live)))
            found.append(("node", n.path, None))
            for c in live:
                walk(c, n)

        walk(root, root)
        page = tuple(found)
        size[host].add(page)
        for kind, node, x in found:
            if kind == "text":
                said[host, node].add((x, page))
            elif kind == "children":
                shows[host, node].add((x, page))

        def cut(n, host=host, page=page):
            for c in children(n):
                if c.role == 0:
                    gone[host, c.path].add((all_text(c), page))
                else:
                    cut(c)

        cut(root)

    def content(values, n):
        counts = Counter(v for v, _ in values)
        return max(0.0, 1 - sum(map(math.log, counts.values())) / len(counts) / math.log(n)) if n >= h.LEAST and judge else 1.0

    def entropy(values):
        counts = Counter(v for v, _ in values)
        m = sum(counts.values())
        return 1.0 if m == 1 else -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m)

    own = {k: content(v, len(size[k[0]])) for k, v in said.items()}
    below = defaultdict(list)
    for (host, node), c in own.items():
        below[host, ups[host, node][0]].append(c)

    def importance(host, node):
        if len(size[host]) < h.LEAST or not judge:
            return 1.0
        up, article = ups[host, node]
        cs = below[host, up]
        w = h.GAMMA ** len(cs)
        around = 1.0 if article else (1 - w) * (entropy(shows[host, up]) if shows[host, up] else 1.0) + w * sum(cs) / len(cs)
        return (1 - h.SHARE) * own[host, node] + h.SHARE * around

    out = []
    for (host, _), root in zip(pages, roots, strict=True):
        live = []

        def collect(n, live=live):
            live.append(n)
            for c in children(n):
                if c.role != 0:
                    collect(c)

        collect(root)
        whole, kept = any(n.role == 1 for n in live), []

        def emit(n, host=host, whole=whole, kept=kept):
            least = h.LOW - h.PRIOR if n.inside else h.LOW + h.PRIOR if whole else h.LOW
            if n.role == 0 and h.ROLE * content(gone[host, n.path], len(size[host])) < least:
                return
            ok = importance(host, n.path) >= least if texts(n) else True
            for p in n.parts:
                if not isinstance(p, str):
                    emit(p)
                elif ok:
                    kept.append(p)

        emit(root)
        out.append("\n".join(kept))
    return out


ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


class _Writer:
    """Huffman-coded bits; codes of eight bits for the symbols that come up."""

    def __init__(self):
        self.bits, self.symbols = [], []

    def put(self, x, n):
        self.bits.append(f"{x:0{n}b}" if n else "")

    def symbol(self, s):
        if s not in self.symbols:
            self.symbols.append(s)
        self.put(self.symbols.index(s), 8)

    def cut(self):
        """The bytes so far, filled up with ones."""
        said = "".join(self.bits)
        said += "1" * (-len(said) % 8)
        self.bits = []
        return bytes(int(said[i : i + 8], 2) for i in range(0, len(said), 8)).replace(b"\xff", b"\xff\0")

    def table(self, number):
        body = bytes([number, *([0] * 7), len(self.symbols), *([0] * 8), *self.symbols])
        return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body


def _magnitude(w, x):
    n = abs(x).bit_length()
    w.put(x if x >= 0 else x + (1 << n) - 1, n)


def jpeg(planes, sampling, tables, width, height, interval=0):
    """A progressive JPEG of components' sample planes (any size up to whole MCUs), and the samples that it stands for.

    One interleaved DC scan and one refinement, AC 1-5 at once, AC 6-63 by successive approximation with runs."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1) / 2
    coefs, stands = [], []
    for plane, (h, v), q in zip(planes, sampling, tables, strict=True):
        rows, cols = my * v, mx * h
        whole = np.pad(plane, ((0, rows * 8 - plane.shape[0]), (0, cols * 8 - plane.shape[1])), mode="edge").astype(float) - 128
        blocks, back = {}, np.zeros(whole.shape)
        grid = np.zeros(64)
        grid[ZIGZAG] = q
        for r in range(rows):
            for c in range(cols):
                f = basis.T @ whole[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] @ basis
                quantised = np.rint(f / grid.reshape(8, 8)).astype(int)
                blocks[r, c] = [int(x) for x in quantised.ravel()[ZIGZAG]]
                back[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] = basis @ (quantised * grid.reshape(8, 8)) @ basis.T + 128
        coefs.append(blocks)
        stands.append(np.clip(np.rint(back), 0, 255))
    order = [(i, y * v + b, x * h + a) for y in range(my) for x in range(mx) for i, (h, v) in enumerate(sampling) for b in range(v) for a in range(h)]
    per_mcu = sum(h * v for h, v in sampling)
    out = [b"\xff\xd8\xff\xe0\0\x04ab"]
    for i, q in enumerate(tables):
        out.append(b"\xff\xdb\0\x43" + bytes([i, *q]))
    n = len(planes)
    out.append(b"\xff\xc2" + (8 + 3 * n).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, i]) for i, (h, v) in enumerate(sampling)))
    if interval:
        out.append(b"\xff\xdd\0\x04" + interval.to_bytes(2, "big"))

    def scan(ids, w, a, z, high, low, units, each, use):
        """``use(unit, fresh)`` writes a unit; data restart after every ``interval`` times ``each`` units."""
        parts, step = [], (interval or len(units)) * each
        for at in range(0, len(units), step):
            for j, u in enumerate(units[at : at + step]):
                use(u, j == 0)
            use(None, False)
            parts.append(w.cut())
        data = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
        if w.symbols:
            out.append(w.table(0 if a == 0 else 0x10))
        out.append(b"\xff\xda" + (6 + 2 * len(ids)).to_bytes(2, "big") + bytes([len(ids)]) + b"".join(bytes([i + 1, 0]) for i in ids) + bytes([a, z, high << 4 | low]) + data)

    w, last = _Writer(), [0] * n

    def dc(u, fresh):
        if u is None:
            return
        if fresh:
            last[:] = [0] * n
        i, r, c = u
        x = coefs[i][r, c][0] >> 1
        w.symbol(abs(x - last[i]).bit_length())
        _magnitude(w, x - last[i])
        last[i] = x

    scan(range(n), w, 0, 0, 0, 1, order, per_mcu, dc)
    w = _Writer()
    scan(range(n), w, 0, 0, 1, 0, order, per_mcu, lambda u, fresh: u and w.put(coefs[u[0]][u[1], u[2]][0] & 1, 1))
    for i, (h, v) in enumerate(sampling):
        rows, cols = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
        own = [coefs[i][r, c] for r in range(rows) for c in range(cols)]
        for a, z, low in ((1, 5, 0), (6, 63, 1)):
            w, empty = _Writer(), [0]

            def ends(w=w, empty=empty):
                if empty[0]:
                    size = empty[0].bit_length() - 1
                    w.symbol(size << 4)
                    w.put(empty[0] - (1 << size), size)
                    empty[0] = 0

            def first(block, fresh, w=w, empty=empty, a=a, z=z, low=low, ends=ends):
                if block is None:
                    return ends()
                run = 0
                for x in block[a : z + 1]:
                    x = (abs(x) >> low) * (1 if x > 0 else -1)
                    if not x:
                        run += 1
                        continue
                    ends()
                    while run > 15:
                        w.symbol(0xF0)
                        run -= 16
                    w.symbol(run << 4 | abs(x).bit_length())
                    _magnitude(w, x)
                    run = 0
                if run:
                    empty[0] += 1
                return None

            scan([i], w, a, z, 0, low, own, 1, first)
        w, empty, later = _Writer(), [0], []

        def close(w=w, empty=empty, later=later):
            if empty[0]:
                size = empty[0].bit_length() - 1
                w.symbol(size << 4)
                w.put(empty[0] - (1 << size), size)
                for b in later:
                    w.put(b, 1)
                empty[0] = 0
                later.clear()

        def refine(block, fresh, w=w, empty=empty, later=later, close=close):
            if block is None:
                return close()
            band = block[6:64]
            new = [j for j, x in enumerate(band) if abs(x) == 1]
            end, run, mends = new[-1] if new else -1, 0, []
            for j, x in enumerate(band):
                if abs(x) > 1:
                    mends.append(abs(x) & 1)
                elif x == 0:
                    run += 1
                    if run == 16 and j < end:
                        close()
                        w.symbol(0xF0)
                        for b in mends:
                            w.put(b, 1)
                        run, mends = 0, []
                else:
                    close()
                    w.symbol(run << 4 | 1)
                    w.put(int(x > 0), 1)
                    for b in mends:
                        w.put(b, 1)
                    run, mends = 0, []
            if run or mends:
                empty[0] += 1
                later.extend(mends)
            return None

        scan([i], w, 6, 63, 1, 0, own, 1, refine)
    out.append(b"\xff\xff\xd9")
    return b"".join(out), stands


def rgb_of(planes, sampling, width, height):
    """Floating-point colours of sample planes, chroma repeated."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    ys, xs = np.arange(height)[:, None], np.arange(width)[None, :]
    full = [p[ys * v // vm, xs * h // hm] for p, (h, v) in zip(planes, sampling, strict=True)]
    if len(full) == 1:
        return np.stack([full[0]] * 3, axis=-1)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1), 0, 255)
