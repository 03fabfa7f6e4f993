"""JPEG files: sequential and progressive, 8 bits, 1 or 3 components, any sampling; written sequentially without subsampling.

A file's coefficients are read scan by scan into one array for each component; dequantising,
the inverse transform and the colours are then array operations on the whole image.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from .picture import Picture, Unreadable

#: The zigzag order, made by walking the diagonals.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
#: Quantisation at quality 50 in rows, for brightness and for colour. Fixed values of the standard.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *([99] * 32),
)
_K, _N = np.mgrid[:8, :8]
#: The orthonormal cosine transform: row k, place n.
COSINES = np.where(_K == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _N + 1) * _K * np.pi / 16))


class _Bits:
    """The bits of one piece of a scan, first bit first; zeros after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def need(self, n: int) -> None:
        while self.count < n:
            some = self.data[self.at : self.at + 6]
            self.at += 6
            self.held = (self.held & ((1 << self.count) - 1)) << 48 | int.from_bytes(some.ljust(6, b"\0"), "big")
            self.count += 48

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.count < n:
            self.need(n)
        self.count -= n
        return self.held >> self.count & (1 << n) - 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.count < 16:
            self.need(16)
        size, value = table[self.held >> self.count - 16 & 0xFFFF]
        self.count -= size
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> n - 1 else v - (1 << n) + 1


def _table(counts: bytes, values: bytes) -> list[tuple[int, int]]:
    """(size, value) of the code that any 16 bits begin with."""
    out, k = [], 0
    for size, n in enumerate(counts, 1):
        for v in values[k : k + n]:
            out += [(size, v)] * (1 << 16 - size)
        k += n
    if len(out) > 1 << 16:
        raise Unreadable("JPEG codes overflow")
    return out + [(16, 0)] * ((1 << 16) - len(out))


class _Part:
    """A component: its sampling, tables and coefficients by block."""

    def __init__(self, name: int, h: int, v: int, quant: int):
        self.name, self.h, self.v, self.quant = name, h, v, quant
        self.wide = self.high = 0
        self.blocks: list[list[int]] = []
        self.dc = self.ac = self.before = 0


def _sequential(bits: _Bits, part: _Part, block: list[int], dc, ac) -> None:
    part.before += bits.signed(bits.symbol(dc[part.dc]))
    block[0] = part.before
    table, k = ac[part.ac], 1
    while k < 64:
        rs = bits.symbol(table)
        size = rs & 15
        if size:
            k += rs >> 4
            if k > 63:
                raise Unreadable("JPEG block overflows")
            block[ZIGZAG[k]] = bits.signed(size)
            k += 1
        elif rs == 0xF0:
            k += 16
        else:
            break


class _Progressive:
    """One scan of a progressive file."""

    def __init__(self, first: int, last: int, high: int, low: int):
        self.first, self.last, self.high, self.low, self.run = first, last, high, low, 0

    def __call__(self, bits: _Bits, part: _Part, block: list[int], dc, ac) -> None:
        if self.first == 0:
            if self.high:
                block[0] |= bits.take(1) << self.low
            else:
                part.before += bits.signed(bits.symbol(dc[part.dc]))
                block[0] = part.before << self.low
        elif self.high:
            self.refine(bits, block, ac[part.ac])
        else:
            self.begin(bits, block, ac[part.ac])

    def begin(self, bits: _Bits, block: list[int], table) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.first
        while k <= self.last:
            rs = bits.symbol(table)
            r, size = rs >> 4, rs & 15
            if size:
                k += r
                block[ZIGZAG[min(k, 63)]] = bits.signed(size) << self.low
                k += 1
            elif r == 15:
                k += 16
            else:
                self.run = (1 << r) + bits.take(r) - 1
                break

    def refine(self, bits: _Bits, block: list[int], table) -> None:
        step, k = 1 << self.low, self.first
        if not self.run:
            while k <= self.last:
                rs = bits.symbol(table)
                r, new = rs >> 4, 0
                if rs & 15:
                    new = step if bits.take(1) else -step
                elif r < 15:
                    self.run = (1 << r) + bits.take(r)
                    break
                while k <= self.last:
                    at = ZIGZAG[k]
                    k += 1
                    if block[at]:
                        self.correct(bits, block, at, step)
                    elif r:
                        r -= 1
                    else:
                        block[at] = new
                        break
        if self.run:
            while k <= self.last:
                if block[ZIGZAG[k]]:
                    self.correct(bits, block, ZIGZAG[k], step)
                k += 1
            self.run -= 1

    @staticmethod
    def correct(bits: _Bits, block: list[int], at: int, step: int) -> None:
        if bits.take(1) and not abs(block[at]) & step:
            block[at] += step if block[at] > 0 else -step


def read(b: bytes) -> Picture:
    quant, dc, ac, parts = {}, {}, {}, []
    at, interval, progressive, adobe, text = 2, 0, False, None, {}
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise Unreadable("JPEG without a marker")
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        (n,) = struct.unpack(">H", b[at + 2 : at + 4])
        body, at = b[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                values = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                table = np.zeros(64)
                table[ZIGZAG] = values
                quant[body[0] & 15] = table.reshape(8, 8)
                body = body[129 if wide else 65 :]
        elif kind == 0xC4:
            while body:
                size = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _table(body[1:17], body[17 : 17 + size])
                body = body[17 + size :]
        elif kind in (0xC0, 0xC1, 0xC2):
            progressive = kind == 0xC2
            depth, height, width, count = struct.unpack(">BHHB", body[:6])
            if depth != 8 or count not in (1, 3):
                raise Unreadable(f"JPEG of {depth} bits and {count} components")
            parts = [_Part(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * count, 3)]
            most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            for p in parts:
                p.wide, p.high = across * p.h, down * p.v
                p.blocks = [[0] * 64 for _ in range(p.wide * p.high)]
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise Unreadable("JPEG of an unusual process")
        elif kind == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif kind == 0xEE and body.startswith(b"Adobe"):
            adobe = body[11]
        elif kind == 0xFE:
            text["comment"] = body.decode("latin-1")
        elif kind == 0xDA:
            if not parts:
                raise Unreadable("JPEG scan without a frame")
            used = []
            for i in range(body[0]):
                p = next((p for p in parts if p.name == body[1 + 2 * i]), None)
                if p is None:
                    raise Unreadable("JPEG scan of an unknown component")
                p.dc, p.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                used.append(p)
            first, last, levels = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            step = _Progressive(first, last, levels >> 4, levels & 15) if progressive else _sequential
            end = at
            while end < len(b) - 1 and not (b[end] == 0xFF and b[end + 1] != 0 and not 0xD0 <= b[end + 1] <= 0xD7):
                end = b.find(b"\xff", end + 1)
                end = len(b) if end < 0 else end
            _scan(b[at:end], used, interval, step, dc, ac, (width, height, most_h, most_v))
            at = end
    if not parts:
        raise Unreadable("JPEG without a frame")
    planes = []
    for p in parts:
        blocks = np.array(p.blocks, float).reshape(p.high, p.wide, 8, 8) * quant[p.quant]
        pixels = np.einsum("ki,yxkl,lj->yixj", COSINES, blocks, COSINES).reshape(p.high * 8, p.wide * 8)
        pixels = np.clip(np.round(pixels + 128), 0, 255)
        planes.append(pixels.repeat(most_v // p.v, 0).repeat(most_h // p.h, 1)[:height, :width])
    if len(planes) == 3 and adobe != 0:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb]
    names = ("y",) if len(planes) == 1 else ("r", "g", "b")
    return Picture({c: (np.clip(np.round(v), 0, 255) / 255).astype(np.float32) for c, v in zip(names, planes, strict=True)}, text, "jpeg")


def _scan(data: bytes, used: list[_Part], interval: int, step, dc, ac, size) -> None:
    """The coefficients of one scan."""
    width, height, most_h, most_v = size
    if len(used) == 1:  # a single component has no padding blocks
        p = used[0]
        wide, high = -(-width * p.h // (8 * most_h)), -(-height * p.v // (8 * most_v))
        units = [[(p, y * p.wide + x)] for y in range(high) for x in range(wide)]
    else:
        across, down = used[0].wide // used[0].h, used[0].high // used[0].v
        units = [
            [(p, (y * p.v + j) * p.wide + x * p.h + i) for p in used for j in range(p.v) for i in range(p.h)]
            for y in range(down) for x in range(across)
        ]
    pieces, begin, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(data[begin:at])
            begin = at + 2
        at += 2
    pieces.append(data[begin:])
    interval = interval or len(units)
    for i, piece in enumerate(pieces):
        bits = _Bits(piece)
        for p in used:
            p.before = 0
        if isinstance(step, _Progressive):
            step.run = 0
        for unit in units[i * interval : (i + 1) * interval]:
            for p, place in unit:
                step(bits, p, p.blocks[place], dc, ac)


def quantisation(base: tuple, quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255).astype(int)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of at most 16 bits, shorter for more frequent symbols, that leave the last code unused."""
    heap = [(n, i, {s: 0}) for i, (s, n) in enumerate(sorted(counts.items()))]
    heap.append((0, len(heap), {-1: 0}))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], serial, {s: n + 1 for s, n in (a[2] | b[2]).items()}))
        serial += 1
    lengths = {s: min(max(n, 1), 16) for s, n in heap[0][2].items()}
    # Cut codes are longer elsewhere, until all fit again.
    while sum(1 << 16 - n for n in lengths.values()) > 1 << 16:
        s = max((s for s in lengths if lengths[s] < 16), key=lambda s: (lengths[s], -counts.get(s, 0)))
        lengths[s] += 1
    lengths.pop(-1)
    return lengths


def _codes(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table's bytes, and (code, length) of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    out, code, size = {}, 0, 0
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        out[s] = (code, size)
        code += 1
    return counts + bytes(order), out


def write(p: Picture, quality: int = 90) -> bytes:
    names = [c for c in ("r", "g", "b") if c in p.channels] if "r" in p.channels else list(p.channels)[:1]
    planes = [np.floor(np.clip(np.nan_to_num(p.channels[c]), 0, 1) * 255.0) for c in names]
    if len(planes) == 3:
        r, g, b = planes
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    tables = [quantisation(BRIGHTNESS, quality), quantisation(COLOUR, quality)]
    high, wide = -(-p.height // 8), -(-p.width // 8)
    streams = []
    for i, plane in enumerate(planes):
        padded = np.pad(plane, ((0, high * 8 - p.height), (0, wide * 8 - p.width)), "edge") - 128
        blocks = np.einsum("ki,yixj,lj->yxkl", COSINES, padded.reshape(high, 8, wide, 8), COSINES)
        streams.append(np.round(blocks.reshape(-1, 64) / tables[min(i, 1)])[:, ZIGZAG].astype(int))
    symbols: list[tuple[int, int, int, int]] = []  # (table, symbol, extra bits, their number)
    before = [0] * len(planes)
    for k in range(high * wide):
        for i, blocks in enumerate(streams):
            block = blocks[k]
            kind, diff = min(i, 1), int(block[0]) - before[i]
            before[i] = int(block[0])
            symbols.append((2 * kind, n := abs(diff).bit_length(), diff if diff >= 0 else diff + (1 << n) - 1, n))
            last = 0
            for at in np.nonzero(block[1:])[0].tolist():
                run, v = at - last, int(block[at + 1])
                last = at + 1
                symbols += [(2 * kind + 1, 0xF0, 0, 0)] * (run // 16)
                symbols.append((2 * kind + 1, (run % 16) << 4 | (n := abs(v).bit_length()), v if v >= 0 else v + (1 << n) - 1, n))
            if last < 63:
                symbols.append((2 * kind + 1, 0, 0, 0))
    counts: list[dict[int, int]] = [{} for _ in range(2 * min(len(planes), 2))]
    for t, s, *_ in symbols:
        counts[t][s] = counts[t].get(s, 0) + 1
    coded = [_codes(code_lengths(c)) for c in counts]
    bits, size, out = 0, 0, bytearray()
    for t, s, extra, n in symbols:
        code, length = coded[t][1][s]
        bits, size = (bits << length | code) << n | extra, size + length + n
        if size >= 4096:
            out += (bits >> size % 8).to_bytes(size // 8, "big")
            bits, size = bits & (1 << size % 8) - 1, size % 8
    pad = -size % 8
    out += (bits << pad | (1 << pad) - 1).to_bytes((size + pad) // 8, "big")
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8"
    for i in range(min(len(planes), 2)):
        head += part(0xDB, bytes([i]) + bytes(tables[i][ZIGZAG].tolist()))
    frame = struct.pack(">BHHB", 8, p.height, p.width, len(planes)) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(len(planes)))
    head += part(0xC0, frame)
    for t, (table, _) in enumerate(coded):
        head += part(0xC4, bytes([(t % 2) << 4 | t // 2]) + table)
    head += part(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(planes))) + b"\0\x3f\0")
    return head + bytes(out).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _frame(b: bytes) -> bytes:
    at = 2
    while at + 9 < len(b):
        (n,) = struct.unpack(">H", b[at + 2 : at + 4])
        if 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
            return b[at + 4 : at + 2 + n]
        at += 2 + n
    raise Unreadable("JPEG without a frame")


def size_of(b: bytes) -> tuple[int, int]:
    h, w = struct.unpack(">HH", _frame(b)[1:5])
    return w, h


def components(b: bytes) -> int:
    return _frame(b)[5]
