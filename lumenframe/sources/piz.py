"""The wavelet and the block compressions of EXR.

PIZ: values are numbered in the order of those that occur, transformed by a reversible
wavelet of sums and differences, and written with canonical prefix codes. B44: squares of
four by four half floats as a first value and rounded differences.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from .picture import Unreadable

#: Codes of runs of zero lengths in a code table: 59 to 62 for 2 to 5, 63 and a byte for 6 to 261. Fixed values.
SHORT_RUN, LONG_RUN, LEAST_LONG, MOST_LONG = 59, 63, 6, 261
_LOOK = 14


# Wavelets: pairs of values as a mean and a difference, on 14 or on all 16 bits


def _signed(v: np.ndarray) -> np.ndarray:
    return (v + 32768 & 0xFFFF) - 32768


def _pair(a: np.ndarray, b: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    if small:
        a, b = _signed(a), _signed(b)
        return (a + b >> 1) & 0xFFFF, (a - b) & 0xFFFF
    a = a + 32768 & 0xFFFF
    d = a - b
    return ((a + b >> 1) + np.where(d < 0, 32768, 0)) & 0xFFFF, d & 0xFFFF


def _unpair(m: np.ndarray, d: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    if small:
        m, d = _signed(m), _signed(d)
        a = m + (d & 1) + (d >> 1)
        return a & 0xFFFF, (a - d) & 0xFFFF
    b = m - (d >> 1) & 0xFFFF
    return d + b - 32768 & 0xFFFF, b


def _steps(h: int, w: int) -> list[int]:
    out, p = [], 1
    while 2 * p <= min(h, w):
        out.append(p)
        p *= 2
    return out


def wavelet(v: np.ndarray, small: bool, back: bool = False) -> np.ndarray:
    """`v` (rows, columns) transformed, or transformed back."""
    v = v.astype(np.int64)
    h, w = v.shape
    f = _unpair if back else _pair
    for p in reversed(_steps(h, w)) if back else _steps(h, w):
        rows, cols = h // (2 * p) * 2 * p, w // (2 * p) * 2 * p
        top, low = slice(0, rows, 2 * p), slice(p, rows, 2 * p)
        left, right = slice(0, cols, 2 * p), slice(p, cols, 2 * p)
        a, b, c, d = v[top, left], v[top, right], v[low, left], v[low, right]
        if back:
            a, c = f(a, c, small)
            b, d = f(b, d, small)
            a, b = f(a, b, small)
            c, d = f(c, d, small)
        else:
            a, b = f(a, b, small)
            c, d = f(c, d, small)
            a, c = f(a, c, small)
            b, d = f(b, d, small)
        v[top, left], v[top, right], v[low, left], v[low, right] = a, b, c, d
        if w & p:
            v[top, cols], v[low, cols] = f(v[top, cols], v[low, cols], small)
        if h & p:
            v[rows, left], v[rows, right] = f(v[rows, left], v[rows, right], small)
    return v


# Prefix codes


def _canonical(lengths: dict[int, int]) -> dict[int, int]:
    """The code of each symbol; longer codes are lower."""
    count = [0] * 60
    for n in lengths.values():
        count[n] += 1
    code, first = 0, [0] * 60
    for n in range(58, 0, -1):
        first[n], code = code, (code + count[n]) >> 1
    out = {}
    for s in sorted(lengths):
        out[s] = first[lengths[s]]
        first[lengths[s]] += 1
    return out


def _write_lengths(lengths: dict[int, int], low: int, high: int) -> bytes:
    bits, size, s = 0, 0, low
    while s <= high:
        n = lengths.get(s, 0)
        if n:
            bits, size, s = bits << 6 | n, size + 6, s + 1
            continue
        run = 1
        while s + run <= high and run < MOST_LONG and s + run not in lengths:
            run += 1
        s += run
        if run >= LEAST_LONG:
            bits, size = bits << 14 | LONG_RUN << 8 | run - LEAST_LONG, size + 14
        else:
            bits, size = bits << 6 | (SHORT_RUN + run - 2 if run > 1 else 0), size + 6
    pad = -size % 8
    return (bits << pad).to_bytes((size + pad) // 8, "big")


def _read_lengths(b: bytes, low: int, high: int) -> tuple[dict[int, int], int]:
    """Lengths by symbol, and the bytes they took."""
    at, s, out = 0, low, {}
    whole = int.from_bytes(b[: 16 + (high - low + 1) * 2], "big")
    total = 8 * len(b[: 16 + (high - low + 1) * 2])
    while s <= high:
        n = whole >> total - at - 6 & 63
        at += 6
        if n == LONG_RUN:
            s += (whole >> total - at - 8 & 255) + LEAST_LONG
            at += 8
        elif n >= SHORT_RUN:
            s += n - SHORT_RUN + 2
        else:
            if n:
                out[s] = n
            s += 1
    return out, -(-at // 8)


def _encode(v: np.ndarray) -> bytes:
    symbols, counts = np.unique(v, return_counts=True)
    low, high = int(symbols[0]), int(symbols[-1]) + 1
    freq = {**dict(zip(symbols.tolist(), counts.tolist(), strict=True)), high: 1}
    heap = [(n, s, (s,)) for s, n in freq.items()]
    heapq.heapify(heap)
    lengths, serial = dict.fromkeys(freq, 0), high + 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
        serial += 1
    codes, bits, size, out = _canonical(lengths), 0, 0, bytearray()
    total = 0
    ends = [*(np.nonzero(np.diff(v))[0] + 1).tolist(), len(v)]
    begin = 0
    for end in ends:
        s = int(v[begin])
        n, c = lengths[s], codes[s]
        left, begin = end - begin, end
        while left:
            run = min(left, 256)
            left -= run
            if n + lengths[high] + 8 < n * (run - 1):
                bits, k = (bits << n | c) << lengths[high] | codes[high], n + lengths[high] + 8
                bits = bits << 8 | run - 1
            else:
                k = n * run
                for _ in range(run):
                    bits = bits << n | c
            size, total = size + k, total + k
            if size > 4096:
                out += (bits >> size % 8).to_bytes(size // 8, "big")
                bits, size = bits & (1 << size % 8) - 1, size % 8
    pad = -size % 8
    out += (bits << pad).to_bytes((size + pad) // 8, "big")
    table = _write_lengths(lengths, low, high)
    return struct.pack("<5I", low, high, len(table), total, 0) + table + bytes(out)


def _decode(b: bytes, count: int) -> np.ndarray:
    low, high, _, total, _ = struct.unpack("<5I", b[:20])
    lengths, taken = _read_lengths(b[20:], low, high)
    codes = _canonical(lengths)
    look: list = [None] * (1 << _LOOK)
    long: dict[tuple[int, int], int] = {}
    for s, n in lengths.items():
        if n <= _LOOK:
            begin = codes[s] << _LOOK - n
            look[begin : begin + (1 << _LOOK - n)] = [(n, s)] * (1 << _LOOK - n)
        else:
            long[n, codes[s]] = s
    data, out, held, size, at, used = b[20 + taken :], [], 0, 0, 0, 0
    longest = max(lengths.values(), default=0)
    while used < total:
        if size < 128:
            some = data[at : at + 64]
            at += 64
            held, size = (held & (1 << size) - 1) << 512 | int.from_bytes(some.ljust(64, b"\0"), "big"), size + 512
        found = look[held >> size - _LOOK & (1 << _LOOK) - 1]
        if found is None:
            n = _LOOK + 1
            while (s := long.get((n, held >> size - n & (1 << n) - 1))) is None:
                n += 1
                if n > longest:
                    raise Unreadable("EXR code that no table has")
        else:
            n, s = found
        size, used = size - n, used + n
        if s == high:
            run = held >> size - 8 & 255
            size, used = size - 8, used + 8
            out += out[-1:] * run
        else:
            out.append(s)
    if len(out) != count:
        raise Unreadable("EXR block of a wrong length")
    return np.array(out, np.int64)


def _planes(types: list[int], width: int, rows: int) -> list[tuple[int, int, int]]:
    """(first word, words of a sample, words) of each channel, all of whose rows stand together."""
    out, at = [], 0
    for t in types:
        words = 1 if t == 1 else 2
        out.append((at, words, words * width * rows))
        at += words * width * rows
    return out


def _by_channel(b: bytes, types: list[int], width: int, rows: int, back: bool = False) -> bytes:
    """Words by rows and channels put into the order of channels and rows, or back."""
    lines = [2 * width * (1 if t == 1 else 2) for t in types]
    if back:
        starts, at = [], 0
        for n in lines:
            starts.append(at)
            at += n * rows
        return b"".join(b[s + r * n : s + (r + 1) * n] for r in range(rows) for s, n in zip(starts, lines, strict=True))
    whole, offsets = sum(lines), np.cumsum([0, *lines]).tolist()
    return b"".join(b[r * whole + o : r * whole + o + n] for o, n in zip(offsets, lines, strict=False) for r in range(rows))


def compress(b: bytes, types: list[int], width: int, rows: int) -> bytes:
    words = np.frombuffer(_by_channel(b, types, width, rows), "<u2").astype(np.int64)
    seen = np.zeros(65536, np.uint8)
    seen[words] = 1
    seen[0] = 0
    bitmap = np.packbits(seen, bitorder="little")
    used = np.nonzero(bitmap)[0]
    low, high = (int(used[0]), int(used[-1])) if len(used) else (8191, 0)
    seen[0] = 1
    rank = np.cumsum(seen, dtype=np.int64) - 1
    words, small = rank[words], rank[-1] < 1 << _LOOK
    for at, n, size in _planes(types, width, rows):
        for j in range(n):
            plane = words[at + j : at + size : n].reshape(rows, width)
            words[at + j : at + size : n] = wavelet(plane, small).ravel()
    coded = _encode(words)
    return struct.pack("<HH", low, high) + (bitmap[low : high + 1].tobytes() if low <= high else b"") + struct.pack("<i", len(coded)) + coded


def decompress(b: bytes, types: list[int], width: int, rows: int) -> bytes:
    low, high = struct.unpack("<HH", b[:4])
    at, bitmap = 4, np.zeros(8192, np.uint8)
    if low <= high:
        bitmap[low : high + 1] = np.frombuffer(b, np.uint8, high - low + 1, 4)
        at += high - low + 1
    seen = np.unpackbits(bitmap, bitorder="little")
    seen[0] = 1
    values = np.nonzero(seen)[0]
    (size,) = struct.unpack("<i", b[at : at + 4])
    planes = _planes(types, width, rows)
    words = _decode(b[at + 4 : at + 4 + size], sum(n for *_, n in planes))
    small = len(values) - 1 < 1 << _LOOK
    for at, n, size in planes:
        for j in range(n):
            plane = words[at + j : at + size : n].reshape(rows, width)
            words[at + j : at + size : n] = wavelet(plane, small, True).ravel()
    return _by_channel(np.append(values, np.zeros(65536 - len(values), np.int64))[words & 0xFFFF].astype("<u2").tobytes(), types, width, rows, True)


# B44: squares of half floats


def _ordered(v: np.ndarray) -> np.ndarray:
    """Half floats' bits as integers in the order of their values; not finite ones as zero."""
    v = np.where(v & 0x7C00 == 0x7C00, 0, v)
    return np.where(v & 0x8000, ~v & 0xFFFF, v | 0x8000)


def _square(s: list[int], flat: bool) -> bytes:
    """14 bytes of 16 ordered values (rows of four), or 3 where all are equal and `flat` allows it."""
    if flat and len(set(s)) == 1:
        return struct.pack(">H", s[0]) + b"\xfc"
    top = max(s)
    shift = -1
    while True:
        shift += 1
        d = [(((top - x) << 1) + (1 << shift) - 1 + ((top - x) >> shift & 1)) >> shift + 1 for x in s]
        steps = [d[4 * y] - d[4 * y + 4] + 32 for y in range(3)] + [d[4 * y + x] - d[4 * y + x + 1] + 32 for x in range(3) for y in range(4)]
        if min(steps) >= 0 and max(steps) <= 63:
            break
    first = top - (d[0] << shift)
    bits = (first & 0xFFFF) << 6 | shift
    for x in steps:
        bits = bits << 6 | x
    return bits.to_bytes(14, "big")


def _unsquare(b: bytes, at: int) -> tuple[list[int], int]:
    """16 ordered values and where the next square begins."""
    first = b[at] << 8 | b[at + 1]
    if b[at + 2] >= 13 << 2:
        return [first] * 16, at + 3
    bits = int.from_bytes(b[at : at + 14], "big")
    shift = b[at + 2] >> 2
    step = [((bits >> 84 - 6 * i & 63) - 32) << shift for i in range(15)]
    s = [0] * 16
    s[0] = first
    for y in range(3):
        s[4 * y + 4] = s[4 * y] + step[y] & 0xFFFF
    for x in range(3):
        for y in range(4):
            s[4 * y + x + 1] = s[4 * y + x] + step[3 + 4 * x + y] & 0xFFFF
    return s, at + 14


def compress_b44(b: bytes, types: list[int], width: int, rows: int, flat: bool) -> bytes:
    whole, out = _by_channel(b, types, width, rows), []
    for t, (at, _, size) in zip(types, _planes(types, width, rows), strict=True):
        part = whole[2 * at : 2 * (at + size)]
        if t != 1:
            out.append(part)
            continue
        v = _ordered(np.frombuffer(part, "<u2").astype(np.int64)).reshape(rows, width)
        v = np.pad(v, ((0, -rows % 4), (0, -width % 4)), "edge")
        for y in range(0, v.shape[0], 4):
            out += [_square(v[y : y + 4, x : x + 4].ravel().tolist(), flat) for x in range(0, v.shape[1], 4)]
    return b"".join(out)


def decompress_b44(b: bytes, types: list[int], width: int, rows: int) -> bytes:
    at, out = 0, []
    for t in types:
        if t != 1:
            out.append(b[at : at + 4 * width * rows])
            at += 4 * width * rows
            continue
        v = np.zeros((rows + -rows % 4, width + -width % 4), np.int64)
        for y in range(0, v.shape[0], 4):
            for x in range(0, v.shape[1], 4):
                s, at = _unsquare(b, at)
                v[y : y + 4, x : x + 4] = np.array(s).reshape(4, 4)
        v = v[:rows, :width]
        out.append(np.where(v & 0x8000, v & 0x7FFF, ~v & 0xFFFF).astype("<u2").tobytes())
    return _by_channel(b"".join(out), types, width, rows, True)
