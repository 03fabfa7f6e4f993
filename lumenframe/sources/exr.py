"""OpenEXR files of one or several parts, flat or deep, in lines or tiles, with levels and subsampled channels.

Compressions: none, RLE, ZIPS, ZIP, PIZ, PXR24, B44 and B44A; the DWA pair is refused. A box
of an image is read from the blocks that meet it only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import piz
from .picture import Picture, Unreadable

MAGIC = b"\x76\x2f\x31\x01"
#: Compression numbers and lines in a block. Fixed values.
NONE, RLE, ZIPS, ZIP, PIZ, PXR24, B44, B44A = 0, 1, 2, 3, 4, 5, 6, 7
LINES = {NONE: 1, RLE: 1, ZIPS: 1, ZIP: 16, PIZ: 32, PXR24: 16, B44: 32, B44A: 32}
TYPES = {0: np.dtype("<u4"), 1: np.dtype("<f2"), 2: np.dtype("<f4")}


def _text(b: bytes, at: int) -> tuple[str, int]:
    end = b.index(b"\0", at)
    return b[at:end].decode("latin-1"), end + 1


def _attributes(b: bytes, at: int) -> tuple[dict, int]:
    """One header's attributes by name, and where it ends."""
    found: dict = {}
    while b[at] != 0:
        name, at = _text(b, at)
        kind, at = _text(b, at)
        (n,) = struct.unpack("<i", b[at : at + 4])
        body = b[at + 4 : at + 4 + n]
        if n < 0 or len(body) < n:
            raise Unreadable("EXR attribute beyond the end of the file")
        at += 4 + n
        if kind == "chlist":
            channels, i = [], 0
            while body[i] != 0:
                c, i = _text(body, i)
                pixel, _, sx, sy = struct.unpack("<iIii", body[i : i + 16])
                channels.append((c, pixel, sx, sy))
                i += 16
            found[name] = channels
        elif kind == "box2i":
            found[name] = struct.unpack("<4i", body)
        elif kind == "compression":
            found[name] = body[0]
        elif kind == "tiledesc":
            found[name] = struct.unpack("<IIB", body)
        elif kind == "string":
            found[name] = body.decode("latin-1")
        elif kind in ("float", "int", "v2f", "v3f", "m33f", "m44f"):
            values = struct.unpack(f"<{n // 4}{'i' if kind == 'int' else 'f'}", body)
            found[name] = values[0] if len(values) == 1 else values
    return found, at + 1


def headers(b: bytes) -> tuple[list[dict], int]:
    """The attributes of each part, and where the offset tables begin."""
    if b[:4] != MAGIC:
        raise Unreadable("not an EXR file")
    try:
        (version,) = struct.unpack("<I", b[4:8])
        parts, at = [], 8
        while True:
            found, at = _attributes(b, at)
            found["multipart"] = bool(version & 0x1000)
            found["tiled"] = found["type"] in ("tiledimage", "deeptile") if "type" in found else bool(version & 0x200)
            found["deep"] = found.get("type", "").startswith("deep") if "type" in found else bool(version & 0x800)
            parts.append(found)
            if not version & 0x1000:
                return parts, at
            if b[at] == 0:
                return parts, at + 1
    except (IndexError, struct.error, ValueError) as e:
        raise Unreadable(f"broken EXR header: {e}") from e


def header(b: bytes, part: int = 0) -> dict:
    parts, _ = headers(b)
    if not 0 <= part < len(parts):
        raise Unreadable(f"no part {part} among {len(parts)}")
    return parts[part]


def _size(h: dict) -> tuple[int, int]:
    x0, y0, x1, y1 = h["dataWindow"]
    return x1 - x0 + 1, y1 - y0 + 1


def size_of(b: bytes, part: int = 0) -> tuple[int, int]:
    return _size(header(b, part))


def levels(h: dict) -> list[tuple[int, int]]:
    """(width, height) of each level of a part: halved until one pixel is left, rounded as its header says."""
    w, n = _size(h)
    mode = h["tiles"][2] if h["tiled"] else 0
    if mode & 15 == 0:
        return [(w, n)]
    halve = (lambda v, i: max(1, -(-v // (1 << i)))) if mode >> 4 else (lambda v, i: max(1, v >> i))
    count = 1 + (max(w, n) - 1).bit_length() if mode >> 4 else max(w, n).bit_length()
    return [(halve(w, i), halve(n, i)) for i in range(count)]


def _chunks(h: dict) -> int:
    """How many blocks a part has."""
    if "chunkCount" in h:
        return h["chunkCount"]
    w, n = _size(h)
    if not h["tiled"]:
        return -(-n // LINES.get(h["compression"], 1))
    tw, th, mode = h["tiles"]
    sizes = levels(h)
    if mode & 15 == 2:
        return sum(-(-a // tw) * -(-c // th) for a, _ in sizes for _, c in sizes)
    return sum(-(-a // tw) * -(-c // th) for a, c in sizes)


def _offsets(b: bytes, part: int) -> tuple[dict, list[int]]:
    parts, at = headers(b)
    if not 0 <= part < len(parts):
        raise Unreadable(f"no part {part} among {len(parts)}")
    at += 8 * sum(map(_chunks, parts[:part]))
    n = _chunks(parts[part])
    if at + 8 * n > len(b):
        raise Unreadable("EXR offsets beyond the end of the file")
    skip = 4 if parts[part]["multipart"] else 0
    return parts[part], [o + skip for o in struct.unpack(f"<{n}Q", b[at : at + 8 * n]) if o]


def _unpredict(b: bytes) -> bytes:
    """Undo the byte differences and put the two halves back in turn."""
    d = np.frombuffer(b, np.uint8).astype(np.int64)
    d[1:] -= 128
    d = (np.cumsum(d) & 255).astype(np.uint8)
    out = np.empty_like(d)
    half = (len(d) + 1) // 2
    out[0::2], out[1::2] = d[:half], d[half:]
    return out.tobytes()


def _predict(b: bytes) -> bytes:
    d = np.frombuffer(b, np.uint8)
    d = np.concatenate([d[0::2], d[1::2]]).astype(np.int64)
    out = d.copy()
    out[1:] = (d[1:] - d[:-1] + 128) & 255
    return out.astype(np.uint8).tobytes()


def _runs(b: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(b):
        n = b[i] - 256 if b[i] > 127 else b[i]
        if n < 0:
            out += b[i + 1 : i + 1 - n]
            i += 1 - n
        else:
            out += b[i + 1 : i + 2] * (n + 1)
            i += 2
    return bytes(out)


def _to_runs(b: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(b):
        j = i
        while j + 1 < len(b) and b[j + 1] == b[i] and j - i < 126:
            j += 1
        if j - i >= 2:
            out += bytes([j - i, b[i]])
            i = j + 1
            continue
        j = i
        while j < len(b) and j - i < 127 and not (j + 2 < len(b) and b[j] == b[j + 1] == b[j + 2]):
            j += 1
        out += bytes([256 - (j - i)]) + b[i:j]
        i = j
    return bytes(out)


#: Bytes that PXR24 keeps of a sample, and where they stand in its 32 bits.
_PXR24 = {0: (24, 16, 8, 0), 1: (8, 0), 2: (24, 16, 8)}


def _from_pxr24(b: bytes, types: list[int], width: int, rows: int) -> bytes:
    """Lines of samples from byte planes of differences."""
    raw, out, at = np.frombuffer(zlib.decompress(b), np.uint8), [], 0
    for _ in range(rows):
        for t in types:
            diffs = np.zeros(width, np.uint32)
            for shift in _PXR24[t]:
                diffs |= raw[at : at + width].astype(np.uint32) << np.uint32(shift)
                at += width
            values = np.cumsum(diffs, dtype=np.uint32)
            out.append((values.astype("<u2") if t == 1 else values.astype("<u4")).tobytes())
    return b"".join(out)


def _to_pxr24(b: bytes, types: list[int], width: int, rows: int) -> bytes:
    """The reverse; floats are cut to 24 bits."""
    planes, at = [], 0
    for _ in range(rows):
        for t in types:
            size = TYPES[t].itemsize
            values = np.frombuffer(b, "<u2" if t == 1 else "<u4", width, at).astype(np.uint32)
            at += size * width
            if t == 2:
                values &= np.uint32(0xFFFFFF00)
            diffs = np.diff(values, prepend=np.uint32(0))
            planes += [((diffs >> np.uint32(s)) & np.uint32(255)).astype(np.uint8).tobytes() for s in _PXR24[t]]
    return zlib.compress(b"".join(planes))


def unpacked(b: bytes, compression: int, size: int, types: list[int] | None = None, width: int = 0, rows: int = 0) -> bytes:
    """A block's bytes; blocks that didn't shrink are stored plainly."""
    if compression == NONE or len(b) == size:
        return b
    if compression == RLE:
        out = _unpredict(_runs(b))
    elif compression in (ZIPS, ZIP):
        out = _unpredict(zlib.decompress(b))
    elif compression == PXR24:
        out = _from_pxr24(b, types, width, rows)
    elif compression == PIZ:
        out = piz.decompress(b, types, width, rows)
    elif compression in (B44, B44A):
        out = piz.decompress_b44(b, types, width, rows)
    else:
        raise Unreadable(f"EXR compression {compression}")
    if len(out) != size:
        raise Unreadable("EXR block of a wrong size")
    return out


def packed(b: bytes, compression: int, types: list[int] | None = None, width: int = 0, rows: int = 0) -> bytes:
    if compression == NONE or not b:
        return b
    if compression == PXR24:
        small = _to_pxr24(b, types, width, rows)
    elif compression == PIZ:
        small = piz.compress(b, types, width, rows)
    elif compression in (B44, B44A):
        small = piz.compress_b44(b, types, width, rows, compression == B44A)
    else:
        small = _to_runs(_predict(b)) if compression == RLE else zlib.compress(_predict(b))
    return small if len(small) < len(b) else b


def _lower(name: str) -> str:
    return name.lower() if name in ("R", "G", "B", "A", "Y", "Z") else name


def _order(names) -> list[str]:
    order = {c: i for i, c in enumerate("RGBAYZ")}
    return sorted(names, key=lambda c: (order.get(c, 99), c))


def describe(b: bytes, part: int = 0) -> tuple[int, int, list[str], dict[str, str]]:
    """(width, height, channels, attributes) from the header alone."""
    h = header(b, part)
    text = {k: str(v) for k, v in h.items() if isinstance(v, str | float | int) and k not in ("tiled", "deep", "multipart", "compression", "lineOrder", "chunkCount")}
    return *_size(h), [_lower(c) for c in _order(c for c, *_ in h["channels"])], text


def read(b: bytes, part: int = 0, level: int = 0, box: tuple[int, int, int, int] | None = None) -> Picture:
    """A flat part at a level of its pyramid; `box` (x0, y0, x1, y1, half open, from the data window's corner) reads that box only."""
    h, offsets = _offsets(b, part)
    if h["deep"]:
        raise Unreadable("deep EXR read as flat")
    if h["compression"] not in LINES:
        raise Unreadable(f"EXR compression {h['compression']}")
    channels = h["channels"]
    x0, y0, _, _ = h["dataWindow"]
    sizes = levels(h)
    if not 0 <= level < len(sizes):
        raise Unreadable(f"no level {level} among {len(sizes)}")
    w, n = sizes[level]
    bx0, by0, bx1, by1 = box or (0, 0, w, n)
    bx0, by0, bx1, by1 = max(0, bx0), max(0, by0), min(w, bx1), min(n, by1)
    if bx0 >= bx1 or by0 >= by1:
        raise Unreadable("a box outside the image")
    out = {c: np.zeros((by1 - by0, bx1 - bx0), np.float32) for c, *_ in channels}
    types = [t for _, t, *_ in channels]
    whole = all((sx, sy) == (1, 1) for *_, sx, sy in channels)

    def put(body: bytes, x: int, y: int, width: int, rows: int) -> None:
        left, right = max(x, bx0), min(x + width, bx1)
        if not whole:
            _put_sampled(body, y, rows)
            return
        line, i = sum(TYPES[t].itemsize for t in types) * width, 0
        lines = np.frombuffer(body, np.uint8).reshape(rows, line)[max(0, by0 - y) : by1 - y]
        for c, t, *_ in channels:
            size = TYPES[t].itemsize * width
            values = np.ascontiguousarray(lines[:, i : i + size]).view(TYPES[t])
            i += size
            out[c][max(y, by0) - by0 : max(y, by0) - by0 + len(lines), left - bx0 : right - bx0] = values[:, left - x : right - x]

    def _put_sampled(body: bytes, y: int, rows: int) -> None:
        i = 0
        for r in range(y, y + rows):
            for c, t, sx, sy in channels:
                if (y0 + r) % sy:
                    continue
                at = np.arange(-x0 % sx, w, sx)  # the columns that have a sample
                values = np.frombuffer(body, TYPES[t], len(at), i).astype(np.float32)
                i += TYPES[t].itemsize * len(at)
                line = values[np.clip(np.searchsorted(at, np.arange(bx0, bx1), "right") - 1, 0, None)]
                for row in range(r, min(r + sy, n)):
                    if by0 <= row < by1:
                        out[c][row - by0] = line

    def bytes_of(width: int, y: int, rows: int) -> int:
        if whole:
            return sum(TYPES[t].itemsize for t in types) * width * rows
        return sum(
            TYPES[t].itemsize * len(range(-x0 % sx, w, sx)) * sum((y0 + r) % sy == 0 for r in range(y, y + rows)) for _, t, sx, sy in channels
        )

    if not whole and h["compression"] in (PIZ, PXR24, B44, B44A):
        raise Unreadable("subsampled EXR of this compression")
    for o in offsets:
        if h["tiled"]:
            tw, th, _ = h["tiles"]
            tx, ty, lx, ly, size = struct.unpack("<5i", b[o : o + 20])
            if (lx, ly) != (level, level):
                continue
            x, y, o = tx * tw, ty * th, o + 20
            width, rows = min(tw, w - x), min(th, n - y)
        else:
            y, size = struct.unpack("<ii", b[o : o + 8])
            x, y, o, width = 0, y - y0, o + 8, w
            rows = min(LINES[h["compression"]], n - y)
        if x < bx1 and x + width > bx0 and y < by1 and y + rows > by0:
            if len(b) < o + size:
                raise Unreadable("EXR block beyond the end of the file")
            put(unpacked(b[o : o + size], h["compression"], bytes_of(width, y, rows), types, width, rows), x, y, width, rows)
    return Picture({_lower(c): out[c] for c in _order(out)}, describe(b, part)[3], "exr")


def _attribute(name: str, kind: str, body: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(body)) + body


def _head(channels: list[tuple], w: int, n: int, compression: int, attributes: dict[str, str], deep: bool = False, tile: int = 0, pyramid: bool = False) -> bytes:
    """A header's attributes. Channels: name, type and, if they are subsampled, steps across and down."""
    chlist = b"".join(c.encode() + b"\0" + struct.pack("<iIii", t, 0, *(steps or (1, 1))) for c, t, *steps in channels) + b"\0"
    box = struct.pack("<4i", 0, 0, w - 1, n - 1)
    out = _attribute("channels", "chlist", chlist)
    out += _attribute("compression", "compression", bytes([compression])) + _attribute("dataWindow", "box2i", box)
    out += _attribute("displayWindow", "box2i", box) + _attribute("lineOrder", "lineOrder", b"\0")
    out += _attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + _attribute("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0))
    out += _attribute("screenWindowWidth", "float", struct.pack("<f", 1))
    if deep:
        out += _attribute("type", "string", b"deeptile" if tile else b"deepscanline") + _attribute("version", "int", struct.pack("<i", 1))
        out += _attribute("chunkCount", "int", struct.pack("<i", -(-w // tile) * -(-n // tile) if tile else n))
    if tile:
        out += _attribute("tiles", "tiledesc", struct.pack("<IIB", tile, tile, int(pyramid)))
    for k, v in attributes.items():
        out += _attribute(k, "string", v.encode("latin-1", "replace"))
    return out + b"\0"


def _start(deep: bool = False, tile: int = 0, multipart: bool = False) -> bytes:
    return MAGIC + struct.pack("<I", 2 | (0x800 if deep else 0) | (0x200 if tile and not deep and not multipart else 0) | (0x1000 if multipart else 0))


_OWN = ("pixelAspectRatio", "screenWindowWidth", "channels", "dataWindow", "tiles", "type", "name", "chunkCount")


def _blocks(p: Picture, compression: int, t: int, tile: int, pyramid: list[Picture]) -> list[bytes]:
    """The blocks of a flat picture: in lines, or in tiles, of all sizes in turn."""
    blocks = []
    for level, q in enumerate([p, *pyramid]):
        names = _written(q)
        order = sorted(names)

        def block(x: int, y: int, w: int, rows: int, names=names, order=order) -> bytes:
            body = b"".join(names[c][r, x : x + w].astype(TYPES[t]).tobytes() for r in range(y, y + rows) for c in order)
            return packed(body, compression, [t] * len(order), w, rows)

        if tile:
            for ty in range(-(-q.height // tile)):
                for tx in range(-(-q.width // tile)):
                    small = block(tx * tile, ty * tile, min(tile, q.width - tx * tile), min(tile, q.height - ty * tile))
                    blocks.append(struct.pack("<5i", tx, ty, level, level, len(small)) + small)
            continue
        for y in range(0, q.height, LINES[compression]):
            small = block(0, y, q.width, min(LINES[compression], q.height - y))
            blocks.append(struct.pack("<ii", y, len(small)) + small)
    return blocks


def _written(p: Picture) -> dict[str, np.ndarray]:
    return {(c.upper() if c in ("r", "g", "b", "a", "y", "z") else c): v for c, v in p.channels.items()}


def write(p: Picture, compression: int = ZIP, half: bool = False, tile: int = 0, pyramid: list[Picture] | None = None) -> bytes:
    """In lines, or in square tiles of a given side, then with the smaller pictures of `pyramid` as further levels."""
    t = 1 if half else 2
    channels = [(c, t) for c in sorted(_written(p))]
    head = _start(tile=tile) + _head(channels, p.width, p.height, compression, {k: v for k, v in p.attributes.items() if k not in _OWN}, False, tile, bool(pyramid))
    return _joined(head, _blocks(p, compression, t, tile, pyramid or []))


def write_parts(parts: dict[str, Picture], compression: int = ZIP, half: bool = False) -> bytes:
    """Several pictures as named parts of one file."""
    t, heads, blocks = 1 if half else 2, b"", []
    for i, (name, p) in enumerate(parts.items()):
        mine = _blocks(p, compression, t, 0, [])
        own = {k: v for k, v in p.attributes.items() if k not in _OWN}
        head = _head([(c, t) for c in sorted(_written(p))], p.width, p.height, compression, {"name": name, "type": "scanlineimage", **own})
        heads += head[:-1] + _attribute("chunkCount", "int", struct.pack("<i", len(mine))) + b"\0"
        blocks += [struct.pack("<i", i) + x for x in mine]
    return _joined(_start(multipart=True) + heads + b"\0", blocks)


def write_sampled(p: Picture, steps: dict[str, tuple[int, int]], compression: int = ZIP) -> bytes:
    """In lines of floats, of some channels only each so many columns and rows."""
    names = _written(p)
    channels = [(c, 2, *steps.get(_lower(c), (1, 1))) for c in sorted(names)]
    blocks = []
    for y in range(0, p.height, LINES[compression]):
        rows = range(y, min(y + LINES[compression], p.height))
        body = b"".join(names[c][r, ::sx].astype("<f4").tobytes() for r in rows for c, _, sx, sy in channels if r % sy == 0)
        small = packed(body, compression)
        blocks.append(struct.pack("<ii", y, len(small)) + small)
    return _joined(_start() + _head(channels, p.width, p.height, compression, {}), blocks)


def _joined(head: bytes, blocks: list[bytes]) -> bytes:
    at, offsets = len(head) + 8 * len(blocks), []
    for x in blocks:
        offsets.append(at)
        at += len(x)
    return head + struct.pack(f"<{len(blocks)}Q", *offsets) + b"".join(blocks)


def read_deep(b: bytes, part: int = 0) -> dict[str, np.ndarray]:
    """Samples of a deep part (of a pyramid the full size): arrays y, x, s (place in the pixel) and one for each channel."""
    h, offsets = _offsets(b, part)
    if not h["deep"]:
        raise Unreadable("a flat EXR read as deep")
    _, y0, _, _ = h["dataWindow"]
    w, n = _size(h)
    out: dict[str, list] = {k: [] for k in ("y", "x", "s", *(_lower(c) for c, *_ in h["channels"]))}
    for o in offsets:
        x, width, rows = 0, w, 1
        if h["tiled"]:
            tw, th, _ = h["tiles"]
            tx, ty, lx, ly = struct.unpack("<4i", b[o : o + 16])
            if (lx, ly) != (0, 0):
                continue
            x, y, o = tx * tw, ty * th, o + 16
            width, rows = min(tw, w - x), min(th, n - y)
        else:
            (y,) = struct.unpack("<i", b[o : o + 4])
            y, o = y - y0, o + 4
        packed_counts, packed_data, size = struct.unpack("<3Q", b[o : o + 24])
        o += 24
        body = unpacked(b[o : o + packed_counts], h["compression"], 4 * width * rows)
        # Counts run up within each line.
        counts = np.diff(np.frombuffer(body, "<i4", width * rows).reshape(rows, width), axis=1, prepend=0)
        data = unpacked(b[o + packed_counts : o + packed_counts + packed_data], h["compression"], size)
        per_line, flat = counts.sum(axis=1), counts.ravel()
        total, i = int(flat.sum()), 0
        out["y"].append(np.repeat(np.arange(y, y + rows, dtype=np.int32), per_line))
        out["x"].append(np.repeat(np.tile(np.arange(x, x + width, dtype=np.int32), rows), flat))
        out["s"].append((np.arange(total) - np.repeat(np.cumsum(flat) - flat, flat)).astype(np.int32))
        lines: dict[str, list] = {c: [] for c, *_ in h["channels"]}
        for m in per_line.tolist():
            for c, t, *_ in h["channels"]:
                lines[c].append(np.frombuffer(data, TYPES[t], m, i).astype(np.float32))
                i += TYPES[t].itemsize * m
        for c, *_ in h["channels"]:
            out[_lower(c)].append(np.concatenate(lines[c]))
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}


def write_deep(samples: dict[str, np.ndarray], width: int, height: int, compression: int = ZIPS, tile: int = 0) -> bytes:
    """The inverse of `read_deep`; rows in any order."""
    order = np.lexsort((samples["s"], samples["x"], samples["y"]))
    rows = {k: np.asarray(v)[order] for k, v in samples.items()}
    names = {(c.upper() if c in ("r", "g", "b", "a", "z") else c): v for c, v in rows.items() if c not in ("y", "x", "s")}
    channels = [(c, 2) for c in sorted(names)]
    head = _start(True) + _head(channels, width, height, compression, {}, True, tile)
    boxes = (
        [(x, y, min(tile, width - x), min(tile, height - y)) for y in range(0, height, tile) for x in range(0, width, tile)]
        if tile else [(0, y, width, 1) for y in range(height)]
    )
    blocks = []
    for x, y, w, n in boxes:
        counts, data = b"", b""
        for line in range(y, y + n):
            mine = (rows["y"] == line) & (rows["x"] >= x) & (rows["x"] < x + w)
            counts += np.cumsum(np.bincount(rows["x"][mine] - x, minlength=w)).astype("<i4").tobytes()
            data += b"".join(names[c][mine].astype("<f4").tobytes() for c, _ in channels)
        small_counts, small = packed(counts, compression), packed(data, compression)
        place = struct.pack("<4i", x // tile, y // tile, 0, 0) if tile else struct.pack("<i", y)
        blocks.append(place + struct.pack("<3Q", len(small_counts), len(small), len(data)) + small_counts + small)
    return _joined(head, blocks)
