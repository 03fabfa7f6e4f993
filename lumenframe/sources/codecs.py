"""Image file formats: bytes to arrays and back, in numpy and the standard library.

`decode` tells formats apart by their first bytes. All decoders give a `Picture`:
channels by name as float32 arrays of one size, normalised as stored integers are
(8 bit by 255, 16 bit by 65535), and attributes as text. Files of several images (EXR parts,
TIFF pages) have them by number; `describe` reads headers only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import exr, jpeg, textures
from .picture import Picture, Unreadable, from_int, named, names_of

def stacked(p: Picture) -> np.ndarray:
    return np.stack(list(p.channels.values()), axis=-1)


def to_int(data: np.ndarray, bits: int) -> np.ndarray:
    """Floats to integers of 8 or 16 bits: clamped, scaled, cut off."""
    return (np.clip(np.nan_to_num(data), 0, 1) * (2**bits - 1)).astype(np.uint8 if bits == 8 else np.uint16)


# PNG


#: First column and row, and steps across and down, of the passes of an interlaced PNG. Fixed values.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png_chunks(b: bytes):
    at = 8
    while at + 8 <= len(b):
        (n,) = struct.unpack(">I", b[at : at + 4])
        yield b[at + 4 : at + 8], b[at + 8 : at + 8 + n]
        at += 12 + n


def read_png(b: bytes) -> Picture:
    idat, palette, alpha, text = [], None, None, {}
    for kind, body in _png_chunks(b):
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            idat.append(body)
        elif kind == b"tEXt":
            key, _, value = body.partition(b"\0")
            text[key.decode("latin-1")] = value.decode("latin-1")
        elif kind == b"IEND":
            break
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw, at = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8), 0
    data = np.zeros((h, w, per), np.uint16 if depth == 16 else np.uint8)
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        wide, high = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if wide <= 0 or high <= 0:
            continue
        stride = (wide * per * depth + 7) // 8 + 1
        lines = _unfilter(raw[at : at + high * stride].reshape(high, stride), max(1, per * depth // 8))
        at += high * stride
        if depth == 16:
            part = lines.reshape(high, -1).view(">u2").reshape(high, wide, per)
        elif depth == 8:
            part = lines.reshape(high, wide, per)
        else:
            bits = np.unpackbits(lines, axis=1)[:, : wide * per * depth].reshape(high, -1, depth)
            part = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8).reshape(high, wide, per)
        data[y0::dy, x0::dx] = part
    if depth < 8 and color != 3:
        data = (data.astype(np.int64) * 255 // (2**depth - 1)).astype(np.uint8)
    if color == 3:
        rgb = palette[data[..., 0]]
        if alpha is not None:
            full = np.full(len(palette), 255, np.uint8)
            full[: len(alpha)] = alpha
            rgb = np.concatenate([rgb, full[data[..., 0]][..., None]], axis=-1)
        data = rgb
    return Picture(named(from_int(data)), text, "png")


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Scanlines without their prediction filters."""
    h, n = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((h, n), np.uint8)
    above = np.zeros(n, np.uint8)
    for i in range(h):
        kind, line = raw[i, 0], raw[i, 1:]
        if kind == 0:
            out[i] = line
        elif kind == 1:
            pad = (-n) % bpp
            cells = np.concatenate([line, np.zeros(pad, np.uint8)]).reshape(-1, bpp)
            out[i] = np.cumsum(cells, axis=0, dtype=np.uint8).ravel()[:n]
        elif kind == 2:
            out[i] = line + above
        else:
            now = bytearray(n)
            up, src = above.tolist(), line.tolist()
            for x in range(n):
                a = now[x - bpp] if x >= bpp else 0
                b = up[x]
                if kind == 3:
                    p = (a + b) >> 1
                else:
                    c = up[x - bpp] if x >= bpp else 0
                    t = a + b - c
                    da, db, dc = abs(t - a), abs(t - b), abs(t - c)
                    p = a if da <= db and da <= dc else (b if db <= dc else c)
                now[x] = (src[x] + p) & 255
            out[i] = np.frombuffer(bytes(now), np.uint8)
        above = out[i]
    return out


def write_png(p: Picture, bits: int = 8) -> bytes:
    data = to_int(stacked(p), bits)
    h, w, n = data.shape
    rows = data.astype(">u2").view(np.uint8).reshape(h, -1) if bits == 16 else data.reshape(h, -1)
    up = np.vstack([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])
    body = np.hstack([np.full((h, 1), 2, np.uint8), rows - up])
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    head = struct.pack(">IIBBBBB", w, h, bits, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    text = b"".join(chunk(b"tEXt", k.encode("latin-1", "replace") + b"\0" + v.encode("latin-1", "replace")) for k, v in p.attributes.items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + text + chunk(b"IDAT", zlib.compress(body.tobytes())) + chunk(b"IEND", b"")


# PNM and PFM


_PNM = {"P5": 1, "P6": 3, "Pf": 1, "PF": 3}


def _pnm_fields(b: bytes) -> tuple[list[str], int]:
    """Kind, width, height and top value, and where they end."""
    fields, at = [], 0
    while len(fields) < 4:
        while b[at : at + 1].isspace():
            at += 1
        if b[at : at + 1] == b"#":
            at = b.index(b"\n", at)
            continue
        end = at
        while end < len(b) and not b[end : end + 1].isspace():
            end += 1
        if end == at:
            raise Unreadable("broken PNM header")
        fields.append(b[at:end].decode())
        at = end
    return fields, at


def read_pnm(b: bytes) -> Picture:
    fields, at = _pnm_fields(b)
    kind, w, h = fields[0], int(fields[1]), int(fields[2])
    n = _PNM[kind]
    body = b[at + 1 :]
    if kind in ("Pf", "PF"):
        order = "<" if float(fields[3]) < 0 else ">"
        data = np.frombuffer(body, f"{order}f4", w * h * n).reshape(h, w, n)[::-1].astype(np.float32)
        return Picture(named(data), {}, "pfm")
    top = int(fields[3])
    data = np.frombuffer(body, ">u2" if top > 255 else np.uint8, w * h * n).reshape(h, w, n)
    return Picture(named(data.astype(np.float32) / np.float32(top)), {}, "pnm")


def write_pnm(p: Picture, bits: int = 8) -> bytes:
    data = to_int(stacked(p), bits)
    kind = {1: "P5", 3: "P6"}[data.shape[2]]
    return f"{kind}\n{p.width} {p.height}\n{2**bits - 1}\n".encode() + (data.astype(">u2") if bits == 16 else data).tobytes()


def write_pfm(p: Picture) -> bytes:
    data = stacked(p).astype("<f4")[::-1]
    return f"{'PF' if data.shape[2] == 3 else 'Pf'}\n{p.width} {p.height}\n-1.0\n".encode() + data.tobytes()


# Radiance HDR


def read_hdr(b: bytes) -> Picture:
    head, _, rest = b.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    part = size.split()
    h, w = int(part[1]), int(part[3])
    if part[0] != b"-Y" or part[2] != b"+X":
        raise Unreadable("turned HDR")
    out, at = np.zeros((h, w, 4), np.uint8), 0
    for y in range(h):
        if 8 <= w < 32768 and body[at : at + 2] == b"\x02\x02":
            at += 4
            for c in range(4):
                x = 0
                while x < w:
                    n = body[at]
                    if n > 128:
                        out[y, x : x + n - 128, c] = body[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        out[y, x : x + n, c] = np.frombuffer(body, np.uint8, n, at + 1)
                        x, at = x + n, at + 1 + n
        else:
            out[y] = np.frombuffer(body, np.uint8, w * 4, at).reshape(w, 4)
            at += w * 4
    e = out[..., 3].astype(np.int32)
    scale = np.where(e > 0, np.ldexp(1.0, e - 136), 0.0)
    return Picture(named((out[..., :3] * scale[..., None]).astype(np.float32)), _hdr_attributes(head), "hdr")


def _hdr_attributes(head: bytes) -> dict[str, str]:
    return dict(line.split("=", 1) for line in head.decode("latin-1").splitlines() if "=" in line and not line.startswith("#"))


def write_hdr(p: Picture) -> bytes:
    rgb = np.maximum(stacked(p)[..., :3].astype(np.float64), 0)
    top = rgb.max(axis=-1)
    mantissa, e = np.frexp(top)
    scale = np.where(top > 1e-32, mantissa * 256 / np.where(top > 1e-32, top, 1), 0)
    rgbe = np.concatenate([(rgb * scale[..., None]).astype(np.uint8), np.where(top > 1e-32, e + 128, 0)[..., None].astype(np.uint8)], axis=-1)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {p.height} +X {p.width}\n".encode() + rgbe.tobytes()


# DPX


def read_dpx(b: bytes) -> Picture:
    order = {b"SDPX": ">", b"XPDS": "<"}[b[:4]]
    u4 = lambda at: struct.unpack(f"{order}I", b[at : at + 4])[0]
    start, w, h = u4(4), u4(772), u4(776)
    kind, bits = b[800], b[803]
    (packing,) = struct.unpack(f"{order}H", b[804:806])
    n = {6: 1, 50: 3, 51: 4}.get(kind, 3)
    count = w * h * n
    if bits == 8:
        data = np.frombuffer(b, np.uint8, count, start).astype(np.float32) / 255
    elif bits == 16:
        data = np.frombuffer(b, f"{order}u2", count, start).astype(np.float32) / 65535
    elif bits == 12 and packing == 1:
        data = (np.frombuffer(b, f"{order}u2", count, start) >> 4).astype(np.float32) / 4095
    elif bits == 10 and packing == 1:
        per_line = -(-w * n // 3)
        cells = np.frombuffer(b, f"{order}u4", per_line * h, start).reshape(h, per_line)
        parts = np.stack([cells >> 22 & 1023, cells >> 12 & 1023, cells >> 2 & 1023], axis=-1).reshape(h, -1)[:, : w * n]
        data = parts.astype(np.float32).ravel() / 1023
    else:
        raise Unreadable(f"DPX of {bits} bits, packing {packing}")
    return Picture(named(data.reshape(h, w, n)), {"creator": b[160:260].split(b"\0")[0].decode("latin-1")}, "dpx")


def write_dpx(p: Picture, bits: int = 10, order: str = ">") -> bytes:
    data = np.clip(np.nan_to_num(stacked(p)), 0, 1).astype(np.float64)
    h, w, n = data.shape
    v = np.floor(data * (2**bits - 1) + 0.5).astype(np.uint32).reshape(h, w * n)
    if bits == 8:
        body = v.astype(np.uint8).tobytes()
    elif bits == 16:
        body = v.astype(f"{order}u2").tobytes()
    elif bits == 12:
        body = (v << 4).astype(f"{order}u2").tobytes()
    else:
        v = np.pad(v, ((0, 0), (0, (-v.shape[1]) % 3))).reshape(h, -1, 3)
        body = (v[..., 0] << 22 | v[..., 1] << 12 | v[..., 2] << 2).astype(f"{order}u4").tobytes()
    head = bytearray(2048)
    head[:4] = b"SDPX" if order == ">" else b"XPDS"
    put = lambda at, f, *x: struct.pack_into(order + f, head, at, *x)
    put(4, "I", 2048)
    head[8:12] = b"V2.0"
    put(16, "I", 2048 + len(body))
    put(768, "HHII", 0, 1, w, h)
    head[800], head[801], head[802], head[803] = {1: 6, 3: 50, 4: 51}[n], 2, 2, bits
    put(804, "HHI", 1 if bits in (10, 12) else 0, 0, 2048)
    return bytes(head) + body


# TIFF (strips and tiles, chunky and planar, pages; none, LZW, deflate and packbits)

_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8}


def _tiff_page(b: bytes, page: int) -> tuple[str, dict]:
    """The byte order, and the tags of a page."""
    order = {b"II": "<", b"MM": ">"}[b[:2]]
    (at,) = struct.unpack(f"{order}I", b[4:8])
    for _ in range(page):
        (count,) = struct.unpack(f"{order}H", b[at : at + 2])
        (at,) = struct.unpack(f"{order}I", b[at + 2 + 12 * count : at + 6 + 12 * count])
        if not at:
            raise Unreadable(f"no page {page}")
    (count,) = struct.unpack(f"{order}H", b[at : at + 2])
    tags: dict = {}
    for i in range(count):
        tag, kind, n = struct.unpack(f"{order}HHI", b[at + 2 + 12 * i : at + 10 + 12 * i])
        size = _TIFF_SIZES.get(kind, 1) * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack(f"{order}I", b[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        if kind == 2:
            tags[tag] = b[where : where + n].rstrip(b"\0").decode("latin-1")
        elif kind in (3, 4):
            tags[tag] = struct.unpack(f"{order}{n}{'H' if kind == 3 else 'I'}", b[where : where + size])
    return order, tags


def tiff_pages(b: bytes) -> int:
    order, n = {b"II": "<", b"MM": ">"}[b[:2]], 0
    (at,) = struct.unpack(f"{order}I", b[4:8])
    while at and n < 65536:
        (count,) = struct.unpack(f"{order}H", b[at : at + 2])
        (at,) = struct.unpack(f"{order}I", b[at + 2 + 12 * count : at + 6 + 12 * count])
        n += 1
    return n


def read_tiff(b: bytes, page: int = 0) -> Picture:
    order, tags = _tiff_page(b, page)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, n = one(256), one(257), one(277, 1)
    bits, pressed, kind, predictor, planar = one(258, 1), one(259, 1), one(339, 1), one(317, 1), one(284, 1) == 2
    if (bits, kind) not in ((8, 1), (16, 1), (32, 1), (32, 3), (16, 3)) or predictor not in (1, 2):
        raise Unreadable(f"TIFF of {bits} bits, kind {kind}, predictor {predictor}")
    dtype = np.dtype(order + {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (16, 3): "f2"}[bits, kind])
    tiled = 322 in tags
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    wide, high = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    across, down, per = -(-w // wide), -(-h // high), 1 if planar else n
    data = np.zeros((h, w, n), dtype.newbyteorder("="))
    for i, (o, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(i, across * down)
        y, x = place // across * high, place % across * wide
        rows = high if tiled else min(high, h - y)
        part = np.frombuffer(_inflate(b[o : o + size], pressed), dtype, rows * wide * per).reshape(rows, wide, per)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        data[y : y + rows, x : x + wide, plane : plane + per] = part[: h - y, : w - x]
    values = data.astype(np.float32) if kind == 3 or bits == 32 else from_int(data)
    return Picture(named(values), {"description": tags.get(270, "")}, "tiff")


def _lzw(b: bytes) -> bytes:
    """Variable codes of 9 to 12 bits, high bits first; a code is longer one entry before the table needs it."""
    out, at, held, size = [], 0, 0, 0
    table: list[bytes] = []
    width, last = 9, b""
    while True:
        while size < width:
            if at >= len(b):
                return b"".join(out)
            held, size, at = held << 8 | b[at], size + 8, at + 1
        size -= width
        code = held >> size
        held &= (1 << size) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise Unreadable("TIFF code that no table has")
        out.append(now)
        if last:
            table.append(last + now[:1])
        last = now
        width = min(12, max(9, (len(table) + 1).bit_length()))


def _inflate(b: bytes, pressed: int) -> bytes:
    if pressed == 1:
        return b
    if pressed == 5:
        return _lzw(b)
    if pressed in (8, 32946):
        return zlib.decompress(b)
    if pressed == 32773:
        return textures.unpackbits(b)
    raise Unreadable(f"TIFF compression {pressed}")


def write_tiff(p: Picture, bits: int = 16, deflate: bool = True) -> bytes:
    """8 and 16 bits are integers, 32 are floats."""
    data = stacked(p)
    h, w, n = data.shape
    raw = (data.astype("<f4") if bits == 32 else to_int(data, bits).astype(f"<u{bits // 8}")).tobytes()
    body = zlib.compress(raw) if deflate else raw
    many = struct.pack(f"<{n}H", *[bits] * n) if n > 2 else b""
    formats = struct.pack(f"<{n}H", *[3 if bits == 32 else 1] * n) if n > 2 else b""
    entries = [
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, n, many or bits), (259, 3, 1, 8 if deflate else 1), (262, 3, 1, 2 if n >= 3 else 1),
        (273, 4, 1, None), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(body)), (339, 3, n, formats or (3 if bits == 32 else 1)),
    ]
    extra_at = 8 + 2 + 12 * len(entries) + 4
    offset = extra_at + len(many) + len(formats)
    out, used, extra = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), extra_at, b""
    for tag, kind, count, value in entries:
        if isinstance(value, bytes):
            out += struct.pack("<HHII", tag, kind, count, used)
            used, extra = used + len(value), extra + value
        else:
            v = offset if value is None else value
            out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", v, v if count == 2 else 0) if kind == 3 else struct.pack("<I", v))
    return out + struct.pack("<I", 0) + extra + body


def probe(b: bytes) -> str:
    """The format of a file by its first bytes; empty if unknown."""
    for start, name in (
        (b"\x89PNG\r\n\x1a\n", "png"), (b"P5", "pnm"), (b"P6", "pnm"), (b"Pf", "pfm"), (b"PF", "pfm"), (b"#?", "hdr"), (b"SDPX", "dpx"), (b"XPDS", "dpx"),
        (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (exr.MAGIC, "exr"), (b"\xff\xd8\xff", "jpeg"), (b"8BPS", "psd"), (b"DDS ", "dds"), (b"\xabKTX", "ktx"),
        (b"RIFF", "webp"), (b"\0\0\0\x0cjP", "jp2"), (b"ARRI", "arriraw"), (b"RED", "redcode"),
    ):
        if b.startswith(start):
            return name
    return "heif" if b[4:8] == b"ftyp" else ""


def decode(b: bytes, subimage: int = 0) -> Picture:
    """The picture of a file, or a further one of a file of several."""
    readers = {
        "png": read_png, "pnm": read_pnm, "pfm": read_pnm, "hdr": read_hdr, "dpx": read_dpx, "jpeg": jpeg.read, "psd": textures.read_psd,
        "dds": textures.read_dds,
    }
    name = probe(b)
    try:
        if name == "exr":
            return exr.read(b, subimage)
        if name == "tiff":
            return read_tiff(b, subimage)
        if name not in readers:
            raise Unreadable(name or "unknown format")
        if subimage:
            raise Unreadable(f"no image {subimage}")
        return readers[name](b)
    except (IndexError, KeyError, UnboundLocalError, struct.error, zlib.error, TypeError, ValueError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable(f"broken {name or 'file'}: {type(e).__name__} {e}") from e


def subimages(b: bytes) -> int:
    """How many pictures a file holds."""
    name = probe(b)
    return len(exr.headers(b)[0]) if name == "exr" else tiff_pages(b) if name == "tiff" else 1


def describe(b: bytes, subimage: int = 0) -> tuple[int, int, list[str], dict[str, str]]:
    """(width, height, channels, attributes) from headers, without decoding pixels."""
    name = probe(b)
    try:
        if name == "exr":
            return exr.describe(b, subimage)
        if name == "tiff":
            _, tags = _tiff_page(b, subimage)
            return tags[256][0], tags[257][0], names_of(tags.get(277, (1,))[0]), {"description": tags.get(270, "")}
        if subimage:
            raise Unreadable(f"no image {subimage}")
        if name == "png":
            w, h, _, color = struct.unpack(">IIBB", b[16:26])
            kinds = [k for k, _ in _png_chunks(b)]
            text = {k.decode("latin-1"): v.decode("latin-1") for kind, body in _png_chunks(b) if kind == b"tEXt" for k, _, v in [body.partition(b"\0")]}
            return w, h, names_of({0: 1, 2: 3, 3: 4 if b"tRNS" in kinds else 3, 4: 2, 6: 4}[color]), text
        if name == "dpx":
            w, h = struct.unpack((">" if b[:4] == b"SDPX" else "<") + "II", b[772:780])
            return w, h, names_of({6: 1, 50: 3, 51: 4}.get(b[800], 3)), {"creator": b[160:260].split(b"\0")[0].decode("latin-1")}
        if name == "hdr":
            head, _, rest = b[:65536].partition(b"\n\n")
            part = rest.partition(b"\n")[0].split()
            return int(part[3]), int(part[1]), names_of(3), _hdr_attributes(head)
        if name in ("pnm", "pfm"):
            kind, w, h = _pnm_fields(b)[0][:3]
            return int(w), int(h), names_of(_PNM[kind]), {}
        if name == "jpeg":
            w, h = jpeg.size_of(b)
            return w, h, names_of(jpeg.components(b)), {}
        if name in ("psd", "dds"):
            return textures.describe(b, name)
        if name in _FOREIGN:
            return _foreign(b, name)
    except (IndexError, KeyError, struct.error, ValueError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable(f"broken {name} header: {e}") from e
    raise Unreadable(name or "unknown format")


#: Formats that are told by their headers only, with their usual channels (vendor raw is one mosaic).
_FOREIGN = {"webp": 3, "jp2": 3, "heif": 3, "arriraw": 1, "redcode": 1}


def _foreign(b: bytes, name: str) -> tuple[int, int, list[str], dict[str, str]]:
    """Size and model from the headers of formats that aren't decoded here."""
    model = {}
    if name == "webp":
        kind = b[12:16]
        if len(b) < 25 or (kind != b"VP8L" and len(b) < 30):
            raise Unreadable("broken webp header")
        if kind == b"VP8X":
            w, h = (1 + int.from_bytes(b[i : i + 3], "little") for i in (24, 27))
        elif kind == b"VP8L":
            bits = int.from_bytes(b[21:25], "little")
            w, h = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        else:
            w, h = (v & 0x3FFF for v in struct.unpack("<HH", b[26:30]))
    elif name == "jp2":
        at = b.index(b"ihdr") + 4
        h, w = struct.unpack(">II", b[at : at + 8])
    elif name == "heif":
        at = b.index(b"ispe") + 8  # behind the version and flags
        w, h = struct.unpack(">II", b[at : at + 8])
    else:
        (w, h), at = (struct.unpack("<II", b[32:40]), 128) if name == "arriraw" else (struct.unpack(">II", b[8:16]), 64)
        model = {"camera": b[at : at + 32].split(b"\0")[0].decode("latin-1")}
    if not 0 < w < 1 << 20 or not 0 < h < 1 << 20:
        raise Unreadable(f"{name} header of {w} by {h} pixels")
    return w, h, names_of(_FOREIGN[name]), model


def size_of(b: bytes) -> tuple[int, int]:
    """(width, height) from the header alone."""
    return describe(b)[:2]


def encode(p: Picture, name: str, bits: int | None = None) -> bytes:
    if name == "png":
        return write_png(p, bits or 8)
    if name in ("ppm", "pgm", "pnm"):
        return write_pnm(p, bits or 8)
    if name == "pfm":
        return write_pfm(p)
    if name == "hdr":
        return write_hdr(p)
    if name == "dpx":
        return write_dpx(p, bits or 10)
    if name in ("tif", "tiff"):
        return write_tiff(p, bits or 16)
    if name == "exr":
        return exr.write(p)
    if name in ("jpg", "jpeg"):
        return jpeg.write(p)
    if name == "dds":
        return textures.write_dds(p)
    raise Unreadable(name)


def holds(name: str, channel: str) -> bool:
    """Whether files of a format can hold a channel."""
    if name == "exr":
        return True
    return channel in ("r", "g", "b", "y") or (channel == "a" and name in ("png", "dpx", "tif", "tiff", "dds"))
