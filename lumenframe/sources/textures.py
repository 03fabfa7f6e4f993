"""Photoshop files (their merged image) and DDS textures (plain, BC1, BC2, BC3)."""

from __future__ import annotations

import struct

import numpy as np

from .picture import Picture, Unreadable, from_int, named, names_of


def unpackbits(b: bytes) -> bytes:
    """Runs: a count below 128 and as many bytes and one, or above and one byte to repeat."""
    out, i = bytearray(), 0
    while i < len(b):
        n = b[i]
        if n < 128:
            out += b[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += b[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


# Photoshop


def _psd(b: bytes) -> tuple[int, int, int, int, int]:
    """(channels, height, width, bits, mode)."""
    version, n, h, w, bits, mode = struct.unpack(">H6xHIIHH", b[4:26])
    if version != 1 or mode not in (1, 3) or bits not in (8, 16):
        raise Unreadable(f"PSD of version {version}, mode {mode}, {bits} bits")
    return n, h, w, bits, mode


def read_psd(b: bytes) -> Picture:
    n, h, w, bits, mode = _psd(b)
    at = 26
    for _ in range(3):  # colour mode, resources, layers
        (size,) = struct.unpack(">I", b[at : at + 4])
        at += 4 + size
    (pressed,) = struct.unpack(">H", b[at : at + 2])
    at += 2
    line = w * bits // 8
    if pressed == 0:
        raw = b[at : at + n * h * line]
    elif pressed == 1:
        sizes = struct.unpack(f">{n * h}H", b[at : at + 2 * n * h])
        at, rows = at + 2 * n * h, []
        for size in sizes:
            rows.append(unpackbits(b[at : at + size])[:line])
            at += size
        raw = b"".join(rows)
    else:
        raise Unreadable(f"PSD compression {pressed}")
    planes = np.frombuffer(raw, ">u2" if bits == 16 else np.uint8, n * h * w).reshape(n, h, w)
    used = min(n, 2 if mode == 1 else 4)
    data = np.moveaxis(planes[:used], 0, -1).astype(f"u{bits // 8}")
    return Picture(named(from_int(data)), {}, "psd")


def write_psd(p: Picture, runs: bool = False) -> bytes:
    """The merged image alone, 8 bits."""
    planes = [(np.clip(np.nan_to_num(v), 0, 1) * 255).astype(np.uint8) for v in p.channels.values()]
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, len(planes), p.height, p.width, 8, 1 if len(planes) < 3 else 3) + bytes(12)
    if not runs:
        return head + b"\0\0" + b"".join(v.tobytes() for v in planes)
    rows = [b"".join(bytes([len(r[i : i + 128]) - 1]) + r[i : i + 128] for i in range(0, len(r), 128)) for v in planes for r in map(bytes, v)]
    return head + b"\0\1" + struct.pack(f">{len(rows)}H", *map(len, rows)) + b"".join(rows)


# DDS


def _dds(b: bytes) -> tuple[int, int, bytes, int, tuple]:
    """(width, height, code, bits, masks)."""
    h, w = struct.unpack("<II", b[12:20])
    flags, code, bits, *masks = struct.unpack("<I4sIIIII", b[80:108])
    return w, h, code if flags & 4 else b"", bits, tuple(masks)


def _colours(c: np.ndarray) -> np.ndarray:
    """5-6-5 bits as bytes."""
    r, g, b = c >> 11 & 31, c >> 5 & 63, c & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], axis=-1).astype(np.int64)


def _bc1(blocks: np.ndarray, opaque: bool) -> np.ndarray:
    """(n, 16, 4) bytes of (n, 8) blocks: two colours, two more between them, two bits a pixel."""
    c0, c1 = (blocks[:, i].astype(np.int64) | blocks[:, i + 1].astype(np.int64) << 8 for i in (0, 2))
    a, b = _colours(c0), _colours(c1)
    four = (c0 > c1)[:, None] | opaque
    third = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    fourth = np.where(four, (a + 2 * b) // 3, 0)
    palette = np.stack([a, b, third, fourth], axis=1)
    alpha = np.full((len(blocks), 4), 255)
    alpha[:, 3] = np.where(four[:, 0], 255, 0)
    bits = (blocks[:, 4:8, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1, 16)
    at = np.arange(len(blocks))[:, None]
    return np.concatenate([palette[at, bits], alpha[at, bits][..., None]], axis=-1)


def _bc3_alpha(blocks: np.ndarray) -> np.ndarray:
    """(n, 16) bytes of (n, 8) blocks: two values, six or four more between them, three bits a pixel."""
    a, b = blocks[:, 0].astype(np.int64), blocks[:, 1].astype(np.int64)
    seven = np.stack([a, b, *(((7 - i) * a + i * b) // 7 for i in range(1, 7))], axis=1)
    five = np.stack([a, b, *(((5 - i) * a + i * b) // 5 for i in range(1, 5)), a * 0, a * 0 + 255], axis=1)
    values = np.where((a > b)[:, None], seven, five)
    bits = np.unpackbits(blocks[:, 2:8], axis=1, bitorder="little").reshape(-1, 16, 3)
    return values[np.arange(len(blocks))[:, None], (bits * [1, 2, 4]).sum(axis=2)]


def read_dds(b: bytes) -> Picture:
    w, h, code, bits, masks = _dds(b)
    if code in (b"DXT1", b"DXT3", b"DXT5"):
        wide, high, size = -(-w // 4), -(-h // 4), 8 if code == b"DXT1" else 16
        blocks = np.frombuffer(b, np.uint8, wide * high * size, 128).reshape(-1, size)
        out = _bc1(blocks[:, size - 8 :], code != b"DXT1")
        if code == b"DXT3":
            out[..., 3] = np.stack([blocks[:, :8] & 15, blocks[:, :8] >> 4], axis=-1).reshape(-1, 16) * 17
        elif code == b"DXT5":
            out[..., 3] = _bc3_alpha(blocks[:, :8])
        data = out.reshape(high, wide, 4, 4, 4).swapaxes(1, 2).reshape(high * 4, wide * 4, 4)[:h, :w].astype(np.uint8)
    elif not code and bits in (24, 32):
        step = bits // 8
        raw = np.frombuffer(b, np.uint8, w * h * step, 128).reshape(h, w, step).astype(np.uint64)
        words = sum(raw[..., i] << np.uint64(8 * i) for i in range(step))
        used = [m for m in masks if m]
        data = np.stack([((words & np.uint64(m)) >> np.uint64((m & -m).bit_length() - 1)) for m in used], axis=-1).astype(np.uint8)
    else:
        raise Unreadable(f"DDS of kind {code!r}, {bits} bits")
    return Picture(named(from_int(data)), {}, "dds")


def write_dds(p: Picture) -> bytes:
    """Plain, 8 bits a channel, the first byte red."""
    planes = [p.channels.get(c, np.ones((p.height, p.width), np.float32)) for c in "rgba"]
    body = (np.clip(np.nan_to_num(np.stack(planes, axis=-1)), 0, 1) * 255).astype(np.uint8).tobytes()
    head = struct.pack("<4sIIIIIII44x", b"DDS ", 124, 0x100F, p.height, p.width, 4 * p.width, 0, 1)
    form = struct.pack("<IIIIIIII", 32, 0x41, 0, 32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000)
    return head + form + struct.pack("<I16x", 0x1000) + body


def describe(b: bytes, name: str) -> tuple[int, int, list[str], dict[str, str]]:
    if name == "psd":
        n, h, w, _, mode = _psd(b)
        return w, h, names_of(min(n, 2 if mode == 1 else 4)), {}
    w, h, code, _, masks = _dds(b)
    return w, h, names_of(4 if code else sum(m > 0 for m in masks)), {"code": code.decode("latin-1")}
