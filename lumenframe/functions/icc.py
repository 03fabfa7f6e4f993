"""ICC profiles of RGB spaces made of a matrix and curves: read, written, and turned into chains of transforms.

A profile says how its colours become XYZ under D50. Profiles of look-up tables (A2B, B2A) or of
other colour models are refused.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from . import gamut
from .expr import Ex, Op, ex, greatest, power, when

RGB = ("r", "g", "b")
#: The white of the connection space, as profiles write it. Fixed values.
D50 = (0.9642, 1.0, 0.8249)
INTENTS = ("perceptual", "relative", "saturation", "absolute")
#: Parameters of the sRGB curve as a parametric one: gamma, a, b, c, d. Fixed values.
SRGB = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)


class BadProfile(ValueError):
    """Bytes that aren't a profile that is understood here."""


@dataclass(frozen=True)
class Curve:
    """``(a x + b)**g + e`` from `d` up, ``c x + f`` below; or a table over [0, 1]."""

    g: float = 1.0
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 0.0
    f: float = 0.0
    table: tuple = ()

    def forward(self, v) -> Ex:
        v = ex(v)
        return when((v < self.d, v * self.c + self.f), power(greatest(v * self.a + self.b, 0.0), self.g) + self.e)

    def inverse(self, v) -> Ex:
        v, edge = ex(v), max(self.a * self.d + self.b, 0.0) ** self.g + self.e
        below = (v - self.f) / self.c if self.c else ex(self.d)
        return when((v < edge, below), (power(greatest(v - self.e, 0.0), 1 / self.g) - self.b) / self.a)

    def at(self, x: np.ndarray) -> np.ndarray:
        """The curve's values on the driver."""
        if self.table:
            return np.interp(x, np.linspace(0, 1, len(self.table)), self.table)
        return np.where(x < self.d, x * self.c + self.f, np.maximum(x * self.a + self.b, 0) ** self.g + self.e)


@dataclass
class Profile:
    """`matrix` takes linear light to XYZ under D50; `adaptation` took the space's own white there."""

    matrix: np.ndarray
    curves: tuple[Curve, Curve, Curve]
    adaptation: np.ndarray = field(default_factory=lambda: np.eye(3))
    description: str = ""
    kind: str = "mntr"

    def absolute(self) -> np.ndarray:
        return np.linalg.inv(self.adaptation) @ self.matrix


def named(name: str, curve: Curve | None = None) -> Profile:
    """The profile of a known gamut, linear unless a curve is given."""
    white = gamut.GAMUTS[name][3]
    adapted = gamut.adaptation(white, "D50") if white != "D50" else np.eye(3)
    return Profile(adapted @ gamut.rgb_to_xyz(name), (curve or Curve(),) * 3, adapted, name)


def srgb() -> Profile:
    return named("srgb", Curve(*SRGB))


def _fixed(b: bytes) -> list[float]:
    return [v / 65536 for v in struct.unpack(f">{len(b) // 4}i", b)]


#: How many parameters a parametric curve of each kind has. Fixed values.
_PARAMETERS = (1, 3, 4, 5, 7)


def _curve(b: bytes) -> Curve:
    if b[:4] == b"curv":
        (n,) = struct.unpack(">I", b[8:12])
        if n == 0:
            return Curve()
        values = struct.unpack(f">{n}H", b[12 : 12 + 2 * n])
        return Curve(g=values[0] / 256) if n == 1 else Curve(table=tuple(v / 65535 for v in values))
    if b[:4] == b"para":
        (kind,) = struct.unpack(">H", b[8:10])
        if kind >= len(_PARAMETERS):
            raise BadProfile(f"parametric curve of kind {kind}")
        p = _fixed(b[12 : 12 + 4 * _PARAMETERS[kind]])
        if kind == 0:
            return Curve(p[0])
        if kind == 1:
            return Curve(p[0], p[1], p[2], 0.0, -p[2] / p[1])
        if kind == 2:
            return Curve(p[0], p[1], p[2], 0.0, -p[2] / p[1], p[3], p[3])
        return Curve(*p)
    raise BadProfile(f"curve of type {b[:4]!r}")


def read(b: bytes) -> Profile:
    try:
        if b[36:40] != b"acsp":
            raise BadProfile("not a profile")
        if b[16:20] != b"RGB " or b[20:24] != b"XYZ ":
            raise BadProfile(f"a profile from {b[16:20]!r} to {b[20:24]!r}")
        (count,) = struct.unpack(">I", b[128:132])
        tags = {}
        for i in range(count):
            name, at, size = struct.unpack(">4sII", b[132 + 12 * i : 144 + 12 * i])
            tags[name] = b[at : at + size]
        columns = [_fixed(tags[t][8:20]) for t in (b"rXYZ", b"gXYZ", b"bXYZ")]
        curves = tuple(_curve(tags[t]) for t in (b"rTRC", b"gTRC", b"bTRC"))
        adapted = np.array(_fixed(tags[b"chad"][8:44])).reshape(3, 3) if b"chad" in tags else np.eye(3)
        text = tags.get(b"desc", b"")
        if text[:4] == b"mluc":
            size, at = struct.unpack(">II", text[20:28])
            description = text[at : at + size].decode("utf-16-be")
        else:
            description = text[12 : 12 + struct.unpack(">I", text[8:12])[0] - 1].decode("latin-1") if len(text) > 12 else ""
        return Profile(np.array(columns).T, curves, adapted, description, b[12:16].decode("latin-1"))
    except (KeyError, struct.error, IndexError, UnicodeDecodeError, ZeroDivisionError) as e:
        raise BadProfile(f"broken profile: {type(e).__name__} {e}") from e


def write(p: Profile) -> bytes:
    fixed = lambda values: struct.pack(f">{len(values)}i", *(round(float(v) * 65536) for v in values))
    xyz = lambda v: b"XYZ \0\0\0\0" + fixed(v)

    def curve(c: Curve) -> bytes:
        if c.table:
            return b"curv\0\0\0\0" + struct.pack(f">I{len(c.table)}H", len(c.table), *(round(v * 65535) for v in c.table))
        return b"para\0\0\0\0" + struct.pack(">HH", 4, 0) + fixed((c.g, c.a, c.b, c.c, c.d, c.e, c.f))

    text = p.description.encode("utf-16-be")
    tags = {
        b"desc": b"mluc\0\0\0\0" + struct.pack(">II4sII", 1, 12, b"enUS", len(text), 28) + text, b"wtpt": xyz(D50), b"chad": b"sf32\0\0\0\0" + fixed(p.adaptation.ravel()),
        **{t: xyz(p.matrix[:, i]) for i, t in enumerate((b"rXYZ", b"gXYZ", b"bXYZ"))}, **{t: curve(c) for t, c in zip((b"rTRC", b"gTRC", b"bTRC"), p.curves, strict=True)},
    }
    at, table, body = 132 + 12 * len(tags), b"", b""
    for name, data in tags.items():
        table += struct.pack(">4sII", name, at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    size = at + len(body)
    head = struct.pack(">I4sI4s4s4s", size, b"\0\0\0\0", 0x04300000, p.kind.encode()[:4], b"RGB ", b"XYZ ") + bytes(12) + b"acsp" + bytes(28)
    return head + fixed(D50) + bytes(128 - len(head) - 12) + struct.pack(">I", len(tags)) + table + body


def curves_op(curves: tuple, back: bool) -> Op:
    return Op({**{c: (k.inverse if back else k.forward)(c) for c, k in zip(RGB, curves, strict=True)}, "a": "a"})


def conversion(source: Profile, target: Profile, intent: str = "perceptual") -> list:
    """From one profile's colours to another's. Profiles of a matrix have one rendering for all intents but the absolute one, which keeps whites apart."""
    from ..plans import ir
    from .lut import Lut1D

    if intent not in INTENTS:
        raise ValueError(f"unknown intent {intent}")

    def shaped(p: Profile, back: bool) -> list:
        if not any(c.table for c in p.curves):
            return [ir.Made("icc_curves", (p.curves,), back)]
        n = max(len(c.table) or 1024 for c in p.curves)
        x = np.linspace(0, 1, n)
        table = Lut1D(np.stack([c.at(x) for c in p.curves], axis=1))
        return [ir.Table(table.inverse(4 * n) if back else table)]

    one, other = (p.absolute() if intent == "absolute" else p.matrix for p in (source, target))
    return [*shaped(source, False), ir.Matrix(np.linalg.inv(other) @ one), *shaped(target, True)]
