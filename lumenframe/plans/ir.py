"""A small logical plan of colour transforms, its optimiser, and its compilation to projections or SQL.

A chain is a list of transforms. `optimized` drops identities, multiplies
neighbouring matrices, cancels inverse pairs and merges exponents. `compiled`
turns a chain into per-pixel operations, which become one stack of projections
that Catalyst collapses, or one SQL query.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from ..functions import aces2, color, curves, icc
from ..functions.expr import Op, ex, greatest, ln, power
from ..functions.lut import Lut1D, Lut3D
from ..functions.transfer import CURVES, log_camera, moncurve, pq
from ..operators.image import Img


@dataclass(frozen=True, eq=False)
class Matrix:
    m: np.ndarray
    offset: tuple = (0.0, 0.0, 0.0)

    def inverse(self) -> Matrix:
        inverse = np.linalg.inv(self.m)
        return Matrix(inverse, tuple(-inverse @ np.asarray(self.offset)))

    def identity(self) -> bool:
        return bool(np.allclose(self.m, np.eye(3), atol=1e-12) and np.allclose(self.offset, 0, atol=1e-12))

    def op(self) -> Op:
        return color.matrixed(self.m, self.offset)


@dataclass(frozen=True)
class Curve:
    """A named transfer function; `decode` goes to light."""

    name: str
    decode: bool = True

    def inverse(self) -> Curve:
        return replace(self, decode=not self.decode)

    def identity(self) -> bool:
        return False

    def op(self) -> Op:
        return color.each(CURVES[self.name][self.decode])


@dataclass(frozen=True)
class Exponent:
    power: tuple
    negative: str = "clamp"

    def inverse(self) -> Exponent:
        return replace(self, power=tuple(1 / p for p in self.power))

    def identity(self) -> bool:
        return all(abs(p - 1) < 1e-12 for p in self.power) and self.negative != "clamp"

    def op(self) -> Op:
        return color.exponent(self.power, self.negative)


@dataclass(frozen=True)
class Cdl:
    slope: tuple = (1.0, 1.0, 1.0)
    offset: tuple = (0.0, 0.0, 0.0)
    power: tuple = (1.0, 1.0, 1.0)
    saturation: float = 1.0
    style: str = "noclamp"
    backward: bool = False

    def inverse(self) -> Cdl:
        return replace(self, backward=not self.backward)

    def identity(self) -> bool:
        return self.style == "noclamp" and (self.slope, self.offset, self.power, self.saturation) == ((1.0,) * 3, (0.0,) * 3, (1.0,) * 3, 1.0)

    def op(self) -> Op:
        if not self.backward:
            return color.cdl(self.slope, self.offset, self.power, self.saturation, self.style)
        from ..functions.expr import ex, greatest, luma, power, when

        y = {"y0": luma(*color.RGB)}
        p = {f"p_{c}": ex("y0") + (ex(c) - "y0") / self.saturation for c in color.RGB}
        out = {}
        for c, s, o, w in zip(color.RGB, self.slope, self.offset, self.power, strict=True):
            x = ex(f"p_{c}")
            out[c] = (when((x < 0.0, x), power(greatest(x, 0.0), 1 / w)) - float(o)) / float(s)
        return Op({**out, "a": "a"}, y, p)


@dataclass(frozen=True)
class Range:
    low_in: float
    high_in: float
    low_out: float
    high_out: float
    clamp: bool = True

    def inverse(self) -> Range:
        return Range(self.low_out, self.high_out, self.low_in, self.high_in, self.clamp)

    def identity(self) -> bool:
        return not self.clamp and (self.low_in, self.high_in) == (self.low_out, self.high_out)

    def op(self) -> Op:
        return color.ranged(self.low_in, self.high_in, self.low_out, self.high_out, self.clamp)


@dataclass(frozen=True)
class LogAffine:
    base: float = 2.0
    log_slope: float = 1.0
    log_offset: float = 0.0
    lin_slope: float = 1.0
    lin_offset: float = 0.0
    backward: bool = False

    def inverse(self) -> LogAffine:
        return replace(self, backward=not self.backward)

    def identity(self) -> bool:
        return False

    def op(self) -> Op:
        return color.log_affine(self.base, self.log_slope, self.log_offset, self.lin_slope, self.lin_offset, self.backward)


@dataclass(frozen=True)
class ExposureContrast:
    style: str = "linear"
    exposure: float = 0.0
    contrast: float = 1.0
    gamma: float = 1.0
    pivot: float = 0.18

    def inverse(self):
        k = max(0.001, self.contrast * self.gamma)
        if self.style == "log":
            # v k + (e - at) k + at with e stops of exposure: a line, and so its inverse.
            at = max(0.0, np.log2(max(self.pivot, 0.001) / 0.18) * 0.088 + 0.435)
            return Matrix(np.eye(3) / k, ((at - self.exposure * 0.088) - at / k,) * 3)
        e, p = 2.0**self.exposure, max(self.pivot, 0.001)
        if self.style == "video":
            e, p = e**0.5464481, p**0.5464481
        return Chain((Exponent((1 / k,) * 3), Matrix(np.eye(3) * p ** (1 - 1 / k) / e)))

    def identity(self) -> bool:
        return self.exposure == 0 and self.contrast * self.gamma == 1 and self.style == "linear"

    def op(self) -> Op:
        return color.exposure_contrast(self.style, self.exposure, self.contrast, self.gamma, self.pivot)


def _both(curve_pair) -> tuple:
    return (lambda: color.each(curve_pair[0])), (lambda: color.each(curve_pair[1]))


def _swapped(pair) -> tuple:
    return pair[1], pair[0]


#: Fixed functions by name: (forward, inverse).
FIXED = {
    "rgb_to_hsv": (color.rgb_to_hsv, color.hsv_to_rgb),
    "xyz_to_xyy": (color.xyz_to_xyy, color.xyy_to_xyz),
    "xyz_to_uvy": (color.xyz_to_uvy, color.uvy_to_xyz),
    "xyz_to_luv": (color.xyz_to_luv, color.luv_to_xyz),
    **{f"rgb_to_hsy_{v}": (lambda v=v: color.rgb_to_hsy(v), lambda v=v: color.hsy_to_rgb(v)) for v in ("lin", "log", "vid")},
    "aces_gamut_comp_13": (color.gamut_compressed, lambda: color.gamut_compressed(True)),
    "aces_glow_10": (color.glowed, lambda: color.glowed(inverse=True)),
    "aces_glow_03": (lambda: color.glowed(0.075, 0.1), lambda: color.glowed(0.075, 0.1, True)),
    "aces_red_mod_10": (color.red_modified, lambda: color.red_modified(inverse=True)),
    "aces_red_mod_03": (lambda: color.red_modified("0.3"), lambda: color.red_modified("0.3", True)),
    "aces_dark_to_dim_10": (color.surround, lambda: color.surround(1 / color.DIM_GAMMA)),
    "lin_to_pq": _both(pq(100.0)),
    "aces_rgb_to_jmh_20": (aces2.rgb_to_jmh, aces2.jmh_to_rgb),
}
for _name, _back in (("hsv_to_rgb", "rgb_to_hsv"), ("xyy_to_xyz", "xyz_to_xyy"), ("uvy_to_xyz", "xyz_to_uvy"), ("luv_to_xyz", "xyz_to_luv"), ("pq_to_lin", "lin_to_pq"),
                     ("hsy_lin_to_rgb", "rgb_to_hsy_lin"), ("hsy_log_to_rgb", "rgb_to_hsy_log"), ("hsy_vid_to_rgb", "rgb_to_hsy_vid"), ("aces_jmh_to_rgb_20", "aces_rgb_to_jmh_20")):
    FIXED[_name] = _swapped(FIXED[_back])


def fixed(style: str) -> str:
    """The name of a fixed function as FIXED has it; unknown ones are refused."""
    wanted = style.lower().replace("_", "")
    for name in FIXED:
        if name.replace("_", "") == wanted:
            return name
    raise KeyError(style)


def _channels(curve) -> Op:
    """`curve(i, value)` on each channel."""
    return Op({**{c: curve(i, ex(c)) for i, c in enumerate(color.RGB)}, "a": "a"})


def _three(v) -> tuple:
    return tuple(map(float, v)) if isinstance(v, list | tuple) else (float(v),) * 3


def _log_affine(base, log_slope, log_offset, lin_slope, lin_offset, back: bool) -> Op:
    ls, lo, ns, no = map(_three, (log_slope, log_offset, lin_slope, lin_offset))
    if back:
        return _channels(lambda i, v: (power(float(base), (v - lo[i]) / ls[i]) - no[i]) / ns[i])
    return _channels(lambda i, v: ln(greatest(v * ns[i] + no[i], 1.1754943508222875e-38)) * (ls[i] / float(np.log(base))) + lo[i])


def _log_camera(base, log_slope, log_offset, lin_slope, lin_offset, lin_break, back: bool) -> Op:
    p = list(map(_three, (log_slope, log_offset, lin_slope, lin_offset, lin_break)))
    return _channels(lambda i, v: log_camera(float(base), *(q[i] for q in p))[back](v))


def _with_line(gamma, offset, mirror: bool, back: bool) -> Op:
    """A power with a straight toe: forward to light. Pure powers have none."""
    g, o = _three(gamma), _three(offset)

    def one(i, v):
        if o[i] == 0:
            return power(greatest(v, 0.0), 1 / g[i] if back else g[i])
        pair = moncurve(g[i], o[i])
        f = pair[not back]
        from ..functions.transfer import mirrored

        return (mirrored(f) if mirror else f)(v)

    return _channels(one)


#: Transforms made of an operation with parameters and a direction.
MAKERS = {
    "log_affine": _log_affine,
    "log_camera": _log_camera,
    "exponent_with_linear": _with_line,
    "allocation": lambda kind, low, high, offset, back: color.allocation(kind, low, high, offset, back),
    "primary": lambda kw, back: color.basic_primary(**dict(kw), inverse=back),
    "styled_primary": lambda style, kw, back: color.grading_primary(style, **dict(kw), inverse=back),
    "basic_tone": lambda kw, back: _basic_tone(dict(kw), back),
    "tone_zones": lambda style, kw, back: curves.tone(style, **dict(kw), inverse=back),
    "rgb_curves": lambda kw, back: curves.rgb_curves(**dict(kw), inverse=back),
    "hue_curves": lambda style, kw, back: curves.hue_curves(style, back, **dict(kw)),
    "power_of": lambda base, back: color.each((lambda v: ln(greatest(v, 1.1754943508222875e-38)) / float(np.log(base))) if back else (lambda v: power(float(base), v))),
    "line": lambda points, slope, back: color.each(curves.line_through(points, slope, back)),
    "tone": lambda preset, back: _tone_mapped(preset, back),
    "matrix4": lambda m, offset, back: _matrix4(np.array(m), np.array(offset), back),
    "logs": lambda kind, p, back: _logs(kind, p, back),
    "icc_curves": lambda found, back: icc.curves_op(found, back),
    "surround": lambda gamma, back: color.surround(1 / gamma if back else gamma),
}


def _logs(kind: str, p: tuple, back: bool) -> Op:
    """The curve of a power and a logarithm, or of two logarithms, with the parameters of a configuration (none: the defaults)."""
    if kind == "gamma":
        names = ("mirror", "break_point", "gamma_power", "gamma_slope", "gamma_offset", "base", "log_slope", "log_offset", "lin_slope", "lin_offset")
        return color.each(curves.gamma_log(**dict(zip(names, p, strict=False)), inverse=back))
    given = {"base": p[0], "break1": p[1], "break2": p[2], "log1": p[3:7], "log2": p[7:11], "lin": p[11:13]} if len(p) == 13 else {}
    return color.each(curves.double_log(**given, inverse=back))


def _basic_tone(kw: dict, back: bool) -> Op:
    if back:
        raise ValueError("tone zones by luma have no inverse")
    return color.basic_tone(**kw)


def _tone_mapped(preset: str, back: bool) -> Op:
    if back:
        raise ValueError("a clamped tone curve has no inverse")
    return color.tone_mapped(preset)


def _matrix4(m: np.ndarray, offset: np.ndarray, back: bool) -> Op:
    """A 4 x 4 matrix and an offset on column vectors (r, g, b, a)."""
    if back:
        m = np.linalg.inv(m)
        offset = -m @ offset
    from ..functions.expr import dot

    names = (*color.RGB, "a")
    return Op({c: dot(m[i], names) + float(offset[i]) for i, c in enumerate(names)})


@dataclass(frozen=True)
class Made:
    """An operation of MAKERS with its parameters."""

    kind: str
    values: tuple = ()
    backward: bool = False

    def inverse(self) -> Made:
        return replace(self, backward=not self.backward)

    def identity(self) -> bool:
        return False

    def op(self) -> Op:
        return MAKERS[self.kind](*self.values, self.backward)


@dataclass(frozen=True, eq=False)
class Ready:
    """An operation as a transform, without a way back unless one is given."""

    made: Op
    back: Op | None = None

    def inverse(self) -> Ready:
        if self.back is None:
            raise ValueError("this rendering has no inverse here")
        return Ready(self.back, self.made)

    def identity(self) -> bool:
        return False

    def op(self) -> Op:
        return self.made


@dataclass(frozen=True)
class Fixed:
    name: str
    forward: bool = True

    def inverse(self) -> Fixed:
        return replace(self, forward=not self.forward)

    def identity(self) -> bool:
        return False

    def op(self) -> Op:
        return FIXED[self.name][not self.forward]()


@dataclass(frozen=True, eq=False)
class Table:
    """A look-up table."""

    lut: Lut1D | Lut3D
    method: str = "trilinear"

    def inverse(self) -> Table:
        return Table(self.lut.inverse(), self.method)

    def identity(self) -> bool:
        return False

    def op(self) -> Op:
        return self.lut.op() if isinstance(self.lut, Lut1D) else self.lut.op(self.method)


@dataclass(frozen=True)
class Chain:
    """Transforms one after another."""

    parts: tuple = field(default_factory=tuple)

    def inverse(self) -> Chain:
        return Chain(tuple(p.inverse() for p in reversed(self.parts)))

    def identity(self) -> bool:
        return all(p.identity() for p in self.parts)


def flat(transforms) -> list:
    out = []
    for t in transforms:
        out += flat(t.parts) if hasattr(t, "parts") else [t]
    return out


def _cancels(a, b) -> bool:
    if isinstance(a, Curve) and isinstance(b, Curve):
        return a == b.inverse()
    if isinstance(a, Made) and isinstance(b, Made):
        # Clamped or rounded operations aren't undone exactly.
        return a.kind in ("log_affine", "log_camera", "matrix4", "rgb_curves", "tone_zones") and a == b.inverse()
    return isinstance(a, Fixed) and isinstance(b, Fixed) and a == b.inverse()


def optimized(transforms) -> list:
    """The same chain with less in it."""
    out: list = []
    for t in flat(transforms):
        if t.identity():
            continue
        last = out[-1] if out else None
        if isinstance(t, Matrix) and isinstance(last, Matrix):
            out[-1] = Matrix(t.m @ last.m, tuple(t.m @ np.asarray(last.offset) + np.asarray(t.offset)))
        elif isinstance(t, Exponent) and isinstance(last, Exponent) and t.negative == last.negative:
            out[-1] = Exponent(tuple(a * b for a, b in zip(last.power, t.power, strict=True)), t.negative)
        elif last is not None and _cancels(last, t):
            out.pop()
        else:
            out.append(t)
            continue
        if out and out[-1].identity():
            out.pop()
    return out


def compiled(transforms, optimize: bool = True) -> list[Op]:
    return [t.op() for t in (optimized(transforms) if optimize else flat(transforms))]


def applied(img: Img, transforms) -> Img:
    for op in compiled(transforms):
        img = img.apply(op)
    return img


def as_sql(source: str, transforms, keys: list[str]) -> str:
    for op in compiled(transforms):
        source = op.sql(source, keys)
    return source


def baked(spark, transforms, size: int = 33, cube: bool = True):
    """A chain as a table: a cube of `size` steps a side, or a curve of `size` points for each channel.

    The table is worked out on the executors; its size**3 (or size) rows come to the driver, where tables live.
    """
    from pyspark.sql import functions as F

    n = size**3 if cube else size
    at = spark.range(n).select("id")
    step = lambda k: (F.floor(F.col("id") / size**k) % size).cast("double") / (size - 1)
    places = (step(2), step(1), step(0)) if cube else (step(0),) * 3
    df = at.select("id", *[p.alias(c) for c, p in zip(color.RGB, places, strict=True)], F.lit(1.0).alias("a"))
    for op in compiled(transforms):
        df = op.frame(df, ["id"])
    rows = df.orderBy("id").select(*color.RGB).toPandas().to_numpy()
    return Lut3D(rows.reshape(size, size, size, 3)) if cube else Lut1D(rows)
