"""Transfer functions between scene light and code values.

Every curve is a pair (encode, decode) of functions from expression to
expression. The numbers are the published constants of each curve. Fixed values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from .expr import Ex, absolute, clamp, ex, exp, floor, greatest, ln, log2, log10, power, sqrt, when

Curve = Callable[[object], Ex]
CURVES: dict[str, tuple[Curve, Curve]] = {}


def _curve(name: str, encode: Curve, decode: Curve) -> None:
    CURVES[name] = (encode, decode)


def _safe(x) -> Ex:
    """An argument of a logarithm, kept positive where its branch isn't taken."""
    return greatest(x, 1e-300)


def mirrored(f: Curve) -> Curve:
    """`f` of the magnitude, with the sign of the argument."""

    def both(x):
        x = ex(x)
        return when((x >= 0.0, f(absolute(x))), -f(absolute(x)))

    return both


def _rational_power(x, p: float) -> Ex:
    return power(greatest(x, 0.0), p)


_curve(
    "srgb",
    lambda v: when((ex(v) <= 0.0031308, ex(v) * 12.92), _rational_power(v, 1 / 2.4) * 1.055 - 0.055),
    lambda v: when((ex(v) <= 0.04045, ex(v) / 12.92), _rational_power((ex(v) + 0.055) / 1.055, 2.4)),
)
_curve(
    "rec709",
    lambda v: when((ex(v) < 0.018, ex(v) * 4.5), _rational_power(v, 0.45) * 1.099 - 0.099),
    lambda v: when((ex(v) < 0.081, ex(v) / 4.5), _rational_power((ex(v) + 0.099) / 1.099, 1 / 0.45)),
)


def gamma(g: float) -> tuple[Curve, Curve]:
    """A pure power; nothing below zero."""
    return (
        lambda v: when((ex(v) <= 0.0, 0.0), _rational_power(v, 1 / g)),
        lambda v: when((ex(v) <= 0.0, 0.0), _rational_power(v, g)),
    )


for _name, _g in (("gamma22", 2.2), ("gamma24", 2.4), ("gamma26", 2.6)):
    _curve(_name, *gamma(_g))


def moncurve(g: float, offset: float) -> tuple[Curve, Curve]:
    """A power with offset whose toe is the straight line through zero that touches it."""
    g, offset = max(g, 1 + 1e-6), max(offset, 1e-6)
    knee = offset / (g - 1)
    slope = (g - 1) / offset * (offset * g / ((g - 1) * (1 + offset))) ** g

    def decode(v):
        return when((ex(v) <= 0.0, 0.0), (ex(v) <= knee, ex(v) * slope), _rational_power((ex(v) + offset) / (1 + offset), g))

    def encode(v):
        return when((ex(v) <= 0.0, 0.0), (ex(v) <= knee * slope, ex(v) / slope), _rational_power(v, 1 / g) * (1 + offset) - offset)

    return encode, decode


_curve("moncurve", *moncurve(2.4, 0.055))
_curve("moncurve_mirror", *(mirrored(f) for f in moncurve(2.4, 0.055)))


def pq(peak: float) -> tuple[Curve, Curve]:
    """SMPTE ST 2084, with light in units of which `peak` are 10000 nits."""
    m1, m2 = 2610 / 16384, 2523 / 4096 * 128
    c1, c2, c3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32

    def encode(v):
        y = _rational_power(clamp(ex(v) / peak), m1)
        return when((ex(v) <= 0.0, 0.0), power((y * c2 + c1) / (y * c3 + 1.0), m2))

    def decode(v):
        p = _rational_power(v, 1 / m2)
        return when((ex(v) <= 0.0, 0.0), power(greatest(p - c1, 0.0) / (ex(c2) - p * c3), 1 / m1) * peak)

    return encode, decode


_curve("pq", *pq(10000.0))
_curve("pq_100", *pq(100.0))


def _hlg() -> tuple[Curve, Curve]:
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return (
        lambda v: when((ex(v) <= 0.0, 0.0), (ex(v) <= 1 / 12, sqrt(greatest(ex(v) * 3.0, 0.0))), ln(_safe(ex(v) * 12.0 - b)) * a + c),
        lambda v: when((ex(v) <= 0.0, 0.0), (ex(v) <= 0.5, ex(v) * ex(v) / 3.0), (exp((ex(v) - c) / a) + b) / 12.0),
    )


_curve("hlg", *_hlg())


def log_camera(base: float, log_slope: float, log_offset: float, lin_slope: float, lin_offset: float, lin_break: float) -> tuple[Curve, Curve]:
    """A logarithm above a break, below it the line that touches it there."""
    at = lin_slope * lin_break + lin_offset
    log_break = log_slope * math.log(at, base) + log_offset
    slope = log_slope * lin_slope / (at * math.log(base))
    scale = log_slope / math.log(base)
    return (
        lambda v: when((ex(v) >= lin_break, ln(_safe(ex(v) * lin_slope + lin_offset)) * scale + log_offset), (ex(v) - lin_break) * slope + log_break),
        lambda v: when((ex(v) >= log_break, (power(base, (ex(v) - log_offset) / log_slope) - lin_offset) / lin_slope), (ex(v) - log_break) / slope + lin_break),
    )


_curve("logc4", *log_camera(2.0, 0.0647954196341293, -0.295908392682586, 2231.82630906769, 64.0, -0.0180569961199113))
_curve("log3g10", *log_camera(10.0, 0.224282, 0.0, 155.975327, 0.01 * 155.975327 + 1.0, -0.01))
_curve("bmd_film5", *log_camera(math.e, 0.0869287606549122, 0.530013339229194, 1.0, 0.00549407243225781, 0.005))

_curve(
    "logc3",
    lambda v: when((ex(v) > 0.010591, log10(_safe(ex(v) * 5.555556 + 0.052272)) * 0.247190 + 0.385537), ex(v) * 5.367655 + 0.092809),
    lambda v: when(
        (ex(v) > 5.367655 * 0.010591 + 0.092809, (power(10.0, (ex(v) - 0.385537) / 0.247190) - 0.052272) / 5.555556),
        (ex(v) - 0.092809) / 5.367655,
    ),
)
_curve(
    "slog2",
    lambda v: when((ex(v) >= 0.0, (log10(_safe(ex(v) + 0.037584)) * 0.432699 + 0.616596 + 0.03) / 1.03), (ex(v) * 5.0 + 0.030001222) / 1.03),
    lambda v: when(
        (ex(v) >= 0.030001222 / 1.03, power(10.0, (ex(v) * 1.03 - 0.03 - 0.616596) / 0.432699) - 0.037584), (ex(v) * 1.03 - 0.030001222) / 5.0
    ),
)
_curve(
    "slog3",
    lambda v: when(
        (ex(v) >= 0.01125, (log10(_safe((ex(v) + 0.01) / 0.19)) * 261.5 + 420.0) / 1023.0),
        (ex(v) * (171.2102946929 - 95.0) / 0.01125 + 95.0) / 1023.0,
    ),
    lambda v: when(
        (ex(v) * 1023.0 >= 171.2102946929, power(10.0, (ex(v) * 1023.0 - 420.0) / 261.5) * 0.19 - 0.01),
        (ex(v) * 1023.0 - 95.0) * 0.01125 / (171.2102946929 - 95.0),
    ),
)
_curve(
    "vlog",
    lambda v: when((ex(v) < 0.01, ex(v) * 5.6 + 0.125), log10(_safe(ex(v) + 0.00873)) * 0.241514 + 0.598206),
    lambda v: when((ex(v) < 0.181, (ex(v) - 0.125) / 5.6), power(10.0, (ex(v) - 0.598206) / 0.241514) - 0.00873),
)


def _symmetric_log(cut: float, slope: float, scale: float, norm: float) -> tuple[Curve, Curve]:
    """A logarithm mirrored at (0, cut), of light in units of `norm` reflectance."""

    def encode(v):
        x = ex(v) / norm
        return when((x < 0.0, ex(cut) - log10(absolute(x) * scale + 1.0) * slope), log10(absolute(x) * scale + 1.0) * slope + cut)

    def decode(v):
        size = (power(10.0, absolute(ex(v) - cut) / slope) - 1.0) / scale * norm
        return when((ex(v) < cut, -size), size)

    return encode, decode


_curve("clog", *_symmetric_log(0.0730597, 0.529136, 10.1596, 0.9))
_curve("clog2", *_symmetric_log(0.092864125, 0.24136077, 87.099375, 0.9))


def _clog3() -> tuple[Curve, Curve]:
    low, high, below, slope, scale = 0.097465473, 0.15277891, 0.12783901, 0.36726845, 14.98325
    above, line, line_at, norm = 0.12240537, 1.9754798, 0.12512219, 0.9

    def encode(v):
        x = ex(v) / norm
        curve = log10(absolute(x) * scale + 1.0) * slope
        return when((x < -0.014, ex(below) - curve), (x <= 0.014, x * line + line_at), curve + above)

    def decode(v):
        y = ex(v)
        return when(
            (y < low, (power(10.0, (ex(below) - y) / slope) - 1.0) / -scale * norm),
            (y <= high, (y - line_at) / line * norm),
            (power(10.0, (y - above) / slope) - 1.0) / scale * norm,
        )

    return encode, decode


_curve("clog3", *_clog3())


def _redlogfilm() -> tuple[Curve, Curve]:
    white, black, rate = 685 / 1023, 95 / 1023, 0.002 * 1023 / 0.6
    gain = 1 / (1 - 10 ** (rate * (black - white)))
    offset = gain - 1

    def encode(v):
        x = (ex(v) + offset) / gain
        return when((x <= 0.0, 0.0), log10(_safe(x)) / rate + white)

    return encode, lambda v: power(10.0, (ex(v) - white) * rate) * gain - offset


_curve("redlogfilm", *_redlogfilm())


def _apple() -> tuple[Curve, Curve]:
    zero, knee, scale, beta, slope, offset = -0.05641088, 0.01, 47.28711236, 0.00964052, 0.08550479, 0.69336945
    return (
        lambda v: when(
            (ex(v) <= zero, 0.0), (ex(v) < knee, (ex(v) - zero) * (ex(v) - zero) * scale), log2(_safe(ex(v) + beta)) * slope + offset
        ),
        lambda v: when(
            (ex(v) >= scale * (knee - zero) ** 2, power(2.0, (ex(v) - offset) / slope) - beta),
            (ex(v) >= 0.0, sqrt(greatest(ex(v) / scale, 0.0)) + zero),
            zero,
        ),
    )


_curve("apple_log", *_apple())
_curve(
    "dlog",
    lambda v: when((ex(v) <= 0.0078, ex(v) * 6.025 + 0.0929), log10(_safe(ex(v) * 0.9892 + 0.0108)) * 0.256663 + 0.584555),
    lambda v: when((ex(v) <= 0.14, (ex(v) - 0.0929) / 6.025), (power(10.0, (ex(v) - 0.584555) / 0.256663) - 0.0108) / 0.9892),
)
_curve(
    "davinci",
    lambda v: when((ex(v) > 0.00262409, (log2(_safe(ex(v) + 0.0075)) + 7.0) * 0.07329248), ex(v) * 10.44426855),
    lambda v: when((ex(v) > 0.02740668, power(2.0, ex(v) / 0.07329248 - 7.0) - 0.0075), ex(v) / 10.44426855),
)


def _acescc() -> tuple[Curve, Curve]:
    least = 2.0**-16
    return (
        lambda v: when(
            (ex(v) <= 0.0, (math.log2(least) + 9.72) / 17.52),
            (ex(v) < 2.0**-15, (log2(_safe(ex(v) * 0.5 + least)) + 9.72) / 17.52),
            (log2(_safe(v)) + 9.72) / 17.52,
        ),
        lambda v: when((ex(v) < (9.72 - 15) / 17.52, (power(2.0, ex(v) * 17.52 - 9.72) - least) * 2.0), power(2.0, ex(v) * 17.52 - 9.72)),
    )


_curve("acescc", *_acescc())
_curve(
    "acescct",
    lambda v: when((ex(v) <= 0.0078125, ex(v) * 10.5402377416545 + 0.0729055341958355), (log2(_safe(v)) + 9.72) / 17.52),
    lambda v: when((ex(v) <= 0.155251141552511, (ex(v) - 0.0729055341958355) / 10.5402377416545), power(2.0, ex(v) * 17.52 - 9.72)),
)


def encode(name: str, v) -> Ex:
    return CURVES[name][0](v)


def decode(name: str, v) -> Ex:
    return CURVES[name][1](v)



def shaping(name: str, x, *p: float) -> Ex:
    """Scalar shaping functions: lerp-like, steps, bias and gain."""
    x = ex(x)
    t = lambda a, b: clamp((x - a) / (b - a))
    if name == "inverse_lerp":
        return (x - p[0]) / (p[1] - p[0])
    if name == "remap":
        return (x - p[0]) / (p[1] - p[0]) * (p[3] - p[2]) + p[2]
    if name == "smoothstep":
        return t(*p) * t(*p) * (ex(3.0) - t(*p) * 2.0)
    if name == "smootherstep":
        return t(*p) * t(*p) * t(*p) * (t(*p) * (t(*p) * 6.0 - 15.0) + 10.0)
    if name == "step":
        return when((x < p[0], 0.0), 1.0)
    if name == "pulse":
        return when(((x >= p[0]) & (x <= p[1]), 1.0), 0.0)
    if name == "fract":
        return x - floor(x)
    if name == "sign":
        return when((x > 0.0, 1.0), (x < 0.0, -1.0), 0.0)
    bias = lambda b, v: power(greatest(v, 0.0), math.log(b) / math.log(0.5))
    if name == "bias":
        return bias(p[0], x)
    if name == "gain":
        return when((x < 0.5, bias(1 - p[0], x * 2.0) / 2.0), ex(1.0) - bias(1 - p[0], ex(2.0) - x * 2.0) / 2.0)
    raise ValueError(name)
