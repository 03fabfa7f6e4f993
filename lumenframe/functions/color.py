"""Per-pixel colour operations as expressions over channels r, g, b, a."""

from __future__ import annotations

import math

import numpy as np

from .expr import Ex, Op, absolute, atan2, clamp, dot, ex, exp, floor, greatest, least, ln, luma, power, sqrt, when
from .transfer import CURVES

RGB = ("r", "g", "b")


def each(f, channels=RGB, keep=("a",)) -> Op:
    """`f` of every channel; `keep` pass through."""
    return Op({**{c: f(ex(c)) for c in channels}, **{c: ex(c) for c in keep}})


def extended(values, n: int, default: float) -> list[float]:
    """`values` made `n` long by its last one, or by `default` if there is none."""
    values = list(values) or [default]
    return [float(values[min(i, len(values) - 1)]) for i in range(n)]


def transfer(name: str, direction: str, channels=RGB, keep=("a",)) -> Op:
    return each(CURVES[name][direction == "decode"], channels, keep)


# Arithmetic


def guarded_div(a, b) -> Ex:
    """a / b, and 0 where b is about 0."""
    return when((absolute(b) > 1e-10, ex(a) / when((absolute(b) > 1e-10, b), 1.0)), 0.0)


BINARY = {
    "add": lambda a, b: ex(a) + b,
    "sub": lambda a, b: ex(a) - b,
    "mul": lambda a, b: ex(a) * b,
    "div": guarded_div,
    "absdiff": lambda a, b: absolute(ex(a) - b),
    "min": least,
    "max": greatest,
}


def with_constant(name: str, values, channels=(*RGB, "a")) -> Op:
    """A binary operation with a constant for each channel."""
    return Op({c: BINARY[name](ex(c), v) for c, v in zip(channels, extended(values, len(channels), 0.0), strict=True)})


def mad(b, c, channels=(*RGB, "a")) -> Op:
    n = len(channels)
    return Op({x: ex(x) * m + k for x, m, k in zip(channels, extended(b, n, 1.0), extended(c, n, 0.0), strict=True)})


def clamped(low=(0.0,), high=(1.0,), channels=(*RGB, "a")) -> Op:
    n = len(channels)
    return Op({c: clamp(ex(c), a, b) for c, a, b in zip(channels, extended(low, n, 0.0), extended(high, n, 1.0), strict=True)})


def raised(exponents, channels=(*RGB, "a")) -> Op:
    """Powers; a negative base gives 0 (the powers are not all whole numbers)."""
    return Op({c: power(greatest(ex(c), 0.0), e) for c, e in zip(channels, extended(exponents, len(channels), 1.0), strict=True)})


def normalized(in_center: float, out_center: float, scale: float) -> Op:
    """RGB as a vector around `in_center`, brought to length `scale`."""
    v = {c: ex(c) - in_center for c in RGB}
    size = sqrt(dot((1, 1, 1), [ex(f"v_{c}") * ex(f"v_{c}") for c in RGB]))
    out = {c: when((ex("len") > 0.0, ex(f"v_{c}") * scale / when((ex("len") > 0.0, "len"), 1.0)), 0.0) + out_center for c in RGB}
    return Op({**out, "a": "a"}, {f"v_{c}": e for c, e in v.items()}, {"len": size})


# Colour adjustments


def premultiplied() -> Op:
    return Op({**{c: ex(c) * "a" for c in RGB}, "a": "a"})


def unpremultiplied() -> Op:
    return Op({**{c: when((ex("a") > 0.0, ex(c) / when((ex("a") > 0.0, "a"), 1.0)), c) for c in RGB}, "a": "a"})


def saturated(scale: float) -> Op:
    return Op({**{c: ex("y0") + (ex(c) - "y0") * scale for c in RGB}, "a": "a"}, {"y0": luma(*RGB)})


def contrast_remap(black=0.0, white=1.0, low=0.0, high=1.0, contrast=1.0, threshold=0.5) -> Op:
    def one(v):
        t = when((v < black, 0.0), 1.0) if white == black else (v - black) / (white - black)
        if abs(contrast - 1.0) > 1e-6:
            at = lambda x: 1 / (1 + math.exp((threshold - x) * contrast))
            t = (ex(1.0) / (exp((ex(threshold) - t) * contrast) + 1.0) - at(0)) / (at(1) - at(0))
        return t * (high - low) + low

    return each(one)


def _cubic(*p):
    """A polynomial by rising powers, clamped to [0, 1]."""

    def at(t):
        out = ex(float(p[-1]))
        for c in reversed(p[:-1]):
            out = out * t + float(c)
        return clamp(out)

    return at


def _tent(middle):
    return lambda t: clamp((ex(1.0) - least(absolute(ex(t) - middle) * 3.0, 1.0)) * 0.87 + 0.13)


def _hsv_sector(t):
    """Channels of the pure colour at hue t * 300 degrees."""
    h = ex(t) * 5.0
    x = ex(1.0) - absolute(h - floor(h / 2.0) * 2.0 - 1.0)
    pick = lambda *v: when(*[(h < float(i + 1), e) for i, e in enumerate(v[:-1])], v[-1])
    return pick(1.0, x, 0.0, 0.0, x, 1.0), pick(x, 1.0, 1.0, x, 0.0, 0.0), pick(0.0, 0.0, x, 1.0, 1.0, x)


#: Channel functions of the colour maps on [0, 1]; polynomials by rising powers. Fixed values.
COLOR_MAPS = {
    "heat": (
        lambda t: when((ex(t) < 0.333, ex(t) / 0.333), 1.0),
        lambda t: when((ex(t) < 0.333, 0.0), (ex(t) < 0.666, (ex(t) - 0.333) / 0.333), 1.0),
        lambda t: when((ex(t) < 0.666, 0.0), (ex(t) - 0.666) / 0.334),
    ),
    "bluered": (
        lambda t: when((ex(t) < 0.5, ex(t) * 2.0), 1.0),
        lambda t: when((ex(t) < 0.5, ex(t) * 2.0), ex(1.0) - (ex(t) - 0.5) * 2.0),
        lambda t: when((ex(t) < 0.5, 1.0), ex(1.0) - (ex(t) - 0.5) * 2.0),
    ),
    "spectrum": tuple((lambda i: lambda t: _hsv_sector(t)[i])(i) for i in range(3)),
    "turbo": (_tent(0.65), _tent(0.50), _tent(0.35)),
    "inferno": (_cubic(0.0, 0.47, 5.04, -4.54), _cubic(-0.02, 1.03, 2.73, -3.72), _cubic(0.03, 1.71, -5.67, 4.26)),
    "viridis": (_cubic(0.28, 0.14, -0.68, 1.78, -0.53), _cubic(0.0, 1.41, -0.89, 0.48), _cubic(0.33, 1.26, -2.98, 1.74, -0.31)),
    "magma": (_cubic(0.0, 0.47, 4.87, -3.52), _cubic(-0.02, 0.42, 0.97, -1.36), _cubic(0.14, 1.89, -6.33, 4.98)),
    "plasma": (_cubic(0.05, 0.82, 0.21, -0.08), _cubic(0.0, 0.63, -0.41, 0.78), _cubic(0.53, -0.15, -0.85, 0.55)),
}


def color_mapped(name: str, channel: str | None = None) -> Op:
    """A channel (default: luma) through a named colour map."""
    source = clamp(ex(channel) if channel else luma(*RGB))
    return Op({c: f("t0") for c, f in zip(RGB, COLOR_MAPS[name], strict=True)}, {"t0": source})


def matrixed(m, offset=(0.0, 0.0, 0.0)) -> Op:
    """A 3x3 matrix on column vectors, plus an offset."""
    out = {c: dot(row, RGB) + float(o) for c, row, o in zip(RGB, np.asarray(m), offset, strict=True)}
    return Op({**out, "a": "a"})


def matrixed4(m) -> Op:
    """A 4x4 matrix on row vectors (r, g, b, a)."""
    m = np.asarray(m, float).reshape(4, 4)
    return Op({c: dot(m[:, i], (*RGB, "a")) for i, c in enumerate((*RGB, "a"))})


def compress(x) -> Ex:
    x = ex(x)
    l = ln(greatest(x, 0.0) + 1.0)
    return when((x <= 0.0, 0.0), l / (l + 1.0))


def expand(y) -> Ex:
    y = ex(y)
    safe = least(y, 0.999)
    return when((y <= 0.0, 0.0), (y >= 1.0, 3.4028234663852886e38), exp(safe / (ex(1.0) - safe)) - 1.0)


def range_compressed(use_luma: bool = False) -> Op:
    return _ranged(compress, use_luma)


def range_expanded(use_luma: bool = False) -> Op:
    return _ranged(expand, use_luma)


def _ranged(f, use_luma: bool) -> Op:
    if not use_luma:
        return each(f)
    scaled = {c: when((ex("y0") > 1e-10, ex(c) * f("y0") / when((ex("y0") > 1e-10, "y0"), 1.0)), f(c)) for c in RGB}
    return Op({**scaled, "a": "a"}, {"y0": luma(*RGB)})


# Grading


def cdl(slope=(1, 1, 1), offset=(0, 0, 0), pw=(1, 1, 1), saturation=1.0, style="asc") -> Op:
    """ASC CDL. Style `asc` clamps to [0, 1] before the power and at the end; `noclamp` leaves negatives alone."""
    v = {f"p_{c}": ex(c) * float(s) + float(o) for c, s, o in zip(RGB, slope, offset, strict=True)}
    base = (lambda x: clamp(x)) if style == "asc" else (lambda x: greatest(x, 0.0))
    raised_ = {}
    for c, p in zip(RGB, pw, strict=True):
        x = ex(f"p_{c}")
        q = base(x) if p == 1 and style == "asc" else power(base(x), float(p))
        raised_[f"q_{c}"] = q if style == "asc" else when((x < 0.0, x), q)
    out = {c: ex("y0") + (ex(f"q_{c}") - "y0") * float(saturation) for c in RGB}
    if style == "asc":
        out = {c: clamp(e) for c, e in out.items()}
    return Op({**out, "a": "a"}, v, raised_, {"y0": luma("q_r", "q_g", "q_b")})


def exponent(e, negative: str = "clamp", channels=RGB) -> Op:
    """Per-channel powers; negatives are clamped, mirrored or passed through."""

    def one(c, p):
        x = ex(c)
        q = power(absolute(x), float(p))
        return when((x >= 0.0, q), {"clamp": ex(0.0), "mirror": -q, "pass": x}[negative])

    return Op({**{c: one(c, p) for c, p in zip(channels, e, strict=True)}, "a": "a"})


def log_affine(base, log_slope, log_offset, lin_slope, lin_offset, inverse=False) -> Op:
    if inverse:
        return each(lambda v: (power(float(base), (v - log_offset) / log_slope) - lin_offset) / lin_slope)
    return each(lambda v: ln(greatest(v * lin_slope + lin_offset, 1.1754943508222875e-38)) * (log_slope / math.log(base)) + log_offset)


def log_camera(base, log_slope, log_offset, lin_slope, lin_offset, lin_break, inverse=False) -> Op:
    from .transfer import log_camera as curve

    return each(curve(base, log_slope, log_offset, lin_slope, lin_offset, lin_break)[inverse])


def ranged(low_in, high_in, low_out, high_out, clamp_ends=True) -> Op:
    scale = (high_out - low_out) / (high_in - low_in)
    one = lambda v: (v - low_in) * scale + low_out
    return each(lambda v: clamp(one(v), low_out, high_out) if clamp_ends else one(v))


def exposure_contrast(style: str, exposure=0.0, contrast=1.0, gamma=1.0, pivot=0.18, step=0.088) -> Op:
    k = max(0.001, contrast * gamma)
    if style == "log":
        at = max(0.0, math.log2(max(pivot, 0.001) / 0.18) * step + 0.435)
        return each(lambda v: v * k + ((exposure * step - at) * k + at))
    e, p = 2.0**exposure, max(pivot, 0.001)
    if style == "video":
        e, p = e**0.5464481, p**0.5464481
    if k == 1.0:
        return each(lambda v: v * e)
    return each(lambda v: power(greatest(v * (e / p), 0.0), k) * p)


def grading_primary(style: str, brightness=(0, 0, 0), contrast=(1, 1, 1), gamma=(1, 1, 1), offset=(0, 0, 0), exposure=(0, 0, 0),
                    lift=(0, 0, 0), gain=(1, 1, 1), saturation=1.0, pivot=None, black=0.0, white=1.0, low=None, high=None, inverse=False) -> Op:
    """Primary grading in its log, linear or video style, then saturation and clamps; backwards with `inverse`."""
    pivot = pivot if pivot is not None else (-0.2 if style == "log" else 0.18)
    span = white - black

    def gammaed(x, g):
        t = (x - black) / span
        return power(absolute(t), 1 / g) * when((t < 0.0, -1.0), 1.0) * span + black if g != 1 else x

    if inverse:
        return _grading_primary_back(style, brightness, contrast, gamma, offset, exposure, lift, gain, saturation, pivot, black, white, low, high, gammaed)
    step = {}
    for i, c in enumerate(RGB):
        x = ex(c)
        if style == "log":
            at = 0.5 + pivot * 0.5
            x = gammaed((x + brightness[i] * 6.25 / 1023.0 - at) * contrast[i] + at, gamma[i])
        elif style == "linear":
            at = 0.18 * 2.0**pivot
            x = (x + offset[i]) * 2.0 ** exposure[i]
            x = power(absolute(x / at), contrast[i]) * when((x < 0.0, -1.0), 1.0) * at
        else:
            slope = span / (white / gain[i] + (lift[i] * (gain[i] - white) / gain[i]) - black) if gain[i] else 1.0
            x = gammaed((x + offset[i] + lift[i] - black) * slope + black, gamma[i])
        step[f"p_{c}"] = x
    out = {c: ex("y0") + (ex(f"p_{c}") - "y0") * float(saturation) for c in RGB}
    if low is not None:
        out = {c: greatest(e, low) for c, e in out.items()}
    if high is not None:
        out = {c: least(e, high) for c, e in out.items()}
    return Op({**out, "a": "a"}, step, {"y0": luma("p_r", "p_g", "p_b")})


def _grading_primary_back(style, brightness, contrast, gamma, offset, exposure, lift, gain, saturation, pivot, black, white, low, high, gammaed) -> Op:
    span = white - black
    bounded = {f"p_{c}": ex(c) for c in RGB}
    if low is not None:
        bounded = {k: greatest(e, low) for k, e in bounded.items()}
    if high is not None:
        bounded = {k: least(e, high) for k, e in bounded.items()}
    spread = {f"q_{c}": ex("y0") + (ex(f"p_{c}") - "y0") / float(saturation) for c in RGB}
    out = {}
    for i, c in enumerate(RGB):
        x = ex(f"q_{c}")
        if style == "log":
            at = 0.5 + pivot * 0.5
            out[c] = (gammaed(x, 1 / gamma[i]) - at) / contrast[i] + at - brightness[i] * 6.25 / 1023.0
        elif style == "linear":
            at = 0.18 * 2.0**pivot
            x = power(absolute(x / at), 1 / contrast[i]) * when((x < 0.0, -1.0), 1.0) * at
            out[c] = x / 2.0 ** exposure[i] - offset[i]
        else:
            slope = span / (white / gain[i] + (lift[i] * (gain[i] - white) / gain[i]) - black) if gain[i] else 1.0
            out[c] = (gammaed(x, 1 / gamma[i]) - black) / slope + black - (offset[i] + lift[i])
    return Op({**out, "a": "a"}, bounded, {"y0": luma("p_r", "p_g", "p_b")}, spread)


def dynamic_grade(exposure=0.0, contrast=1.0, gamma=1.0, saturation=1.0, pivot=0.18) -> Op:
    step = {f"p_{c}": power(greatest((ex(c) * 2.0**exposure - pivot) * contrast + pivot, 0.0), 1 / gamma) for c in RGB}
    return Op({**{c: ex("y0") + (ex(f"p_{c}") - "y0") * saturation for c in RGB}, "a": "a"}, step, {"y0": luma("p_r", "p_g", "p_b")})


def allocation(kind: str, low: float, high: float, offset: float | None = None, inverse=False) -> Op:
    """Uniform or log2 allocation of a range onto [0, 1]."""
    if kind == "uniform":
        return each((lambda v: v * (high - low) + low) if inverse else (lambda v: (v - low) / (high - low)))
    k = offset or 0.0
    if inverse:
        return each(lambda v: power(2.0, v * (high - low) + low) - k)
    return each(lambda v: (ln(greatest(v + k, 1.1754943508222875e-38)) / math.log(2.0) - low) / (high - low))


def basic_primary(lift=(0, 0, 0), gamma=(1, 1, 1), gain=(1, 1, 1), offset=0.0, exposure=0.0, contrast=1.0, saturation=1.0, pivot=0.18, low=None, high=None, inverse=False) -> Op:
    """Exposure, lift, gain and gamma, an offset, contrast about a pivot, saturation, clamps; backwards (but for clamps) with `inverse`."""
    if inverse:
        spread = {f"q_{c}": (ex("y0") + (ex(c) - "y0") / float(saturation) - pivot) / float(contrast) + pivot - float(offset) for c in RGB}
        out = {}
        for i, c in enumerate(RGB):
            x = power(greatest(f"q_{c}", 0.0), float(gamma[i])) / float(gain[i])
            out[c] = (x - float(lift[i])) / (1.0 - float(lift[i])) / 2.0**exposure
        return Op({**out, "a": "a"}, {"y0": luma(*RGB)}, spread)
    step = {}
    for i, c in enumerate(RGB):
        x = ex(c) * 2.0**exposure
        x = power(greatest((x + (ex(1.0) - x) * float(lift[i])) * float(gain[i]), 0.0), 1 / float(gamma[i])) + float(offset)
        step[f"p_{c}"] = (x - pivot) * float(contrast) + pivot
    out = {c: ex("y0") + (ex(f"p_{c}") - "y0") * float(saturation) for c in RGB}
    if low is not None:
        out = {c: greatest(e, float(low)) for c, e in out.items()}
    if high is not None:
        out = {c: least(e, float(high)) for c, e in out.items()}
    return Op({**out, "a": "a"}, step, {"y0": luma("p_r", "p_g", "p_b")})


def basic_tone(shadows=(1,) * 4, midtones=(1,) * 4, highlights=(1,) * 4, whites=(1,) * 4, blacks=(0,) * 4, shadow=(0.0, 0.09), highlight=(0.5, 0.89)) -> Op:
    """Gains of shadows, midtones and highlights by luma (each red, green, blue, master), after an offset and before a scale."""
    dark = clamp((ex(shadow[1]) - "y0") / (shadow[1] - shadow[0]))
    light = clamp((ex("y0") - highlight[0]) / (highlight[1] - highlight[0]))
    weights = {"wd": dark, "wl": light}
    out = {}
    for i, c in enumerate(RGB):
        k = lambda v, i=i: float(v[i] * v[3] - 1)
        gain = ex(1.0) + ex("wd") * k(shadows) + ex("wm") * k(midtones) + ex("wl") * k(highlights)
        out[c] = (ex(c) + float(blacks[i] + blacks[3])) * gain * float(whites[i] * whites[3])
    return Op({**out, "a": "a"}, {"y0": luma(*RGB)}, weights, {"wm": greatest(ex(1.0) - "wd" - "wl", 0.0)})


def pixel_bytes(channels, bits: int = 8):
    """The channels' stored integers (clamped, scaled, cut off), high byte first, in hexadecimal digits."""
    from pyspark.sql import functions as F

    stored = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * (2**bits - 1)).cast("int") for c in channels]
    return F.concat(*[F.lpad(F.hex(v), bits // 4, "0") for v in stored])


# Filmic tone curve

#: Coefficients a, b, c, d, e of the tone curve x(ax+b) / (x(cx+d)+e). Fixed values.
TONE_PRESETS = {
    "fitted": (2.51, 0.03, 2.43, 0.59, 0.14),
    "high_contrast": (2.80, 0.04, 2.90, 0.55, 0.10),
    "filmic": (2.20, 0.03, 2.10, 0.65, 0.18),
    "alt1": (2.35, 0.025, 2.30, 0.62, 0.16),
}


def tone_mapped(preset: str = "fitted") -> Op:
    a, b, c, d, e = TONE_PRESETS[preset]

    def one(v):
        x = greatest(v, 0.0)
        return clamp(x * (x * a + b) / (x * (x * c + d) + e))

    return each(one)


# Fixed functions


def _inverse_or_zero(d) -> Ex:
    return when((ex(d).eq(0.0), 0.0), ex(1.0) / when((ex(d).eq(0.0), 1.0), d))


def xyz_to_xyy() -> Op:
    return Op({"r": ex("r") * "d", "g": ex("g") * "d", "b": "g", "a": "a"}, {"d": _inverse_or_zero(ex("r") + "g" + "b")})


def xyy_to_xyz() -> Op:
    return Op({"r": ex("b") * "r" * "d", "g": "b", "b": ex("b") * (ex(1.0) - "r" - "g") * "d", "a": "a"}, {"d": _inverse_or_zero("g")})


def xyz_to_uvy() -> Op:
    return Op({"r": ex("r") * 4.0 * "d", "g": ex("g") * 9.0 * "d", "b": "g", "a": "a"}, {"d": _inverse_or_zero(dot((1, 15, 3), RGB))})


def uvy_to_xyz() -> Op:
    z = ex("b") * 0.75 * (ex(4.0) - "r" - ex("g") * 6.666666666666667) * "d"
    return Op({"r": ex("b") * 2.25 * "r" * "d", "g": "b", "b": z, "a": "a"}, {"d": _inverse_or_zero("g")})


#: CIE L*u*v* on a unit scale, white D65. Fixed values.
_UN, _VN, _Y_BREAK, _KAPPA = 0.19783001, 0.46831999, 0.008856451679, 9.0329629629629608


def xyz_to_luv() -> Op:
    lightness = when((ex("g") <= _Y_BREAK, ex("g") * _KAPPA), power(greatest("g", 0.0), 1 / 3) * 1.16 - 0.16)
    return Op(
        {"r": "l0", "g": ex("l0") * 13.0 * (ex("r") * 4.0 * "d" - _UN), "b": ex("l0") * 13.0 * (ex("g") * 9.0 * "d" - _VN), "a": "a"},
        {"d": _inverse_or_zero(dot((1, 15, 3), RGB)), "l0": lightness},
    )


def luv_to_xyz() -> Op:
    t = (ex("r") + 0.16) / 1.16
    d = _inverse_or_zero("r") / 13.0
    return Op(
        {"r": ex("y0") * 9.0 * "u" * "dv", "g": "y0", "b": ex("y0") * (ex(12.0) - ex("u") * 3.0 - ex("v") * 20.0) * "dv", "a": "a"},
        {"u": ex("g") * d + _UN, "v": ex("b") * d + _VN, "y0": when((ex("r") <= 0.08, ex("r") / _KAPPA), t * t * t)},
        {"dv": _inverse_or_zero("v") * 0.25},
    )


def _max_min() -> dict:
    return {"hi": greatest(*RGB), "lo": least(*RGB)}


def rgb_to_hsv() -> Op:
    d = when((ex("dl") < 1e-10, 1.0), "dl")
    sector = when(
        (ex("dl") < 1e-10, 0.0), (ex("hi").eq("r"), (ex("g") - "b") / d), (ex("hi").eq("g"), (ex("b") - "r") / d + 2.0), (ex("r") - "g") / d + 4.0
    )
    saturation = when((absolute("hi") < 1e-10, 0.0), ex("dl") / when((absolute("hi") < 1e-10, 1.0), "hi"))
    return Op(
        {"r": when((ex("h0") < 0.0, (ex("h0") + 6.0) / 6.0), ex("h0") / 6.0), "g": saturation, "b": "hi", "a": "a"},
        _max_min(), {"dl": ex("hi") - "lo"}, {"h0": sector},
    )


def hsv_to_rgb() -> Op:
    h = ex("r") * 6.0
    x = ex("c0") * (ex(1.0) - absolute(h - floor(h / 2.0) * 2.0 - 1.0))
    pick = lambda *v: when(*[(ex("h0") < float(i + 1), e) for i, e in enumerate(v[:-1])], v[-1]) + "m0"
    return Op(
        {"r": pick("c0", "x0", 0.0, 0.0, "x0", "c0"), "g": pick("x0", "c0", "c0", "x0", 0.0, 0.0), "b": pick(0.0, 0.0, "x0", "c0", "c0", "x0"), "a": "a"},
        {"h0": h, "c0": ex("b") * "g"}, {"x0": x, "m0": ex("b") - "c0"},
    )


def rgb_to_hsy(variant: str = "lin") -> Op:
    """Hue (magenta at 0), saturation and Rec.709 luma."""
    if variant == "lin":
        high = ex("ds") / greatest(ex("ds") * 0.07 + 1e-6, ex("r") + "g" + "b" + 0.15)
        t = clamp((ex("y0") - 0.001) / 0.009)
        sat = (ex("ds") * 5.0 + t * (high - ex("ds") * 5.0)) * 1.4
    else:
        sat = ex("ds") * {"log": 4.0, "vid": 1.25}[variant]
    d = when((ex("hi").eq("lo"), 1.0), ex("hi") - "lo")
    hue = when(
        (ex("hi").eq("lo"), 0.0), (ex("hi").eq("r"), (ex("g") - "b") / d + 1.0), (ex("hi").eq("g"), (ex("b") - "r") / d + 3.0), (ex("r") - "g") / d + 5.0
    )
    turned = ex("h0") + 0.5
    return Op(
        {"r": when((ex("y0") < 0.0, turned - floor(turned)), "h0"), "g": sat, "b": "y0", "a": "a"},
        {**_max_min(), "y0": luma(*RGB)},
        {"ds": absolute(ex("r") - "y0") + absolute(ex("g") - "y0") + absolute(ex("b") - "y0"), "h0": hue / 6.0},
    )


def hsy_to_rgb(variant: str = "log") -> Op:
    """The inverse: from luma along the hue, as far as the saturation says.

    For the linear variant that distance solves a quadratic equation, as its saturation
    is measured against the sum of the channels, which grows with the distance.
    """
    k = {"log": 4.0, "vid": 1.25, "lin": 1.0}[variant]
    far = absolute(ex("q_r") - "b") + absolute(ex("q_g") - "b") + absolute(ex("q_b") - "b")
    if variant == "lin":
        t = clamp((ex("b") - 0.001) / 0.009)
        sums = {"far": far, "more": ex("q_r") + "q_g" + "q_b" - ex("b") * 3.0, "base": ex("b") * 3.0 + 0.15, "sat": ex("g") / 1.4, "t0": t}
        five = (ex(1.0) - "t0") * 5.0 * "far"
        lines = {"qa": five * "more", "qb": five * "base" + ex("t0") * "far" - ex("sat") * "more", "qc": ex("sat") * "base"}
        root = sqrt(greatest(ex("qb") * "qb" + ex("qa") * "qc" * 4.0, 0.0))
        gains = [sums, lines, {"gs": ex("qc") * 2.0 / when((absolute(ex("qb") + root) > 1e-12, ex("qb") + root), 1e-12)}]
    else:
        gains = [{"gs": ex("g") / greatest(far * k, 1e-10)}]
    h = ex("r") - 1 / 6 + when((ex("b") < 0.0, 0.5), 0.0)
    return Op(
        {**{c: ex("b") + (ex(f"q_{c}") - "b") * "gs" for c in RGB}, "a": "a"},
        {"h0": (h - floor(h)) * 6.0},
        {"p_r": clamp(absolute(ex("h0") - 3.0) - 1.0), "p_g": clamp(ex(2.0) - absolute(ex("h0") - 2.0)), "p_b": clamp(ex(2.0) - absolute(ex("h0") - 4.0))},
        {"y1": luma("p_r", "p_g", "p_b")},
        {f"q_{c}": ex(f"p_{c}") * when((absolute("y1") > 1e-10, ex("b") / when((absolute("y1") > 1e-10, "y1"), 1.0)), 0.0) for c in RGB},
        *gains,
    )


def _gamut_scale(limit: float, threshold: float, p: float) -> float:
    span = limit - threshold
    return span / (((1 - threshold) / span) ** -p - 1) ** (1 / p)


#: Limits and thresholds of cyan, magenta and yellow, and the power. Fixed values.
GAMUT_LIMITS, GAMUT_THRESHOLDS, GAMUT_POWER = (1.147, 1.264, 1.312), (0.815, 0.803, 0.880), 1.2


def gamut_compressed(inverse: bool = False) -> Op:
    """Distances from the achromatic axis, compressed above a threshold."""
    p, out = GAMUT_POWER, {}
    for c, limit, threshold in zip(RGB, GAMUT_LIMITS, GAMUT_THRESHOLDS, strict=True):
        scale = _gamut_scale(limit, threshold, p)
        dist = (ex("hi") - c) / when((ex("hi").eq(0.0), 1.0), absolute("hi"))
        n = greatest((dist - threshold) / scale, 0.0)
        if inverse:
            q = power(least(n, 0.999999), p)
            curve = when((dist >= threshold + scale, dist), power(q / (ex(1.0) - q), 1 / p) * scale + threshold)
        else:
            curve = n * scale / power(power(n, p) + 1.0, 1 / p) + threshold
        out[c] = when((ex("hi").eq(0.0), 0.0), (dist < threshold, c), ex("hi") - curve * absolute("hi"))
    return Op({**out, "a": "a"}, {"hi": greatest(*RGB)})


def _sat_weight(noise: float) -> Ex:
    return (greatest("hi", 1e-10) - greatest("lo", 1e-10)) / greatest("hi", noise)


#: Rows by knot interval, columns by falling power. Fixed values.
_HUE_SPLINE = ((0.25, 0.0, 0.0, 0.0), (-0.75, 0.75, 0.75, 0.25), (0.75, -1.5, 0.0, 1.0), (-0.25, 0.75, -0.75, 0.25))


def _hue_weight(inverse_width: float) -> tuple[Ex, Ex]:
    """(knot coordinate, weight given columns k0 and t0)."""
    knot = atan2((ex("g") - "b") * math.sqrt(3.0), ex("r") * 2.0 - (ex("g") + "b")) * inverse_width + 2.0
    t = ex("k0") - floor("k0")
    rows = [((c[0] * t + c[1]) * t + c[2]) * t + c[3] for c in _HUE_SPLINE]
    inside = [(floor("k0").eq(float(i)), r) for i, r in enumerate(rows)]
    return knot, when(*inside, 0.0)


#: Scale, inverse hue width of each version. Fixed values.
RED_VERSIONS = {"1.0": (0.82, 1.6976527263135504), "0.3": (0.85, 1.9098593171027443)}


def red_modified(version: str = "1.0", inverse: bool = False) -> Op:
    """The red modifier: red is pulled to a pivot near the red hue. 0.3 keeps the hue by moving the middle channel too.

    The inverse weighs the hue of the modified colour, as is usual, so it is near rather than exact.
    """
    scale, inverse_width = RED_VERSIONS[version]
    cut, pivot = 1 - scale, 0.03
    knot, weight = _hue_weight(inverse_width)
    if inverse:
        low = least("g", "b")
        qa = ex("fh") * cut - 1.0
        qb = ex("r") - ex("fh") * (low + pivot) * cut
        qc = ex("fh") * low * (pivot * cut)
        red = (-qb - sqrt(greatest(qb * qb - qa * qc * 4.0, 0.0))) / (qa * 2.0)
    else:
        red = ex("r") + ex("fh") * _sat_weight(1e-2) * (ex(pivot) - "r") * cut
    first = (_max_min(), {"k0": knot}, {"fh": weight}, {"nr": when((ex("fh") > 0.0, red), "r")})
    if version == "1.0":
        return Op({"r": "nr", "g": "g", "b": "b", "a": "a"}, *first)

    def kept(middle: str, low: str) -> Ex:
        return (ex(middle) - low) / greatest(ex("r") - low, 1e-10) * (ex("nr") - low) + low

    green = when(((ex("fh") > 0.0) & (ex("g") >= "b"), kept("g", "b")), "g")
    blue = when(((ex("fh") > 0.0) & (ex("g") < "b"), kept("b", "g")), "b")
    return Op({"r": "nr", "g": green, "b": blue, "a": "a"}, *first)


def glowed(gain: float = 0.05, middle: float = 0.08, inverse: bool = False) -> Op:
    """The glow module (1.0 by default; 0.3 with 0.075 and 0.1)."""
    chroma = sqrt(greatest(ex("b") * (ex("b") - "g") + ex("g") * (ex("g") - "r") + ex("r") * (ex("r") - "b"), 0.0))
    x = (_sat_weight(1e-2) - 0.4) * 5.0
    sign = when((ex("x0") < 0.0, -1.0), 1.0)
    t = greatest(ex(1.0) - ex("x0") * sign * 0.5, 0.0)
    part = (ex(middle) / when((ex("yc") > 1e-10, "yc"), 1.0) - 0.5) * "gg"
    if inverse:
        added = when((ex("yc") >= middle * 2, 0.0), (ex("yc") <= (ex("gg") + 1.0) * (middle * 2 / 3), -(ex("gg") / (ex("gg") + 1.0))), part / (ex("gg") * 0.5 - 1.0))
    else:
        added = when((ex("yc") >= middle * 2, 0.0), (ex("yc") <= middle * 2 / 3, "gg"), part)
    return Op(
        {**{c: ex(c) * (added + 1.0) for c in RGB}, "a": "a"},
        _max_min(),
        {"yc": (ex("b") + "g" + "r" + chroma * 1.75) / 3.0, "x0": x},
        {"gg": (sign * (ex(1.0) - t * t) + 1.0) * 0.5 * gain},
    )


#: Luminance rows of AP1 and Rec.2100. Fixed values.
AP1_LUMA, REC2100_LUMA, DIM_GAMMA = (0.27222871678091454, 0.67408176581114831, 0.053689517407937051), (0.2627, 0.6780, 0.0593), 0.9811


def surround(gamma: float = DIM_GAMMA, weights=AP1_LUMA, least_luma: float = 1e-10) -> Op:
    """Channels times luminance to `gamma` - 1 (dark-to-dim; Rec.2100 surround with its weights and 1e-4)."""
    return Op({**{c: ex(c) * power("y0", gamma - 1) for c in RGB}, "a": "a"}, {"y0": greatest(absolute(dot(weights, RGB)), least_luma)})
