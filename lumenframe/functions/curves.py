"""Grading curves whose slope is linear between knots: tone zones, RGB curves and hue curves.

Such a curve is a run of parabolas with a continuous slope, given by its knots, the
slope at each, and one height; outside its knots it goes on straight. Its
forward and inverse forms are CASE expressions with the numbers worked out on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from .color import RGB, hsy_to_rgb, rgb_to_hsy
from .expr import Ex, Op, ex, floor, greatest, least, ln, power, sqrt, when


@dataclass(frozen=True)
class SlopeCurve:
    """Knots `x` in rising order, slopes `m` at them, and the height `y0` at the first."""

    x: tuple
    m: tuple
    y0: float

    @property
    def y(self) -> tuple:
        """Heights at the knots."""
        out = [self.y0]
        for i in range(len(self.x) - 1):
            out.append(out[-1] + (self.m[i] + self.m[i + 1]) / 2 * (self.x[i + 1] - self.x[i]))
        return tuple(out)

    def forward(self, v) -> Ex:
        v, x, m, y = ex(v), self.x, self.m, self.y
        cases = [(v < x[0], (v - x[0]) * m[0] + y[0])]
        for i in range(len(x) - 1):
            if x[i + 1] > x[i]:
                bend = (m[i + 1] - m[i]) / (2 * (x[i + 1] - x[i]))
                t = v - x[i]
                cases.append((v < x[i + 1], (t * bend + m[i]) * t + y[i]))
        return when(*cases, (v - x[-1]) * m[-1] + y[-1])

    def inverse(self, v) -> Ex:
        """For curves that rise everywhere."""
        v, x, m, y = ex(v), self.x, self.m, self.y
        flat = lambda s: s if abs(s) > 1e-9 else 1e-9
        cases = [(v < y[0], (v - y[0]) / flat(m[0]) + x[0])]
        for i in range(len(x) - 1):
            if x[i + 1] > x[i]:
                bend = (m[i + 1] - m[i]) / (2 * (x[i + 1] - x[i]))
                rise = v - y[i]
                root = sqrt(greatest(rise * (4 * bend) + m[i] * m[i], 0.0))
                cases.append((v < y[i + 1], rise * 2.0 / greatest(root + m[i], 1e-12) + x[i]))
        return when(*cases, (v - y[-1]) / flat(m[-1]) + x[-1])

    def at(self, v: float) -> float:
        """The curve's value on the driver."""
        x, m, y = self.x, self.m, self.y
        if v < x[0]:
            return y[0] + (v - x[0]) * m[0]
        for i in range(len(x) - 1):
            if v < x[i + 1]:
                t = v - x[i]
                return y[i] + t * (m[i] + t * (m[i + 1] - m[i]) / (2 * (x[i + 1] - x[i])))
        return y[-1] + (v - x[-1]) * m[-1]


def fitted(points: list[tuple[float, float]], slopes: list[float] | None = None) -> SlopeCurve:
    """The curve through control points, monotone where they are.

    Each span of two points gets a knot of its own, so that the slopes at both
    points can be kept; free slopes are length-weighted means of the neighbouring
    secants, and 0 where those change sign (Schumaker's quadratic splines).
    """
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    n = len(points)
    secant = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n - 1)]
    if slopes is None:
        size = [math.hypot(xs[i + 1] - xs[i], ys[i + 1] - ys[i]) for i in range(n - 1)]
        inner = [
            (size[i] * secant[i] + size[i + 1] * secant[i + 1]) / (size[i] + size[i + 1]) if secant[i] * secant[i + 1] > 0 else 0.0 for i in range(n - 2)
        ]
        first, last = (inner[0], inner[-1]) if inner else (secant[0], secant[0])
        end = lambda d, s: (3 * d - s) / 2 if d * (3 * d - s) > 0 else 0.0
        slopes = [end(secant[0], first), *inner, end(secant[-1], last)]
    x, m = [xs[0]], [slopes[0]]
    for i in range(n - 1):
        a, b, d, h = slopes[i], slopes[i + 1], secant[i], xs[i + 1] - xs[i]
        if abs(a + b - 2 * d) > 1e-9:
            low, high = xs[i], xs[i + 1]
            if (a - d) * (b - d) < 0:
                if abs(b - d) < abs(a - d):
                    high = low + 2 * h * (b - d) / (b - a)
                else:
                    low = high + 2 * h * (a - d) / (b - a)
            knot = (low + high) / 2
            x.append(knot)
            m.append(2 * d - b + (b - a) * (knot - xs[i]) / h)
        x.append(xs[i + 1])
        m.append(b)
    return SlopeCurve(tuple(x), tuple(m), ys[0])


def rgb_curves(red=None, green=None, blue=None, master=None, inverse: bool = False) -> Op:
    """A curve for each channel, then one for all; None leaves values as they are."""
    own = dict(zip(RGB, (red, green, blue), strict=True))
    out = {}
    for c in RGB:
        chain = [k for k in (own[c], master) if k is not None]
        v = ex(c)
        for k in reversed(chain) if inverse else chain:
            v = k.inverse(v) if inverse else k.forward(v)
        out[c] = v
    return Op({**out, "a": "a"})


# Tone zones

#: Top, top and bottom of the s-contrast, bottom, and pivot of each style. Fixed values.
TONE_STYLES = {"log": (1.0, 1.0, 0.0, 0.4), "video": (1.0, 1.0, 0.0, 0.4), "linear": (7.5, 6.5, -5.5, 0.0)}
LEAST, MOST, SLOPE_LEFT, HALO = 0.01, 1.99, 0.1, 0.4


def _bounded(v: float) -> float:
    return min(MOST, max(LEAST, v))


def _midtones(value: float, centre: float, width: float, bottom: float, top: float) -> SlopeCurve | None:
    """A bump of slope on one side of `centre` and its counterpart on the other; the ends stay where they are."""
    value = _bounded(value)
    if value == 1:
        return None
    width = min(max(width, 0.01), (top - bottom) * 0.95)
    centre = min(max(centre, bottom + width * 0.51), top - width * 0.51)
    left = centre - width / 2
    x = [bottom, left, left + width / 4, left + width * 3 / 4, left + width, top]
    k = (value - 1) * (1 - SLOPE_LEFT)
    m = [1.0, 1 + k * HALO, 1 + k, 1 - k, 1 - k * HALO, 1.0]
    free = 4 if centre <= (top + bottom) / 2 else 1
    # The free slope makes the whole rise equal to that of the identity.
    rise = lambda s: sum((s[i] + s[i + 1]) / 2 * (x[i + 1] - x[i]) for i in range(5))
    lone = (x[free + 1] - x[free - 1]) / 2
    m[free] = 0.0
    m[free] = (top - bottom - rise(m)) / lone
    return SlopeCurve(tuple(x), tuple(m), bottom)


def _side(value: float, low: float, high: float, bend_low: bool) -> tuple[SlopeCurve, bool] | None:
    """Both ends of [low, high] stay, the slope at one end changes; a value over 1 is the inverse of its mirror image."""
    value = _bounded(value)
    if value == 1:
        return None
    slope = max(LEAST, value if value < 1 else 2 - value)
    ends = (slope, 1.0) if bend_low else (1.0, slope)
    middle = 2 - (ends[0] + ends[1]) / 2
    return SlopeCurve((low, (low + high) / 2, high), (ends[0], middle, ends[1]), low), value > 1


def _end(value: float, low: float, high: float, dark: bool) -> tuple[SlopeCurve, float | None] | None:
    """The slope beyond one end of [low, high]; over 1, the inverse of its mirror image stretched over the same range."""
    value = _bounded(value)
    test = 2 - value if dark else value
    if test == 1:
        return None
    if test < 1:
        m = (2 - value, 1.0) if dark else (1.0, value)
    else:
        m = (value, 1.0) if dark else (1.0, 2 - value)
    m = tuple(max(LEAST, s) for s in m)
    rise = (m[0] + m[1]) / 2 * (high - low)
    curve = SlopeCurve((low, high), m, high - rise if dark else low)
    return curve, (None if test < 1 else (m[0] + m[1]) / 2)


def _s_contrast(value: float, pivot: float, end: float) -> SlopeCurve | None:
    """From the pivot to one end (kept): steeper in the middle, flatter outside, or the other way round."""
    if value == 1:
        return None
    k = 1 / (1.8125 - 0.8125 * min(value, MOST)) if value > 1 else 0.28125 + 0.71875 * max(value, LEAST)
    span = end - pivot
    out = 1 / k
    # Slope k to a, then falling to 1 / k at b, then constant: the rise over the span is the span.
    a = span * 0.25 / k
    centre = (1 - out) / (k - out) * span
    b = 2 * centre - a
    if abs(b) > abs(span):
        b = span
        a = 2 * centre - b
    x = sorted([(0.0, k), (a, k), (b, out), (span, out)]) if span > 0 else sorted([(span, out), (b, out), (a, k), (0.0, k)])
    return SlopeCurve(tuple(pivot + p for p, _ in x), tuple(s for _, s in x), pivot if span > 0 else end)


#: Light to the logarithm in which the linear style grades, and its break. Fixed values.
_LOG_BREAK, _LOG_SHIFT, _LOG_GAIN, _LOG_AT = 0.0041318374739483946, -0.000157849851665374, 363.034608563, -7.0


def lin_to_log(v) -> Ex:
    return when((ex(v) < _LOG_BREAK, ex(v) * _LOG_GAIN + _LOG_AT), ln(greatest((ex(v) + _LOG_SHIFT) / (0.18 + _LOG_SHIFT), 1e-300)) / math.log(2.0))


def log_to_lin(v) -> Ex:
    return when((ex(v) < -5.5, (ex(v) - _LOG_AT) / _LOG_GAIN), power(2.0, least(v, 60.0)) * (0.18 + _LOG_SHIFT) - _LOG_SHIFT)


@dataclass(frozen=True)
class Zone:
    """A zone's red, green, blue and master values (1 is neutral), and where it lies."""

    values: tuple = (1.0, 1.0, 1.0, 1.0)
    start: float = 0.0
    width: float = 1.0


def tone(style: str = "log", blacks: Zone | None = None, shadows: Zone | None = None, midtones: Zone | None = None, highlights: Zone | None = None,
         whites: Zone | None = None, s_contrast: float = 1.0, inverse: bool = False) -> Op:
    """Five zones and an s-contrast, in the order midtones, highlights, whites, shadows, blacks, contrast."""
    top, top_sc, bottom, pivot = TONE_STYLES[style]
    blacks, shadows = blacks or Zone(start=bottom + (top - bottom) * 0.4, width=(top - bottom) * 0.4), shadows or Zone(start=pivot + (top - bottom) * 0.1, width=bottom)
    midtones, highlights = midtones or Zone(start=pivot, width=(top - bottom) * 0.6), highlights or Zone(start=pivot - (top - bottom) * 0.1, width=top)
    whites = whites or Zone(start=bottom + (top - bottom) * 0.4, width=(top - bottom) * 0.5)
    low_h, high_h = min(highlights.start, highlights.width - 0.01), highlights.width
    low_s, high_s = shadows.width, max(shadows.start, shadows.width + 0.01)

    def steps(i: int) -> list:
        """Curves of one channel (or of the master) as (forward, inverse) functions."""
        out = []

        def add(curve: SlopeCurve | None, reverse: bool = False) -> None:
            if curve is not None:
                out.append((curve.inverse, curve.forward) if reverse else (curve.forward, curve.inverse))

        add(_midtones(midtones.values[i], midtones.start, midtones.width, bottom, top))
        if side := _side(2 - highlights.values[i], low_h, high_h, False):
            add(*side)
        for zone, dark in ((whites, False), (None, False), (blacks, True)):
            if zone is None:
                if side := _side(shadows.values[i], low_s, high_s, True):
                    add(*side)
                continue
            low, high = (zone.start - zone.width, zone.start) if dark else (zone.start, zone.start + zone.width)
            if found := _end(zone.values[i], low, high, dark):
                curve, gain = found
                if gain is None:
                    add(curve)
                else:
                    fixed = high if dark else low
                    stretch = lambda v, g, fixed=fixed: (ex(v) - fixed) * g + fixed
                    out.append((
                        lambda v, c=curve, g=gain, s=stretch: s(c.inverse(s(v, g)), 1 / g),
                        lambda v, c=curve, g=gain, s=stretch: s(c.forward(s(v, g)), 1 / g),
                    ))
        return out

    master = steps(3)
    ends = [c for c in (_s_contrast(s_contrast, pivot, top_sc), _s_contrast(s_contrast, pivot, bottom)) if c is not None]
    if ends:
        up, down = ends
        pick = lambda how: lambda v: when((ex(v) >= pivot, getattr(up, how)(v)), getattr(down, how)(v))
        master.append((pick("forward"), pick("inverse")))
    groups: list[dict] = []
    columns = {c: ex(c) for c in RGB}
    if style == "linear":
        groups.append({f"z0_{c}": lin_to_log(c) for c in RGB})
        columns = {c: ex(f"z0_{c}") for c in RGB}
    order = {c: [*steps(i), *master] for i, c in enumerate(RGB)}
    for n in range(max(map(len, order.values()))):
        step = {}
        for c in RGB:
            chain = list(reversed(order[c])) if inverse else order[c]
            step[f"z{n + 1}_{c}"] = chain[n][inverse](columns[c]) if n < len(chain) else columns[c]
        groups.append(step)
        columns = {c: ex(f"z{n + 1}_{c}") for c in RGB}
    if style == "linear":
        columns = {c: log_to_lin(v) for c, v in columns.items()}
    return Op({**columns, "a": "a"}, *groups)


# Hue curves


def periodic(points: list[tuple[float, float]], climbs: bool = False) -> SlopeCurve:
    """A curve over hue in [0, 1) that joins itself; one that `climbs` gains 1 each turn."""
    step = 1.0 if climbs else 0.0
    points = sorted(points)
    around = [(x + k, y + k * step) for k in (-1, 0, 1) for x, y in points]
    return fitted(around)


def _added(curve: SlopeCurve) -> SlopeCurve:
    """The curve of ``x + curve(x)``."""
    return SlopeCurve(curve.x, tuple(m + 1 for m in curve.m), curve.y0 + curve.x[0])


def hue_curves(style: str = "log", inverse: bool = False, **curves: SlopeCurve) -> Op:
    """Curves over hue, saturation and luma, in this order: hue_hue, sat_sat, gains lum_sat and hue_sat, gain sat_lum at the new
    saturation, lum_lum, gain hue_lum (fading with saturation), and hue_fx.

    Gains multiply saturation; gains of luma multiply it in the linear style and shift it by a tenth of their excess in the
    others. hue_lum, hue_sat and hue_hue read the hue as it came. Styles: lin (lum_lum and lum_sat read the logarithm of
    luma), log, vid. `inverse` takes curves that rise back by their inverses, and gains as they were (at least 0.01).
    """
    start, back = rgb_to_hsy(style), hsy_to_rgb(style)
    get = lambda name, v, neutral: curves[name].forward(v) if name in curves else neutral
    gain = lambda name, v: greatest(get(name, v, ex(1.0)), 0.0)
    undo = lambda name, v: curves[name].inverse(v) if name in curves else ex(v)
    turn = lambda v: ex(v) - floor(v)
    shown, light = (lin_to_log, log_to_lin) if style == "lin" else (ex, ex)
    first = {"hue0": start.out["r"], "sat0": start.out["g"], "lum0": start.out["b"]}
    if inverse:
        fx = _added(curves["hue_fx"]).inverse("hue0") if "hue_fx" in curves else ex("hue0")
        second = {"hue1": turn(fx), "sat2": greatest("sat0", 0.0)}
        third = {"hue2": undo("hue_hue", "hue1")}
        fourth = {"hue2": turn("hue2"), "sl": gain("sat_lum", ex("sat2"))}
        fifth = {"hl": ex(1.0) - (ex(1.0) - gain("hue_lum", ex("hue2"))) * least("sat2", 1.0)}
        if style == "lin":
            sixth = {"lum1": undo("lum_lum", shown(ex("lum0") / greatest(ex("hl") * "sl", 0.01)))}
        else:
            sixth = {"lum1": undo("lum_lum", ex("lum0") - (ex("hl") + "sl" - 2.0) * 0.1)}
        seventh = {"sat1": undo("sat_sat", ex("sat2") / greatest(gain("lum_sat", ex("lum1")) * gain("hue_sat", ex("hue2")), 0.01))}
        rename = {"r": ex("hue2"), "g": greatest("sat1", 0.0), "b": light("lum1")}
        return Op(back.out, *start.steps, first, second, third, fourth, fifth, sixth, seventh, rename, *back.steps)
    second = {"hue1": get("hue_hue", ex("hue0"), ex("hue0")), "sat1": greatest(get("sat_sat", ex("sat0"), ex("sat0")), 0.0), "hl": gain("hue_lum", ex("hue0")), "lum1": shown("lum0")}
    third = {"sat2": ex("sat1") * gain("lum_sat", ex("lum1")) * gain("hue_sat", ex("hue0"))}
    fade, sl = ex(1.0) - (ex(1.0) - "hl") * least("sat2", 1.0), gain("sat_lum", ex("sat2"))
    curved = light(get("lum_lum", ex("lum1"), ex("lum1")))
    fourth = {"lum2": curved * fade * sl if style == "lin" else curved + (sl + fade - 2.0) * 0.1}
    turned = turn("hue1")
    fifth = {"hue2": turned + get("hue_fx", turned, ex(0.0))}
    rename = {"r": ex("hue2"), "g": ex("sat2"), "b": ex("lum2")}
    # The way back reads r, g and b as hue, saturation and luma.
    return Op(back.out, *start.steps, first, second, third, fourth, fifth, rename, *back.steps)


def line_through(points, slope_above: float, inverse: bool = False):
    """Straight lines between points, level below the first and of a given slope above the last."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]

    def curve(v):
        v = ex(v)
        a, b = (ys, xs) if inverse else (xs, ys)
        cases = [(v < a[0], ex(b[0]))]
        cases += [(v < a[i + 1], (v - a[i]) * ((b[i + 1] - b[i]) / (a[i + 1] - a[i])) + b[i]) for i in range(len(a) - 1)]
        return when(*cases, (v - a[-1]) * (1 / slope_above if inverse else slope_above) + b[-1])

    return curve


def gamma_log(mirror=0.0, break_point=1 / 12, gamma_power=0.5, gamma_slope=math.sqrt(3.0), gamma_offset=0.0, base=math.e, log_slope=0.17883277,
              log_offset=0.55991073, lin_slope=12.0, lin_offset=-0.28466892, inverse=False):
    """A power below a break, a logarithm above, mirrored (the defaults are HLG's); or back."""

    def encode(v):
        t = ex(v) - mirror
        e = when((t < 0.0, -t), t) + mirror
        y = when(
            (e < break_point, power(greatest(e + gamma_offset, 0.0), gamma_power) * gamma_slope),
            ln(greatest(e * lin_slope + lin_offset, 1e-300)) * (log_slope / math.log(base)) + log_offset,
        )
        return when((t < 0.0, -y), y)

    def decode(v):
        v = ex(v)
        y = when((v < 0.0, -v), v)
        e = when(
            (y < gamma_slope * (break_point + gamma_offset) ** gamma_power, power(y / gamma_slope, 1 / gamma_power) - gamma_offset),
            (power(float(base), (y - log_offset) / log_slope) - lin_offset) / lin_slope,
        )
        return when((v < 0.0, -(e - mirror)), e - mirror) + mirror

    return decode if inverse else encode


def double_log(base=10.0, break1=-0.1, break2=0.1, log1=(-0.3, 0.2, -1.0, 0.5), log2=(0.3, 0.8, 1.0, 0.5), lin=(0.5, 0.5), inverse=False):
    """A logarithm, a line, a logarithm; each log is (slope, offset, slope of its argument, offset of its argument); or back."""

    def encode(v):
        x = ex(v)
        one = lambda p: ln(greatest(x * p[2] + p[3], 1e-300)) * (p[0] / math.log(base)) + p[1]
        return when((x < break1, one(log1)), (x < break2, x * lin[0] + lin[1]), one(log2))

    def decode(v):
        y = ex(v)
        one = lambda p: (power(float(base), (y - p[1]) / p[0]) - p[3]) / p[2]
        return when((y < break1 * lin[0] + lin[1], one(log1)), (y < break2 * lin[0] + lin[1], (y - lin[1]) / lin[0]), one(log2))

    return decode if inverse else encode
