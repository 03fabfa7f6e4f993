"""The second-generation ACES rendering in a colour appearance space: J (lightness), M (colourfulness), h (hue).

A colour goes to J, M and h; J through a tone scale for the peak luminance, M through a compression that depends on lightness
and hue, then both along lines towards a focus into the hull of the limiting gamut. Numbers
that depend on hue alone stand in tables that numpy makes on the driver: how far the reach gamut goes at peak lightness, the
cusps of the limiting gamut with a knot at every corner, and how its hull bends above them.

Each formula is written once over a set of operations `xp`: `_Columns` makes steps of a projection
(and of SQL) of it, `_Arrays` computes with numpy.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np

from . import gamut
from .color import RGB
from .expr import Ex, Op, absolute, at, atan2, cos, dot, ex, floor, greatest, integer, least, log10, numbers, power, sin, sqrt, when

#: Chromaticities of the cones' primaries and white. Fixed values.
CONES = ((0.8336, 0.1735), (2.3854, -1.4659), (0.087, -0.125), (0.333, 0.333))
#: Exponent, offset and scale of the response curve; adapting luminance, background, surround (c, Nc), luminance of 1.0. Fixed values.
POWER, OFFSET, SCALE = 0.42, 27.13, 400.0
ADAPTING, BACKGROUND, SURROUND_C, SURROUND_NC, UNIT = 100.0, 20.0, 0.59, 0.9, 100.0
#: Chroma: compression and expansion with their factors of the peak's logarithm, and a threshold. Fixed values.
COMPRESS, COMPRESS_PEAK, EXPAND, EXPAND_PEAK, EXPAND_FROM = 2.4, 3.3, 1.3, 0.69, 0.5
#: Gamut: smoothing of cusps, blends towards the middle, focus distance and its factor of the peak, where compression begins. Fixed values.
SMOOTH, SMOOTH_M, CUSP_BLEND, GAIN_BLEND, FOCUS, FOCUS_PEAK, BEGIN = 0.12, 0.27, 1.3, 0.3, 1.35, 1.75, 0.75
#: The greatest hue that is still below a whole turn.
LAST_HUE = 359.9999999999
#: Cosines and sines of the hue and its multiples by which chroma is normalised, and the constant. Fixed values.
NORM_COS, NORM_SIN, NORM = (11.34072, 16.46899, 7.88380), (14.66441, -6.37224, 9.19364), 77.12896


class _Columns:
    """Operations on columns; `keep` gives a value a column of its own."""

    power, sqrt, absolute, cos, sin, atan2, log10 = map(staticmethod, (power, sqrt, absolute, cos, sin, atan2, log10))
    maximum, minimum, floor = map(staticmethod, (greatest, least, floor))

    def __init__(self, prefix: str = "k"):
        self.prefix, self.steps = prefix, []

    def keep(self, *values):
        names = [f"{self.prefix}{len(self.steps)}_{i}" for i in range(len(values))]
        self.steps.append(dict(zip(names, map(ex, values), strict=True)))
        out = [ex(n) for n in names]
        return out if len(out) > 1 else out[0]

    @staticmethod
    def where(condition, a, b) -> Ex:
        return when((condition, a), b)

    @staticmethod
    def both(a, b) -> Ex:
        return ex(a) & b

    @staticmethod
    def taken(table: np.ndarray, index) -> Ex:
        return at(numbers(table.tolist()), integer(index))

    @staticmethod
    def dot(row, values) -> Ex:
        return dot(row, values)


class _Arrays:
    """The same on numpy arrays."""

    power, sqrt, absolute, cos, sin, atan2, log10 = map(staticmethod, (np.power, np.sqrt, np.abs, np.cos, np.sin, np.arctan2, np.log10))
    maximum, minimum, floor, where, both = map(staticmethod, (np.maximum, np.minimum, np.floor, np.where, np.logical_and))

    @staticmethod
    def keep(*values):
        return list(values) if len(values) > 1 else values[0]

    @staticmethod
    def taken(table: np.ndarray, index):
        return table[np.clip(np.asarray(index, int), 0, len(table) - 1)]

    @staticmethod
    def dot(row, values):
        return sum(w * v for w, v in zip(row, values, strict=True))


@dataclass(frozen=True)
class ToneScale:
    """The tone curve for a peak luminance in nits."""

    peak: float = 100.0

    def numbers(self) -> dict[str, float]:
        n, unit, g, grey, grey_out, flare, warm = self.peak, 100.0, 1.15, 0.18, 10.013, 0.04, 0.14
        hit = 128.0 + (896.0 - 128.0) * math.log(n / unit) / math.log(10000.0 / 100.0)
        m0 = n / unit
        m1 = 0.5 * (m0 + math.sqrt(m0 * (m0 + 4 * flare)))
        lift = lambda w: ((hit / m1) / (hit / m1 + w)) ** g
        m = m1 / lift(1.0)
        target = grey_out / unit * (1 + math.log2(n / 100.0) * warm)
        inner = 0.5 * (target + math.sqrt(target * (target + 4 * flare)))
        root = (inner / m) ** (1 / g)
        w2 = grey / (-(m1 * root) / (root - 1))
        return {"g": g, "t": flare, "s2": w2 * m1, "m2": m1 / lift(w2), "unit": unit, "grey": target, "hit": hit, "top": n / (lift(w2) * unit), "log": math.log10(n / unit)}

    def forward(self, y, xp=_Columns):
        """Scene luminance (1.0 is diffuse white) to display luminance in units of 100 nits."""
        k = self.numbers()
        x = xp.maximum(y, 0.0)
        f = xp.power(x / (x + k["s2"]), k["g"]) * k["m2"]
        return xp.maximum(f * f / (f + k["t"]), 0.0)

    def inverse(self, y, xp=_Columns):
        k = self.numbers()
        h = xp.minimum(xp.maximum(y, 0.0), k["top"])
        f = (h + xp.sqrt(h * (h + 4 * k["t"]))) / 2.0
        root = xp.minimum(xp.power(f / k["m2"], 1 / k["g"]), 0.999999999)
        return root * k["s2"] / (root * -1.0 + 1.0)


@functools.cache
def _model(primaries: str) -> dict:
    """Numbers of the appearance model for colours in a gamut, seen under its own white."""
    to_xyz = gamut.rgb_to_xyz(primaries)
    cone = np.linalg.inv(gamut.matrix_of(*CONES))
    k = 1 / (5 * ADAPTING + 1)
    level = 0.2 * k**4 * 5 * ADAPTING + 0.1 * (1 - k**4) ** 2 * (5 * ADAPTING) ** (1 / 3)
    white = cone @ to_xyz @ np.ones(3) * UNIT
    forward = np.diag(level / UNIT * (to_xyz @ np.ones(3))[1] * UNIT / white) @ cone @ to_xyz * UNIT  # the illuminant is discounted fully
    opponent = np.array(((2.0, 1.0, 1 / 20), (1.0, -12 / 11, 1 / 11), (1 / 9, 1 / 9, -2 / 9))) * SCALE
    respond = _respond(np.full(3, level), _Arrays)
    opponent[0] /= opponent[0] @ respond
    opponent[1:] *= 43.0 * SURROUND_NC
    z = 1.48 + math.sqrt(BACKGROUND / UNIT)
    return {
        "forward": forward, "back": np.linalg.inv(forward), "level": level / UNIT, "opponent": opponent, "opponent_back": np.linalg.inv(opponent),
        "power": SURROUND_C * z, "white": float(_respond(np.array(level), _Arrays)),
    }


def _safe(v, xp):
    """A divisor that isn't zero."""
    return xp.where(xp.absolute(v) > 1e-30, v, 1e-30)


def _respond(v, xp):
    p = xp.power(xp.absolute(v), POWER)
    return p / (p + OFFSET) * xp.where(v < 0.0, -1.0, 1.0)


def _unrespond(v, xp):
    a = xp.minimum(xp.absolute(v), 0.99)
    return xp.power(a * OFFSET / (a * -1.0 + 1.0), 1 / POWER) * xp.where(v < 0.0, -1.0, 1.0)


def _to_jmh(k: dict, rgb, xp):
    """J, M and h (degrees) of a colour, and its achromatic response."""
    cones = xp.keep(*(xp.dot(row, rgb) for row in k["forward"]))
    shown = xp.keep(*(_respond(c, xp) for c in cones))
    a, b1, b2 = xp.keep(*(xp.dot(row, shown) for row in k["opponent"]))
    lit = a > 0.0
    angle = xp.keep(xp.atan2(b2, b1) * (180 / math.pi))
    return [
        *xp.keep(
            xp.where(lit, xp.power(xp.maximum(a, 0.0), k["power"]) * 100.0, 0.0), xp.where(lit, xp.sqrt(b1 * b1 + b2 * b2), 0.0),
            xp.where(lit, xp.minimum(xp.where(angle < 0.0, angle + 360.0, angle), LAST_HUE), 0.0),
        ), a,
    ]


def _from_jmh(k: dict, j, m, h, xp):
    radians = h * (math.pi / 180)
    a = xp.keep(xp.power(xp.maximum(j / 100.0, 0.0), 1 / k["power"]), m * xp.cos(radians), m * xp.sin(radians))
    shown = xp.keep(*(xp.dot(row, a) for row in k["opponent_back"]))
    cones = xp.keep(*(_unrespond(c, xp) for c in shown))
    return [xp.dot(row, cones) for row in k["back"]]


def _lightness(k: dict, y, xp):
    """J of a luminance (1.0 is 100 nits)."""
    return xp.power(_respond(y * (k["level"] * UNIT), xp) / k["white"], k["power"]) * 100.0


def _luminance(k: dict, j, xp):
    return _unrespond(xp.power(xp.maximum(j / 100.0, 0.0), 1 / k["power"]) * k["white"], xp) / (k["level"] * UNIT)


class Rendering:
    """Numbers and tables of the rendering for a peak luminance and a limiting gamut."""

    def __init__(self, peak: float, limit: str):
        self.peak, self.limit = peak, limit
        self.tone, n = ToneScale(peak), ToneScale(peak).numbers()
        self.into, self.out, self.reach = _model("aces_ap0"), _model(limit), _model("aces_ap1")
        self.top = float(_lightness(self.into, np.array(peak / UNIT), _Arrays))
        self.gamma = 1 / self.into["power"]
        self.middle = float(_lightness(self.into, np.array(n["grey"]), _Arrays))
        self.focus = FOCUS + FOCUS * FOCUS_PEAK * n["log"]
        self.lower = 1 / (1.14 + 0.07 * n["log"])
        self.saturation, self.threshold = max(0.2, EXPAND - EXPAND * EXPAND_PEAK * n["log"]), EXPAND_FROM / peak
        self.compression, self.scale = COMPRESS + COMPRESS * COMPRESS_PEAK * n["log"], (0.03379 * peak) ** 0.30596 - 0.45135
        self.reaches = np.append(table := self._reaches(), table[0])
        self.hues = self._hues(8 * n["hit"])
        self.cusps = self._cusps()
        self.bends = self._bends()
        steps = np.arange(1, 361) - np.minimum(self.hues[1:361].astype(int), 359)
        #: Where the knot above a hue stands, against its whole degrees.
        self.window = (min(0, int(steps.min())), max(1, int(steps.max()) + 1))

    # Tables

    def _reaches(self) -> np.ndarray:
        """For each whole hue the least M (in hundredths) at peak lightness that the reach gamut doesn't hold."""
        hue, j = np.arange(360.0), np.full(360, self.top)
        beyond = lambda m: np.min(_from_jmh(self.reach, j, m, hue, _Arrays), axis=0) < 0
        high = np.full(360, 50.0)
        while (grow := ~beyond(high) & (high < 1300)).any():
            high = np.where(grow, high + 50, high)
        low = high - 50
        for _ in range(13):
            mid = (low + high) / 2
            out = beyond(mid)
            low, high = np.where(out, low, mid), np.where(out, mid, high)
        return high

    @staticmethod
    def _corners() -> np.ndarray:
        """Red, yellow, green, cyan, blue, magenta."""
        return np.array([[1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 1, 1], [0, 0, 1], [1, 0, 1.0]])

    def _hues(self, brightest: float) -> np.ndarray:
        """Hues of 360 knots (and one around each end): evenly spread between those of the corners of the reach and the limiting gamut."""
        corners, j = self._corners(), self.top
        high, low = np.full(6, brightest), np.zeros(6)
        goal = (j / 100) ** (1 / self.reach["power"])
        while (high - low).max() > 1e-3:
            mid = (low + high) / 2
            under = _to_jmh(self.reach, (corners * mid[:, None]).T, _Arrays)[3] < goal
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        found = np.concatenate([_to_jmh(self.reach, (corners * high[:, None]).T, _Arrays)[2], _to_jmh(self.out, corners.T * self.peak / UNIT, _Arrays)[2]])
        found = np.sort(found)
        found = found[np.concatenate([[True], np.diff(found) > 1e-10])]
        places: list[int] = []
        for h in found.tolist():
            p = min(359, max(math.floor(h + 0.5), places[-1] if places else int(found[0] != 0)))
            if places and p == places[-1]:
                if len(places) > 1 and places[-2] != places[-1] - 1:
                    places[-1] -= 1
                else:
                    p += 1
            places.append(min(p, 359))
        inner = np.interp(np.arange(360), [0, *places, 360], [0.0, *found, 360.0])
        return np.concatenate([[inner[-1] - 360], inner, [inner[0] + 360]])

    def _cusps(self) -> np.ndarray:
        """J and M of the most colourful displayable colour of each knot's hue, found along the edges of the cube."""
        corners = self._corners() * self.peak / UNIT
        at_corner = _to_jmh(self.out, corners.T, _Arrays)[2]
        first = int(at_corner.argmin())
        corners, at_corner = np.roll(corners, -first, axis=0), np.roll(at_corner, -first)
        hue = self.hues[1:361]
        k = (np.searchsorted(at_corner, hue, "right") - 1) % 6
        a, b, start = corners[k], corners[(k + 1) % 6], at_corner[k]
        goal = (hue - start) % 360
        low, high = np.zeros(360), np.ones(360)
        seen = lambda t: _to_jmh(self.out, (a + (b - a) * t[:, None]).T, _Arrays)
        for _ in range(40):
            mid = (low + high) / 2
            turned = (seen(mid)[2] - start + 180) % 360 - 180
            over = turned > goal
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        j, m, *_ = seen((low + high) / 2)
        table = np.stack([j, m * (1 + SMOOTH_M * SMOOTH)], axis=1)
        return np.concatenate([table[-1:], table, table[:1]])

    def _bends(self) -> np.ndarray:
        """For each knot the inverse of the least exponent whose upper hull stays outside the gamut's."""
        j, m = self.cusps[1:361].T
        hue = self.hues[1:361]
        cusp = self._cusp(j, m, _Arrays)

        def outside(exponent: np.ndarray) -> np.ndarray:
            fine = np.ones(360, bool)
            for place in (0.01, 0.1, 0.5, 0.8, 0.99):
                test = j + (self.top - j) * place
                gain = self._gain(test, cusp["from"], _Arrays)
                meet, slope = self._line(test, m, cusp["focus"], gain, _Arrays)
                edge = self._edge(j, m, 1 / exponent, meet, slope, self._meet(j, m, cusp["focus"], gain, _Arrays), _Arrays)
                rgb = np.max(_from_jmh(self.out, meet + slope * edge, edge, hue, _Arrays), axis=0)
                fine &= rgb > self.peak / UNIT
            return fine

        high = np.full(360, 0.4)
        while (grow := ~outside(high) & (high < 5.0)).any():
            high = np.where(grow, high + 0.4, high)
        low = high - 0.4
        low[low < 1e-9] = 1e-9
        while (high - low).max() > 1e-5:
            mid = (low + high) / 2
            out = outside(mid)
            low, high = np.where(out, low, mid), np.where(out, mid, high)
        out = 1 / high
        return np.concatenate([out[-1:], out, out[:1]])

    # Formulas

    def _norm(self, h, xp):
        radians = h * (math.pi / 180)
        c, s = xp.keep(xp.cos(radians), xp.sin(radians))
        cosines = (c, c * c * 2.0 - 1.0, c * c * c * 4.0 - c * 3.0)
        sines = (s, c * s * 2.0, s * 3.0 - s * s * s * 4.0)
        return (xp.dot(NORM_COS, cosines) + xp.dot(NORM_SIN, sines) + NORM) * self.scale

    def _reach_at(self, h, xp):
        i = xp.keep(xp.floor(h))
        a, b = xp.keep(xp.taken(self.reaches, i), xp.taken(self.reaches, i + 1.0))
        return a + (b - a) * (h - i)

    @staticmethod
    def _toe(x, limit, k1, k2, xp, back: bool = False):
        k2 = xp.keep(xp.maximum(k2, 0.001))
        k1 = xp.keep(xp.sqrt(k1 * k1 + k2 * k2))
        k3 = xp.keep((limit + k1) / (limit + k2))
        if back:
            bent = (x * x + k1 * x) / (k3 * (x + k2))
        else:
            b = xp.keep(k3 * x - k1)
            bent = (b + xp.sqrt(xp.maximum(b * b + k2 * k3 * x * 4.0, 0.0))) / 2.0
        return xp.keep(xp.where(x > limit, x, bent))

    def _chroma(self, shown, scene, m, norm, reach, xp, back: bool = False):
        """M for a lightness that the tone scale took from `scene` to `shown`, or back."""
        part = xp.keep(shown / self.top)
        rest = xp.keep(xp.maximum(part * -1.0 + 1.0, 0.0))
        limit = xp.keep(xp.power(xp.maximum(part, 0.0), self.gamma) * reach / norm)
        ratio = xp.keep(xp.power(xp.where(scene > 0.0, xp.maximum(shown, 0.0) / xp.where(scene > 0.0, scene, 1.0), 0.0), self.gamma))
        grown = (rest * self.saturation, xp.sqrt(part * part + self.threshold))
        if back:
            inner = self._toe(m / norm, limit, part * self.compression, rest, xp, True)
            inner = limit - self._toe(limit - inner, limit - 0.001, *grown, xp, True)
            out = inner * norm / xp.where(ratio > 0.0, ratio, 1.0)
        else:
            inner = limit - self._toe(limit - m * ratio / norm, limit - 0.001, *grown, xp)
            out = self._toe(inner, limit, part * self.compression, rest, xp) * norm
        return xp.keep(xp.where(m > 0.0, out, 0.0))

    def _cusp(self, j, m, xp) -> dict:
        blend = xp.minimum(j * (-1.0 / self.top) + CUSP_BLEND, 1.0)
        focus, begin = xp.keep(j + (j * -1.0 + self.middle) * blend, j + (j * -1.0 + self.top) * GAIN_BLEND)
        return {"j": j, "m": m, "focus": focus, "from": begin}

    def _gain(self, j, begin, xp):
        """How flat the lines are on which colours move; flatter near the top."""
        step = xp.log10(xp.maximum((begin * -1.0 + self.top) / xp.maximum(j * -1.0 + self.top, 0.0001), 1e-30))
        return xp.keep(xp.where(j > begin, (step * step + 1.0) * (self.top * self.focus), self.top * self.focus))

    def _meet(self, j, m, focus, gain, xp):
        """The lightness at which the line through (j, m) meets the grey axis."""
        part = xp.keep(m / gain)
        a = xp.keep(part / focus)
        low = xp.keep(part * -1.0 + 1.0)
        high = xp.keep((part + 1.0 + a * self.top) * -1.0)
        c = xp.keep(part * self.top + j)
        below = j * 2.0 / _safe(low + xp.sqrt(xp.maximum(low * low + a * j * 4.0, 0.0)), xp)
        above = c * -2.0 / _safe(high - xp.sqrt(xp.maximum(high * high - a * c * 4.0, 0.0)), xp)
        return xp.keep(xp.where(j < focus, below, above))

    def _line(self, j, m, focus, gain, xp):
        meet = self._meet(j, m, focus, gain, xp)
        slope = xp.where(meet < focus, meet, meet * -1.0 + self.top) * (meet - focus) / (focus * gain)
        return meet, xp.keep(slope)

    @staticmethod
    def _bound(meet, slope, bend, j, m, scale, xp):
        """M where a line meets a curve from black to (j, m)."""
        return scale * xp.power(xp.maximum(meet / scale, 0.0), bend) * m / _safe(j - slope * m, xp)

    def _edge(self, j, m, bend, meet, slope, at_cusp, xp):
        """M at the hull of the limiting gamut: the smooth minimum of its lower and upper curves."""
        low = self._bound(meet, slope, self.lower, j, m, at_cusp, xp)
        high = self._bound(meet * -1.0 + self.top, slope * -1.0, bend, j * -1.0 + self.top, m, at_cusp * -1.0 + self.top, xp)
        low, high = xp.keep(low, high)
        width = m * SMOOTH
        near = xp.keep(xp.maximum(width - xp.absolute(low - high), 0.0) / width)
        return xp.keep(xp.minimum(low, high) - near * near * near * width / 6.0)

    def _knot(self, h, xp):
        """Cusp and bend at a hue, between the knots around it."""
        base = xp.keep(xp.floor(h) + 1.0)
        at_ = base + float(self.window[1])
        for step in range(self.window[1] - 1, self.window[0], -1):
            i = xp.minimum(xp.maximum(base + float(step), 1.0), 361.0)
            at_ = xp.where(xp.taken(self.hues, i) >= h, i, at_)
        i = xp.keep(xp.minimum(xp.maximum(at_, 1.0), 361.0))
        low, high = xp.keep(xp.taken(self.hues, i - 1.0), xp.taken(self.hues, i))
        t = xp.keep((h - low) / _safe(high - low, xp))
        mixed = []
        for table in (self.cusps[:, 0], self.cusps[:, 1], self.bends):
            a, b = xp.keep(xp.taken(table, i - 1.0), xp.taken(table, i))
            mixed.append(a + (b - a) * t)
        return xp.keep(*mixed)

    def _moved(self, j, m, steep, cusp, bend, reach, xp, back: bool):
        """(J, M) along its line into the hull, or out of it; `steep` is the lightness that says how flat the line is."""
        gain = self._gain(steep, cusp["from"], xp)
        meet, slope = self._line(j, m, cusp["focus"], gain, xp)
        edge = self._edge(cusp["j"], cusp["m"], bend, meet, slope, self._meet(cusp["j"], cusp["m"], cusp["focus"], gain, xp), xp)
        far = xp.keep(self._bound(meet, slope, self.gamma, self.top, reach, self.top, xp))
        share = xp.keep(xp.maximum(edge / _safe(far, xp), BEGIN))
        begin = xp.keep(share * edge)
        inner, outer = edge - begin, far - begin
        squeeze = xp.keep(xp.where(xp.both(share < 1.0, edge > 0.0), outer / _safe(outer / _safe(inner, xp) - 1.0, xp), 1.0))
        over = xp.keep((m - begin) / _safe(squeeze, xp))
        bent = xp.where(over >= 1.0, squeeze, squeeze * over / xp.where(over >= 1.0, 1.0, over * -1.0 + 1.0)) if back else squeeze * over / _safe(over + 1.0, xp)
        kept = xp.keep(xp.where(xp.both(m > begin, share < 1.0), begin + bent, m))
        inside = edge > 0.0
        return xp.keep(xp.where(inside, meet + kept * slope, j), xp.where(inside, kept, 0.0))

    def _fitted(self, j, m, h, reach, xp, back: bool = False):
        """J and M inside the limiting gamut, or back from there."""
        cusp_j, cusp_m, bend = self._knot(h, xp)
        cusp = self._cusp(cusp_j, cusp_m, xp)
        steep = j
        if back:
            first, _ = self._moved(j, m, j, cusp, bend, reach, xp, True)
            steep = xp.keep(xp.where(j > cusp["from"], first, j))
        to_j, to_m = self._moved(j, m, steep, cusp, bend, reach, xp, back)
        coloured = xp.both(m > 0.0, j <= self.top)
        return xp.keep(xp.where(j > 0.0, xp.where(coloured, to_j, j), 0.0), xp.where(xp.both(j > 0.0, coloured), to_m, 0.0))

    def forward(self, rgb, xp):
        """ACES2065-1 to linear light of the limiting gamut, 1.0 being 100 nits."""
        j, m, h, a = _to_jmh(self.into, rgb, xp)
        y = _unrespond(xp.maximum(a, 0.0) * self.into["white"], xp) / (self.into["level"] * UNIT)
        shown = xp.keep(_lightness(self.into, xp.keep(self.tone.forward(xp.keep(y), xp)), xp))
        norm, reach = xp.keep(self._norm(h, xp), self._reach_at(h, xp))
        m = self._chroma(shown, j, m, norm, reach, xp)
        j, m = self._fitted(shown, m, h, reach, xp)
        return _from_jmh(self.out, j, m, h, xp)

    def inverse(self, rgb, xp):
        shown, m, h, _ = _to_jmh(self.out, rgb, xp)
        norm, reach = xp.keep(self._norm(h, xp), self._reach_at(h, xp))
        shown, m = self._fitted(shown, m, h, reach, xp, True)
        j = xp.keep(_lightness(self.into, xp.keep(self.tone.inverse(xp.keep(_luminance(self.into, shown, xp)), xp)), xp))
        m = self._chroma(shown, j, m, norm, reach, xp, True)
        return _from_jmh(self.into, j, m, h, xp)


@functools.cache
def rendering(peak: float = 100.0, limit: str = "rec709") -> Rendering:
    return Rendering(float(peak), limit)


def _op(f) -> Op:
    """The operation that `f(rgb, xp)` makes of r, g and b."""
    xp = _Columns()
    out = f([ex(c) for c in RGB], xp)
    return Op({**dict(zip(RGB, out, strict=True)), "a": "a"}, *xp.steps)


def rgb_to_jmh(primaries: str = "aces_ap0") -> Op:
    """r, g, b in a gamut to J, M and h (degrees) in their places."""
    return _op(lambda rgb, xp: _to_jmh(_model(primaries), rgb, xp)[:3])


def jmh_to_rgb(primaries: str = "aces_ap0") -> Op:
    return _op(lambda v, xp: _from_jmh(_model(primaries), *v, xp))


def tone_scaled(peak: float = 100.0, limit: str = "rec709", inverse: bool = False) -> Op:
    """J through the tone scale, M through the compression that goes with it (the limit doesn't matter here); or back."""
    k = rendering(peak, limit)

    def run(v, xp):
        j, m, h = v
        norm, reach = xp.keep(k._norm(h, xp), k._reach_at(h, xp))
        curve = k.tone.inverse if inverse else k.tone.forward
        other = xp.keep(_lightness(k.into, xp.keep(curve(xp.keep(_luminance(k.into, j, xp)), xp)), xp))
        shown, scene = (j, other) if inverse else (other, j)
        return [other, k._chroma(shown, scene, m, norm, reach, xp, inverse), h]

    return _op(run)


def gamut_fitted(peak: float = 100.0, limit: str = "rec709", inverse: bool = False) -> Op:
    """J and M into the limiting gamut, or back."""
    k = rendering(peak, limit)
    return _op(lambda v, xp: [*k._fitted(v[0], v[1], v[2], k._reach_at(v[2], xp), xp, inverse), v[2]])


def output_transform(peak: float = 100.0, limit: str = "rec709", inverse: bool = False) -> list[Op]:
    """ACES2065-1 to linear light in a display gamut, 1.0 being 100 nits; or back."""
    k = rendering(peak, limit)
    return [_op(k.inverse if inverse else k.forward)]


__all__ = ["Rendering", "ToneScale", "gamut_fitted", "jmh_to_rgb", "output_transform", "rendering", "rgb_to_jmh", "tone_scaled"]
