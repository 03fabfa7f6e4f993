"""Resampling: every target pixel names its taps in the source, meets them in one equi-join and sums them.

A map gives the source place (sx, sy) of each target pixel as expressions of its x
and y. Taps outside the source follow the wrap mode: black ones are missing,
clamped, periodic and mirrored ones are brought inside.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.expr import Ex, absolute, atan2, clamp, cos, ex, floor, greatest, integer, least, power, sin, sqrt, when
from .geometry import grid
from .image import KEYS, Img, Roi


def wrapped(at: Ex, low: int, high: int, mode: str) -> Ex:
    """An integer coordinate brought into [low, high) by a wrap mode (black leaves it)."""
    n = high - low
    if mode == "black":
        return at
    if mode == "clamp":
        return Ex(f"greatest({low}, least({high - 1}, {at.sql}))")
    turn = lambda a, m: f"((({a}) % {m} + {m}) % {m})"
    if mode == "periodic":
        return Ex(f"({low} + {turn(f'{at.sql} - {low}', n)})")
    if mode == "mirror":
        t = turn(f"{at.sql} - {low}", 2 * n)
        return Ex(f"({low} + CASE WHEN {t} < {n} THEN {t} ELSE {2 * n - 1} - {t} END)")
    raise ValueError(mode)


def tap_weights(kind: str, t: Ex) -> list[tuple[int, Ex]]:
    """(offset, weight) of the taps at fraction `t`."""
    if kind == "nearest":
        return [(0, ex(1.0))]
    if kind == "bilinear":
        return [(0, ex(1.0) - t), (1, t)]
    if kind == "bicubic":  # Catmull-Rom
        return [
            (-1, ((t * -0.5 + 1.0) * t - 0.5) * t),
            (0, (t * 1.5 - 2.5) * t * t + 1.0),
            (1, ((t * -1.5 + 2.0) * t + 0.5) * t),
            (2, (t * 0.5 - 0.5) * t * t),
        ]
    raise ValueError(kind)


class Map:
    """Source places of target pixels, with the taps and weights that follow from them."""

    def __init__(self, sx, sy, kind: str = "bilinear", wrap: str = "black", valid=None):
        self.sx, self.sy, self.kind, self.wrap, self.valid = ex(sx), ex(sy), kind, wrap, valid

    def taps(self, src: Roi) -> list[tuple[Ex, Ex, Ex]]:
        """(y, x, weight) of each tap, over columns sx and sy."""
        x0, y0 = integer("sx"), integer("sy")
        tx, ty = ex("sx") - floor("sx"), ex("sy") - floor("sy")
        out = []
        for dy, wy in tap_weights(self.kind, ty):
            for dx, wx in tap_weights(self.kind, tx):
                out.append((
                    wrapped(Ex(f"({y0.sql} + {dy})"), src.y0, src.y1, self.wrap), wrapped(Ex(f"({x0.sql} + {dx})"), src.x0, src.x1, self.wrap), wy * wx,
                ))
        return out


def sampled(img: Img, target: Roi, m: Map, extra=None) -> Img:
    """`img` seen through a map onto the box `target`. `extra` joins columns that the map reads."""
    dst = grid(img, target)
    if extra is not None:
        dst = dst.join(extra, list(KEYS))
    places = dst.select(*KEYS, m.sx.col.alias("sx"), m.sy.col.alias("sy"), *([ex(m.valid).col.alias("ok")] if m.valid is not None else []))
    if m.valid is not None:
        rest = places.where(~F.col("ok")).select(*KEYS)
        places = places.where("ok")
    taps = F.array(*[F.struct(ty.col.alias("ty"), tx.col.alias("tx"), w.col.alias("w")) for ty, tx, w in m.taps(img.roi)])
    rows = places.select(*KEYS, F.explode(taps).alias("t")).select(*KEYS, F.col("t.ty").alias("ty"), F.col("t.tx").alias("tx"), F.col("t.w").alias("w"))
    src = img.df.select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx"), *img.channels)
    met = rows.join(src, ["image_id", "ty", "tx"], "left")
    out = met.groupBy(*KEYS).agg(*[F.coalesce(F.sum(F.col("w") * F.col(c)), F.lit(0.0)).alias(c) for c in img.channels])
    if m.valid is not None:
        out = out.unionByName(rest.select(*KEYS, *[F.lit(0.0).alias(c) for c in img.channels]))
    return Img(out, target, img.channels)


def sampled_sql(source: str, channels, src: Roi, target: Roi, m: Map, places: str | None = None) -> str:
    """The same as a query; `places` may give (image_id, y, x) and what the map reads."""
    at = places or (
        f"SELECT image_id, CAST(gy.v AS INT) AS y, CAST(gx.v AS INT) AS x FROM (SELECT DISTINCT image_id FROM ({source}) AS i0) AS i1, "
        f"range({target.y0}, {target.y1}) AS gy(v), range({target.x0}, {target.x1}) AS gx(v)"
    )
    placed = f"SELECT image_id, y, x, {m.sx.sql} AS sx, {m.sy.sql} AS sy, {ex(m.valid).sql if m.valid is not None else 'TRUE'} AS ok FROM ({at}) AS pl"
    taps = " UNION ALL ".join(
        f"SELECT image_id, y, x, {ty.sql} AS ty, {tx.sql} AS tx, {w.sql} AS w FROM placed WHERE ok" for ty, tx, w in m.taps(src)
    )
    sums = ", ".join(f"coalesce(sum(w * s.{c}), CAST(0.0 AS DOUBLE)) AS {c}" for c in channels)
    zero = ", ".join(f"CAST(0.0 AS DOUBLE) AS {c}" for c in channels)
    return (
        f"WITH placed AS MATERIALIZED ({placed}), taps AS ({taps}), src AS ({source}) "
        f"SELECT t.image_id, t.y, t.x, {sums} FROM taps AS t LEFT JOIN src AS s ON t.image_id = s.image_id AND t.ty = s.y AND t.tx = s.x "
        f"GROUP BY t.image_id, t.y, t.x UNION ALL SELECT image_id, y, x, {zero} FROM placed WHERE NOT ok"
    )


def resize_map(src: Roi, width: int, height: int, kind: str = "bilinear") -> Map:
    """Pixel centres of the target onto the source, borders clamped."""
    shift = 0.0 if kind == "nearest" else 0.5
    at = lambda c, n, m, low: (ex(c).cast("DOUBLE") + 0.5) * (n / m) - shift + float(low)
    return Map(at("x", src.width, width, src.x0), at("y", src.height, height, src.y0), kind, "clamp")


def resize(img: Img, width: int, height: int, kind: str = "bilinear") -> Img:
    return sampled(img, Roi(0, width, 0, height), resize_map(img.roi, width, height, kind))


#: Supports of the separable filters.
SUPPORT = {"bilinear": 1.0, "mitchell": 2.0, "lanczos3": 3.0}


def filter_weight(name: str, x) -> np.ndarray:
    x = np.abs(np.asarray(x, float))
    if name == "bilinear":
        return np.maximum(0.0, 1 - x)
    if name == "mitchell":
        b = c = 1 / 3
        near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
        far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
        return np.where(x < 1, near, np.where(x < 2, far, 0.0))
    return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def filter_taps(n: int, m: int, name: str) -> list[tuple[int, int, float]]:
    """(source, target, weight) along one axis of a separable resize, clamped and normalised."""
    scale = n / m
    stretch = max(1.0, scale)
    reach = math.ceil(SUPPORT[name] * stretch) + 1
    t = np.arange(m)
    centre = (t + 0.5) * scale - 0.5
    s = np.floor(centre).astype(int)[:, None] + np.arange(-reach, reach + 1)
    w = filter_weight(name, (s - centre[:, None]) / stretch)
    # Taps beyond the ends fall on the end pixels, and those on one pixel add up.
    cells, place = np.unique(t[:, None] * n + np.clip(s, 0, n - 1), return_inverse=True)
    sums = np.bincount(place.ravel(), w.ravel())
    totals = np.bincount(cells // n, sums, m)
    kept = sums != 0
    return list(zip((cells % n)[kept].tolist(), (cells // n)[kept].tolist(), (sums / totals[cells // n])[kept].tolist(), strict=True))


#: Taps of an axis that are broadcast at most, some 24 bytes each; more join in a shuffle.
MOST_TAPS = 1 << 20


def resize_filtered(img: Img, width: int, height: int, name: str = "lanczos3") -> Img:
    """Separable: one pass along x, one along y, each a join with a tap table of the axis's size and a sum."""
    spark = img.df.sparkSession
    df = img.df
    for axis, other, n, m, low in (("x", "y", img.roi.width, width, img.roi.x0), ("y", "x", img.roi.height, height, img.roi.y0)):
        found = filter_taps(n, m, name)
        taps = spark.createDataFrame(found, "s int, t int, w double")
        df = (
            df.withColumn("s", F.col(axis) - low)
            .join(F.broadcast(taps) if len(found) <= MOST_TAPS else taps, "s")
            .groupBy("image_id", F.col(other), F.col("t").alias("at"))
            .agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in img.channels])
            .select("image_id", other, F.col("at").alias(axis), *img.channels)
        )
    df = df.select("image_id", (F.col("y")).cast("int").alias("y"), F.col("x").cast("int").alias("x"), *img.channels)
    return Img(df, Roi(0, width, 0, height), img.channels)


def affine_map(inverse, wrap: str = "black", kind: str = "bilinear") -> Map:
    """A 3 x 3 homogeneous inverse map."""
    m = np.asarray(inverse, float).reshape(3, 3)
    row = lambda i: ex("x").cast("DOUBLE") * m[i, 0] + ex("y").cast("DOUBLE") * m[i, 1] + m[i, 2]
    w = row(2)
    ok = absolute(w) > 1e-10
    safe = when((ok, w), 1.0)
    return Map(row(0) / safe, row(1) / safe, kind, wrap, ok)


def translation(dx: float, dy: float) -> np.ndarray:
    return np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]])


def scaling(sx: float, sy: float) -> np.ndarray:
    return np.diag([sx, sy, 1.0])


def shear(kx: float, ky: float) -> np.ndarray:
    return np.array([[1, kx, 0], [ky, 1, 0], [0, 0, 1.0]])


def composed(*maps) -> np.ndarray:
    """The map that applies the first, then the second and so on."""
    out = np.eye(3)
    for m in maps:
        out = np.asarray(m, float) @ out
    return out


def rotation(angle: float, roi: Roi) -> np.ndarray:
    """The inverse map of a turn by `angle` (radians) about the centre of a box."""
    cx, cy = (roi.x0 + roi.x1 - 1) / 2, (roi.y0 + roi.y1 - 1) / 2
    c, s = math.cos(angle), math.sin(angle)
    return np.array([[c, s, cx - c * cx - s * cy], [-s, c, cy + s * cx - c * cy], [0, 0, 1]])


def warp(img: Img, inverse, wrap: str = "black", kind: str = "bilinear") -> Img:
    return sampled(img, img.roi, affine_map(inverse, wrap, kind))


def rotate(img: Img, angle: float, kind: str = "bilinear") -> Img:
    return warp(img, rotation(angle, img.roi), "black", kind)


def whole_turn(r: Roi, degrees: float) -> tuple[Map, Roi]:
    """The map of a turn onto a box that holds all of `r`, valid where it meets the image."""
    a = math.radians(degrees)
    c, s = abs(math.cos(a)), abs(math.sin(a))
    w, h = math.ceil(r.width * c + r.height * s - 1e-9), math.ceil(r.width * s + r.height * c - 1e-9)
    turned = np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
    m = affine_map(translation(r.x0 + (r.width - 1) / 2, r.y0 + (r.height - 1) / 2) @ turned @ translation(-(w - 1) / 2, -(h - 1) / 2), "clamp")
    eps = 1e-6
    inside = (m.sx >= r.x0 - eps) & (m.sx <= r.x1 - 1 + eps) & (m.sy >= r.y0 - eps) & (m.sy <= r.y1 - 1 + eps)
    return Map(m.sx, m.sy, "bilinear", "clamp", inside), Roi(0, w, 0, h)


def rotate_whole(img: Img, degrees: float, background=(0.0,)) -> Img:
    """A turn whose result holds the whole image; what it doesn't cover takes a background colour."""
    marked = img.select({**{k: F.col(k) for k in img.channels}, "covered": F.lit(1.0)})
    m, box = whole_turn(img.roi, degrees)
    out = sampled(marked, box, m)
    fill = [float(background[min(i, len(background) - 1)]) for i in range(len(img.channels))]
    return out.select({k: F.when(F.col("covered") > 0, F.col(k)).otherwise(f) for k, f in zip(img.channels, fill, strict=True)})


def st_map(roi: Roi, flip_s: bool = False, flip_t: bool = False, wrap: str = "black") -> Map:
    """Places named by channels s and t in [0, 1]."""
    s = ex(1.0) - "s" if flip_s else ex("s")
    t = ex(1.0) - "t" if flip_t else ex("t")
    return Map(s * float(roi.width) + float(roi.x0), t * float(roi.height) + float(roi.y0), "bilinear", wrap)


def st_warp(img: Img, st: Img, **how) -> Img:
    return sampled(img, img.roi, st_map(img.roi, **how), st.df.select(*KEYS, "s", "t"))


def _centred(roi: Roi, f, **how) -> Map:
    """A map in coordinates from -1 to 1 around the centre: `f` of (u, v, radius) gives the source's."""
    w, h = roi.width, roi.height
    u = (ex("x").cast("DOUBLE") - float(roi.x0)) * (2 / max(1, w - 1)) - 1.0
    v = (ex("y").cast("DOUBLE") - float(roi.y0)) * (2 / max(1, h - 1)) - 1.0
    su, sv = f(u, v, sqrt(u * u + v * v))
    back = lambda c, n, low: (c + 1.0) * ((n - 1) / 2) + float(low)
    return Map(back(su, w, roi.x0), back(sv, h, roi.y0), "bilinear", how.get("wrap", "black"))


def _radial(factor):
    return lambda u, v, r: (u * factor(r), v * factor(r))


def barrel(roi: Roi, k1: float, k2: float = 0.0) -> Map:
    return _centred(roi, _radial(lambda r: r * r * abs(k1) + r * r * r * r * abs(k2) + 1.0))


def pincushion(roi: Roi, k1: float, k2: float = 0.0) -> Map:
    return _centred(roi, _radial(lambda r: r * r * -abs(k1) + r * r * r * r * -abs(k2) + 1.0))


def fisheye(roi: Roi, strength: float) -> Map:
    bend = max(math.sin(strength), 0.001)
    return _centred(roi, _radial(lambda r: when((r > 1e-6, sin(r * strength) / bend / when((r > 1e-6, r), 1.0)), 1.0)))


def twist(roi: Roi, degrees: float, radius: float) -> Map:
    def turn(u, v, r):
        angle = when((r < radius, (ex(1.0) - r / radius) * math.radians(degrees)), 0.0)
        return u * cos(angle) - v * sin(angle), u * sin(angle) + v * cos(angle)

    return _centred(roi, turn)


def wave(roi: Roi, amplitude: float, frequency: float) -> Map:
    """Rows displaced sideways by a sine of their height."""
    w, h = roi.width, roi.height
    v = (ex("y").cast("DOUBLE") - float(roi.y0)) / float(h)
    sx = ex("x").cast("DOUBLE") + sin(v * (2 * math.pi * frequency)) * (amplitude * w)
    return Map(clamp(sx, float(roi.x0), float(roi.x1 - 1)), ex("y").cast("DOUBLE"), "bilinear", "clamp")


def spherize(roi: Roi, strength: float, radius: float) -> Map:
    def bulge(u, v, r):
        t = least(greatest(r / radius, 1e-9), 1.0)
        k = when((r < radius, power(t, strength)), 1.0)
        return u * k, v * k

    return _centred(roi, bulge)


def ripple(roi: Roi, amplitude: float, frequency: float, decay: float) -> Map:
    from ..functions.expr import exp

    def rings(u, v, r):
        moved = r + sin(r * (2 * math.pi * frequency)) * amplitude * exp(r * -decay)
        k = when((r > 1e-6, moved / when((r > 1e-6, r), 1.0)), 1.0)
        return u * k, v * k

    return _centred(roi, rings)


# Texture lookups


def lookup_map(roi: Roi, wrap: str = "periodic") -> Map:
    """Texture coordinates u, v in [0, 1], bilinear between pixel centres."""
    return Map(ex("u") * float(roi.width) - 0.5 + float(roi.x0), ex("v") * float(roi.height) - 0.5 + float(roi.y0), "bilinear", wrap)


def mip_level(dudx, dvdx, dudy, dvdy, levels: int) -> Ex:
    """The pyramid level of a footprint given by derivatives in pixels."""
    from ..functions.expr import log2

    size = greatest(sqrt(ex(dudx) * dudx + ex(dvdx) * dvdx), sqrt(ex(dudy) * dudy + ex(dvdy) * dvdy))
    return clamp(log2(greatest(size, 1.0)), 0.0, float(levels - 1))


def environment_st(x, y, z) -> tuple[Ex, Ex]:
    """Latitude-longitude texture coordinates of a direction."""
    from ..functions.expr import acos

    n = sqrt(ex(x) * x + ex(y) * y + ex(z) * z)
    safe = when((n < 1e-10, 1.0), n)
    return (atan2(z, x) / math.pi + 1.0) / 2.0, acos(clamp(ex(y) / safe, -1.0, 1.0)) / math.pi


# Pyramids


def halved(img: Img) -> Img:
    """The next pyramid level: means of 2 x 2 pixels; an odd last row or column of a side over 1 is dropped."""
    r = img.roi
    w, h = max(1, r.width // 2), max(1, r.height // 2)
    x, y = F.floor((F.col("x") - r.x0) / (2 if r.width > 1 else 1)), F.floor((F.col("y") - r.y0) / (2 if r.height > 1 else 1))
    kept = img.df.select("image_id", y.cast("int").alias("y"), x.cast("int").alias("x"), *img.channels).where((F.col("x") < w) & (F.col("y") < h))
    out = kept.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in img.channels])
    return Img(out, Roi(0, w, 0, h), img.channels)


def mip_levels(width: int, height: int) -> int:
    return 1 + int(math.floor(math.log2(max(width, height))))


def mip_factor(n: int, level: int) -> int:
    """Pixels of the base along one axis in a pixel of a level; an axis stops halving at length 1."""
    return 2 ** min(level, int(math.floor(math.log2(n))))


def mip_pyramid(img: Img):
    """All levels in one table, with column `level`.

    A level's pixel is the mean of 2 x 2 pixels below it, so the mean of all base pixels in its block: every base pixel
    is sent to its block on each level in one pass, and summed up before the one shuffle.
    """
    r, n = img.roi, mip_levels(img.roi.width, img.roi.height)
    base = img.df.select(F.lit(0).alias("level"), *KEYS, *img.channels)
    if n == 1:
        return base
    blocks = []
    for i in range(1, n):
        fx, fy = mip_factor(r.width, i), mip_factor(r.height, i)
        x, y = F.floor((F.col("x") - r.x0) / fx).cast("int"), F.floor((F.col("y") - r.y0) / fy).cast("int")
        inside = (x < max(1, r.width >> i)) & (y < max(1, r.height >> i))
        blocks.append(F.when(inside, F.struct(F.lit(i).alias("level"), y.alias("y"), x.alias("x"))))
    spread = img.df.select("image_id", *img.channels, F.explode(F.array_compact(F.array(*blocks))).alias("b"))
    means = spread.groupBy(F.col("b.level").alias("level"), "image_id", F.col("b.y").alias("y"), F.col("b.x").alias("x")).agg(
        *[F.avg(c).alias(c) for c in img.channels]
    )
    return base.unionByName(means)
