"""Two images together: an equi-join on the pixel, then a projection.

Pixels that one image lacks count as zero (a union of the boxes); `inner` keeps
the common box only. The second image's channels are called r2, g2, b2, a2.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import BINARY, RGB
from ..functions.expr import Ex, Op, absolute, clamp, ex, greatest, least, sqrt, when
from .image import KEYS, Img

ALL = (*RGB, "a")


def paired(a: Img, b: Img, inner: bool = False) -> Img:
    """Both images' channels, the second's with a 2 behind."""
    right = b.df.select(*KEYS, *[F.col(c).alias(f"{c}2") for c in b.channels])
    names = [*a.channels, *(f"{c}2" for c in b.channels)]
    joined = a.df.join(right, list(KEYS), "inner" if inner else "full_outer")
    if not inner:
        joined = joined.select(*KEYS, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    return Img(joined, a.roi.intersect(b.roi) if inner else a.roi.union(b.roi), tuple(names))


def paired_sql(a: str, b: str, channels=ALL, inner: bool = False) -> str:
    """The same join as a query."""
    right = ", ".join(f"{c} AS {c}2" for c in channels)
    names = [*channels, *(f"{c}2" for c in channels)]
    out = ", ".join(names if inner else [f"coalesce({c}, CAST(0.0 AS DOUBLE)) AS {c}" for c in names])
    how = "JOIN" if inner else "FULL JOIN"
    return f"SELECT image_id, y, x, {out} FROM ({a}) AS p {how} (SELECT image_id, y, x, {right} FROM ({b}) AS q0) AS q USING (image_id, y, x)"


def binary(name: str, channels=ALL) -> Op:
    """Channel-wise arithmetic of two images."""
    return Op({c: BINARY[name](ex(c), f"{c}2") for c in channels})


def _both(f, channels=ALL) -> Op:
    return Op({c: f(ex(c), ex(f"{c}2")) for c in channels})


def _straight_over() -> Op:
    keep = ex("a2") * (ex(1.0) - "a")
    out = {c: when((ex("ao") > 0.0, (ex(c) * "a" + ex(f"{c}2") * "kb") / when((ex("ao") > 0.0, "ao"), 1.0)), 0.0) for c in RGB}
    return Op({**out, "a": "ao"}, {"kb": keep}, {"ao": ex("a") + "kb"})


def _premultiplied_over() -> Op:
    return _both(lambda a, b: a + b * (ex(1.0) - "a"))


def _soft(a: Ex, b: Ex, inclusive: bool = True) -> Ex:
    low = (b <= 0.25) if inclusive else (b < 0.25)
    d = when((low, ((b * 16.0 - 12.0) * b + 4.0) * b), sqrt(greatest(b, 0.0)))
    return when((a < 0.5, b - (ex(1.0) - a * 2.0) * b * (ex(1.0) - b)), b + (a * 2.0 - 1.0) * (d - b))


def _hard(a: Ex, b: Ex) -> Ex:
    return when((a < 0.5, a * b * 2.0), ex(1.0) - (ex(1.0) - a) * (ex(1.0) - b) * 2.0)


def _screen(a: Ex, b: Ex) -> Ex:
    return a + b - a * b


#: Porter-Duff and blend operations on (a, b).
COMPOSITES = {
    "over": _straight_over(),
    "over_premultiplied": _premultiplied_over(),
    "in": _both(lambda a, b: a * "a2"),
    "out": _both(lambda a, b: a * (ex(1.0) - "a2")),
    "atop": Op({**{c: ex(c) * "a2" + ex(f"{c}2") * (ex(1.0) - "a") for c in RGB}, "a": "a2"}),
    "xor": Op(
        {**{c: ex(c) * (ex(1.0) - "a2") + ex(f"{c}2") * (ex(1.0) - "a") for c in RGB}, "a": ex("a") + "a2" - ex("a") * "a2" * 2.0}
    ),
    "screen": _both(_screen),
    "multiply": _both(lambda a, b: a * b),
    "overlay": _both(lambda a, b: _hard(b, a)),
    "hardlight": _both(_hard),
    "softlight": _both(_soft),
    "difference": _both(lambda a, b: absolute(a - b)),
    "exclusion": _both(lambda a, b: a + b - a * b * 2.0),
    "colordodge": _both(lambda a, b: when((a >= 1.0, 1.0), least(1.0, b / when((a >= 1.0, 1.0), ex(1.0) - a)))),
    "colorburn": _both(lambda a, b: when((a <= 0.0, 0.0), greatest(0.0, ex(1.0) - (ex(1.0) - b) / when((a <= 0.0, 1.0), a)))),
    "add": _both(lambda a, b: a + b),
}

#: Blend modes that keep the first image's alpha.
BLENDS = {
    "normal": lambda a, b: a,
    "multiply": lambda a, b: a * b,
    "screen": _screen,
    "add": lambda a, b: least(a + b, 1.0),
    "subtract": lambda a, b: greatest(b - a, 0.0),
    "overlay": lambda a, b: _hard(b, a),
    "softlight": lambda a, b: _soft(a, b, False),
    "hardlight": _hard,
    "difference": lambda a, b: absolute(a - b),
    "exclusion": lambda a, b: a + b - a * b * 2.0,
}


def blend(mode: str, opacity: float = 1.0) -> Op:
    """A blend mode over the second image, mixed with it by `opacity`."""
    f = BLENDS[mode]
    return Op({**{c: ex(f"{c}2") + (f(ex(c), ex(f"{c}2")) - f"{c}2") * opacity for c in RGB}, "a": "a"})


def composite(name: str, a: Img, b: Img) -> Img:
    """`a` and `b` under a named composite; `under` is over with the images exchanged."""
    if name == "under":
        return composite("over", b, a)
    return paired(a, b).apply(COMPOSITES[name])


def zover(zero_is_far: bool = True) -> Op:
    """Depth-ordered over of (r, g, b, a, z) images; equal depths take the first in front."""
    depth = lambda z: when((ex(z).eq(0.0), 3.4028234663852886e38), z) if zero_is_far else ex(z)
    names = (*ALL, "z")
    first = ex("fa")
    out = {c: ex(f"f_{c}") + (ex(1.0) - clamp("f_a")) * f"k_{c}" for c in ALL}
    return Op(
        {**out, "z": when((ex("f_a").eq(0.0), "k_z"), "f_z")},
        {"fa": depth("z") <= depth("z2")},
        {**{f"f_{c}": when((first, c), f"{c}2") for c in names}, **{f"k_{c}": when((first, f"{c}2"), c) for c in names}},
    )


def paste(dst: Img, src: Img, dx: int, dy: int, alpha: bool = False) -> Img:
    """`src` put onto `dst` at an offset; pixels outside `dst` are dropped. With `alpha`, over instead of replacing."""
    moved = src.moved(F.col("x") + dx, F.col("y") + dy, src.roi.moved(dx, dy)).crop(dst.roi)
    over = moved.df.select(*KEYS, *[F.col(c).alias(f"s_{c}") for c in src.channels])
    joined = dst.df.join(over, list(KEYS), "left")
    if not alpha:
        return dst_like(dst, joined.select(*KEYS, *[F.coalesce(f"s_{c}", c).alias(c) for c in dst.channels]))
    keep = 1.0 - F.coalesce("s_a", F.lit(0.0))
    return dst_like(dst, joined.select(*KEYS, *[(F.coalesce(f"s_{c}", F.lit(0.0)) + F.col(c) * keep).alias(c) for c in dst.channels]))


def dst_like(dst: Img, df) -> Img:
    return Img(df, dst.roi, dst.channels)
