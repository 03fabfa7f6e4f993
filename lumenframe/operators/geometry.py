"""Geometry: pixels get new keys, no pixel meets another.

All maps are exact integer maps of (x, y) within the image's box.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .image import KEYS, Img, Roi


def flip(img: Img) -> Img:
    """Upside down."""
    return img.moved(F.col("x"), img.roi.y0 + img.roi.y1 - 1 - F.col("y"), img.roi)


def flop(img: Img) -> Img:
    """Left to right."""
    return img.moved(img.roi.x0 + img.roi.x1 - 1 - F.col("x"), F.col("y"), img.roi)


def transpose(img: Img) -> Img:
    r = img.roi
    return img.moved(F.col("y"), F.col("x"), Roi(r.y0, r.y1, r.x0, r.x1))


def rotate90(img: Img) -> Img:
    """Clockwise."""
    r = img.roi
    return img.moved(r.height - 1 - (F.col("y") - r.y0), F.col("x") - r.x0, Roi(0, r.height, 0, r.width))


def rotate180(img: Img) -> Img:
    return flip(flop(img))


def rotate270(img: Img) -> Img:
    r = img.roi
    return img.moved(F.col("y") - r.y0, r.width - 1 - (F.col("x") - r.x0), Roi(0, r.height, 0, r.width))


def circular_shift(img: Img, dx: int, dy: int) -> Img:
    r = img.roi
    return img.moved(
        r.x0 + F.pmod(F.col("x") - r.x0 + dx, F.lit(r.width)), r.y0 + F.pmod(F.col("y") - r.y0 + dy, F.lit(r.height)), r
    )


def reorient(img: Img, orientation: int) -> Img:
    """Undo an EXIF orientation, 1 to 8."""
    steps = {2: (flop,), 3: (rotate180,), 4: (flip,), 5: (transpose,), 6: (rotate90,), 7: (flip, rotate90), 8: (rotate270,)}
    for step in steps.get(orientation, ()):
        img = step(img)
    return img


def cut(img: Img, roi: Roi) -> Img:
    """The pixels in `roi`, at their places."""
    return img.crop(roi)


def grid(img: Img, roi: Roi):
    """Every pixel position of `roi` for every image: the ids, one row of each, are expanded."""
    return (
        img.df.select("image_id").distinct()
        .where(F.lit(roi.width > 0 and roi.height > 0))
        .select("image_id", F.explode(F.sequence(F.lit(roi.y0), F.lit(max(roi.y0, roi.y1 - 1)))).alias("y"))
        .select("image_id", "y", F.explode(F.sequence(F.lit(roi.x0), F.lit(max(roi.x0, roi.x1 - 1)))).alias("x"))
    )


def pad(img: Img, top: int, right: int, bottom: int, left: int, fill: float) -> Img:
    """A constant border; the result begins at (0, 0)."""
    inner = img.moved(F.col("x") - img.roi.x0 + left, F.col("y") - img.roi.y0 + top, img.roi)
    roi = Roi(0, img.roi.width + left + right, 0, img.roi.height + top + bottom)
    border = grid(img, roi).where(
        ~((F.col("x") >= left) & (F.col("x") < left + img.roi.width) & (F.col("y") >= top) & (F.col("y") < top + img.roi.height))
    )
    filled = border.select(*KEYS, *[F.lit(float(fill)).alias(c) for c in img.channels])
    return Img(inner.df.unionByName(filled), roi, img.channels)


def tile(img: Img, width: int, height: int) -> Img:
    """Repeated to fill a size: each pixel is copied to all its places."""
    r = img.roi
    xs = F.sequence(F.col("x") - r.x0, F.lit(width - 1), F.lit(r.width))
    ys = F.sequence(F.col("y") - r.y0, F.lit(height - 1), F.lit(r.height))
    inside = img.df.where((F.col("x") - r.x0 < width) & (F.col("y") - r.y0 < height))
    wide = inside.select("image_id", "y", F.explode(xs).alias("x"), *img.channels)
    high = wide.select("image_id", F.explode(ys).alias("y"), "x", *img.channels)
    return Img(high, Roi(0, width, 0, height), img.channels)


def fit_size(width: int, height: int, most_w: int, most_h: int, cover: bool = False) -> tuple[int, int]:
    """The size of the same shape that fits inside a box, or covers it."""
    scale = (max if cover else min)(most_w / width, most_h / height)
    return max(1, round(width * scale)), max(1, round(height * scale))


def channels(img: Img, order: list, names: list[str] | None = None) -> Img:
    """Channels by name or constants, in a new order."""
    names = names or [o if isinstance(o, str) else f"channel{i}" for i, o in enumerate(order)]
    return img.select({n: F.col(o) if isinstance(o, str) else F.lit(float(o)) for n, o in zip(names, order, strict=True)})


def shuffle_pattern(img: Img, pattern: str) -> Img:
    """Channels by a pattern such as BGR, RRR or RGB1; 0 and 1 are constants, a missing alpha is opaque, others black."""
    out = {}
    for i, p in enumerate(pattern.upper()):
        name = "rgba"[i] if i < 4 else f"channel{i}"
        if p in "01":
            out[name] = F.lit(float(p))
        elif p.isdigit():
            at = int(p)
            out[name] = F.col(img.channels[at]) if at < len(img.channels) else F.lit(0.0)
        else:
            out[name] = F.col(p.lower()) if p.lower() in img.channels else F.lit(1.0 if p == "A" else 0.0)
    return img.select(out)



def alpha(img: Img) -> Img:
    """The alpha channel, opaque where there is none."""
    return img.select({"a": F.col("a") if "a" in img.channels else F.lit(1.0)})



def renamed(img: Img, name) -> Img:
    """Channels under the names that `name` makes of their own."""
    return img.select({name(c): F.col(c) for c in img.channels})
