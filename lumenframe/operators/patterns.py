"""Synthetic images and drawing: positions are generated, colours are expressions of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Ex, Op, clamp, cos, ex, floor, greatest, lerp, ln, sin, sqrt, when
from .image import KEYS, Img, Roi


def blank(spark: SparkSession, roi: Roi, images: int = 1) -> DataFrame:
    """(image_id, y, x) of every position, generated on the executors."""
    n = roi.width * roi.height
    i = F.col("id")
    return spark.range(images * n).select(
        F.expr(f"id div {n}").alias("image_id"),
        (F.expr(f"(id % {n}) div {roi.width}") + roi.y0).cast("int").alias("y"),
        (i % roi.width + roi.x0).cast("int").alias("x"),
    )


def blank_sql(roi: Roi, images: int = 1) -> str:
    return (
        f"SELECT CAST(i.v AS BIGINT) AS image_id, CAST(gy.v AS INT) AS y, CAST(gx.v AS INT) AS x FROM range({images}) AS i(v), "
        f"range({roi.y0}, {roi.y1}) AS gy(v), range({roi.x0}, {roi.x1}) AS gx(v)"
    )


def painted(spark: SparkSession, roi: Roi, op: Op, images: int = 1) -> Img:
    return Img(op.frame(blank(spark, roi, images), list(KEYS)), roi, tuple(op.out))


X, Y = ex("x").cast("DOUBLE"), ex("y").cast("DOUBLE")


def constant(values, names=("r", "g", "b", "a")) -> Op:
    return Op({c: float(values[min(i, len(values) - 1)]) for i, c in enumerate(names)})


def gradient(roi: Roi, top, bottom, names=("r", "g", "b")) -> Op:
    t = (Y - float(roi.y0)) / float(max(1, roi.height - 1))
    return Op({c: lerp(float(a), float(b), t) for c, a, b in zip(names, top, bottom, strict=True)})


def corners(roi: Roi, tl, tr, bl, br, names=("r", "g", "b")) -> Op:
    s, t = (X - float(roi.x0)) / float(max(1, roi.width - 1)), (Y - float(roi.y0)) / float(max(1, roi.height - 1))
    return Op({c: lerp(lerp(float(a), float(b), s), lerp(float(d), float(e), s), t) for c, a, b, d, e in zip(names, tl, tr, bl, br, strict=True)})


def checker(width: int, height: int, one, two, offset=(0, 0), names=("r", "g", "b")) -> Op:
    n = floor((X - float(offset[0])) / float(width)) + floor((Y - float(offset[1])) / float(height))
    odd = (n - floor(n / 2.0) * 2.0).eq(1.0)
    return Op({c: when((odd, float(b)), float(a)) for c, a, b in zip(names, one, two, strict=True)})


def _hashed(seed: int, c: int) -> list[tuple[str, Ex]]:
    """Steps of a 32-bit multiply-and-xor hash of (seed, x, y, 0, c), in 64-bit integers."""
    mask = 0xFFFFFFFF
    steps, now = [], str((seed + 0x811C9DC5) & mask)
    for i, part in enumerate(("x", "y", "0", str(c))):
        name = f"h{c}_{seed & 7}_{i}"
        wide = f"CAST({now} AS BIGINT) * CAST(16777619 AS BIGINT)"
        low = f"(({wide}) & CAST({mask} AS BIGINT))"
        other = f"(CAST({part} AS BIGINT) & CAST({mask} AS BIGINT))"
        steps.append((name, Ex(f"(({low} | {other}) - ({low} & {other}))")))
        now = name
    return steps


def noise(kind: str, a: float, b: float, mono: bool = False, seed: int = 0, names=("r", "g", "b")) -> Op:
    """Deterministic noise from the position: uniform in [a, b), gaussian of mean a and deviation b, or salt of value a and share b."""
    steps: list[dict] = []
    out = {}
    drawn: dict[tuple[int, int], Ex] = {}

    def unit(c: int, s: int) -> Ex:
        if (c, s) not in drawn:
            for name, e in _hashed(s, c):
                steps.append({name: e})
                last = name
            drawn[c, s] = ex(last).cast("DOUBLE") / 4294967295.0
        return drawn[c, s]

    for i, name in enumerate(names):
        c = 0 if mono else i
        r = unit(c, seed)
        if kind == "uniform":
            out[name] = r * (b - a) + a
        elif kind == "salt":
            out[name] = when((r < b, a), 0.0)
        elif kind == "gaussian":
            r2 = unit(c, seed + 1)
            out[name] = sqrt(ln(greatest(r, 1e-10)) * -2.0) * cos(r2 * (2 * math.pi)) * b + a
        else:
            raise ValueError(kind)
    return Op(out, *steps)


#: The root of g^3 = g + 1, of which a low-discrepancy sequence in the plane is made. Fixed value.
PLASTIC = 1.32471795724474602596


def blue_noise(roi: Roi, seed: int = 0x1234567) -> Op:
    """One channel in [0, 1) that is spread evenly: the mean of a low-discrepancy sequence along the rows and hashed noise."""
    i = (Y - float(roi.y0)) * float(roi.width) + (X - float(roi.x0))
    part = lambda a: (i * a + 0.5) - floor(i * a + 0.5)
    hashed = noise("uniform", 0.0, 1.0, True, seed, ("v",))
    even = (part(1 / PLASTIC) + part(1 / PLASTIC**2)) * 0.5
    return Op({"v": (even + hashed.out["v"]) * 0.5}, *hashed.steps)


# Text: glyphs of five by seven dots, scaled by whole numbers

#: Rows of dots, from the top, five bits each, of the characters 0-9, A-Z and some signs. Fixed values.
GLYPHS = dict(line.split(" ", 1) for line in """
0 0E 11 13 15 19 11 0E|1 04 0C 04 04 04 04 0E|2 0E 11 01 02 04 08 1F|3 1F 02 04 02 01 11 0E|4 02 06 0A 12 1F 02 02|5 1F 10 1E 01 01 11 0E|6 06 08 10 1E 11 11 0E
7 1F 01 02 04 08 08 08|8 0E 11 11 0E 11 11 0E|9 0E 11 11 0F 01 02 0C|A 0E 11 11 11 1F 11 11|B 1E 11 11 1E 11 11 1E|C 0E 11 10 10 10 11 0E|D 1C 12 11 11 11 12 1C
E 1F 10 10 1E 10 10 1F|F 1F 10 10 1E 10 10 10|G 0E 11 10 17 11 11 0F|H 11 11 11 1F 11 11 11|I 0E 04 04 04 04 04 0E|J 07 02 02 02 02 12 0C|K 11 12 14 18 14 12 11
L 10 10 10 10 10 10 1F|M 11 1B 15 15 11 11 11|N 11 11 19 15 13 11 11|O 0E 11 11 11 11 11 0E|P 1E 11 11 1E 10 10 10|Q 0E 11 11 11 15 12 0D|R 1E 11 11 1E 14 12 11
S 0F 10 10 0E 01 01 1E|T 1F 04 04 04 04 04 04|U 11 11 11 11 11 11 0E|V 11 11 11 11 11 0A 04|W 11 11 11 15 15 15 0A|X 11 11 0A 04 0A 11 11|Y 11 11 11 0A 04 04 04
Z 1F 01 02 04 08 10 1F|. 00 00 00 00 00 0C 0C|, 00 00 00 00 0C 04 08|: 00 0C 0C 00 0C 0C 00|- 00 00 00 1F 00 00 00|+ 00 04 04 1F 04 04 00|_ 00 00 00 00 00 00 1F
/ 00 01 02 04 08 10 00|! 04 04 04 04 00 00 04|? 0E 11 01 02 04 00 04|( 02 04 08 08 08 04 02|) 08 04 02 02 02 04 08|= 00 00 1F 00 1F 00 00|# 0A 0A 1F 0A 1F 0A 0A
""".strip().replace("|", "\n").split("\n"))


def text_size(text: str, scale: int = 1) -> tuple[int, int]:
    """(width, height) in pixels: six dots for a character, nine for a line."""
    lines = text.split("\n")
    return max(map(len, lines)) * 6 * scale, len(lines) * 9 * scale


def in_text(text: str, x0: int, y0: int, scale: int = 1, align: str = "left", width: int | None = None) -> Ex:
    """Whether a pixel is on a dot of the text whose box begins at (x0, y0); align: left, center or right in `width` pixels.

    Lower case is drawn as upper case, a character without a glyph as a question mark. A line's dots are
    one number for each row; which bit a pixel reads follows from its place.
    """
    width = text_size(text, scale)[0] if width is None else width
    hits = []
    for n, line in enumerate(text.upper().split("\n")):
        own = len(line) * 6 * scale
        left = x0 + {"left": 0, "center": (width - own) // 2, "right": width - own}[align]
        for row in range(7):
            dots = []
            for i, c in enumerate(line):
                bits = int(GLYPHS.get(c, GLYPHS["?"] if c != " " else "00 " * 7).split()[row], 16)
                dots += [left + (i * 6 + k) * scale for k in range(5) if bits >> 4 - k & 1]
            top = y0 + (n * 9 + row) * scale
            spans: list[list[int]] = []
            for x in dots:  # neighbouring dots are one span
                if spans and spans[-1][1] == x:
                    spans[-1][1] = x + scale
                else:
                    spans.append([x, x + scale])
            if spans:
                inside = " OR ".join(f"(x >= {a} AND x < {b})" for a, b in spans)
                hits.append(f"(y >= {top} AND y < {top + scale} AND ({inside}))")
    return Ex(f"({' OR '.join(hits)})" if hits else "FALSE")


# Drawing: each shape is the condition that a pixel is covered.


def on_line(x0: int, y0: int, x1: int, y1: int) -> Ex:
    """Whether a pixel is on the line, as integer arithmetic on x and y."""
    dx, dy = x1 - x0, y1 - y0
    n = max(abs(dx), abs(dy))
    if n == 0:
        return Ex(f"(x = {x0} AND y = {y0})")
    along, across, a0, b0, da, db = ("x", "y", x0, y0, dx, dy) if abs(dx) >= abs(dy) else ("y", "x", y0, x0, dy, dx)
    step = f"({along} - {a0}) * {1 if da >= 0 else -1}"
    moved = f"CAST(floor((CAST({2 * abs(db)} * ({step}) + {n} AS DOUBLE)) / CAST({2 * n} AS DOUBLE)) AS INT)"
    return Ex(f"({step} BETWEEN 0 AND {n} AND {across} = {b0} + {1 if db >= 0 else -1} * {moved})")


def in_box(x0: int, y0: int, x1: int, y1: int, fill: bool = True) -> Ex:
    inside = f"(x BETWEEN {x0} AND {x1} AND y BETWEEN {y0} AND {y1})"
    return Ex(inside if fill else f"({inside} AND (x IN ({x0}, {x1}) OR y IN ({y0}, {y1})))")


def in_ellipse(cx: int, cy: int, rx: int, ry: int, fill: bool = True) -> Ex:
    d = lambda a, b: f"((x - {cx}) * (x - {cx}) * {b * b} + (y - {cy}) * (y - {cy}) * {a * a} <= {a * a * b * b})"
    return Ex(d(rx, ry) if fill else f"({d(rx, ry)} AND NOT {d(max(rx - 1, 0), max(ry - 1, 0))})")


def in_circle(cx: int, cy: int, r: int, fill: bool = True) -> Ex:
    return in_ellipse(cx, cy, r, r, fill)


def in_polygon(points: list[tuple[int, int]]) -> Ex:
    """Even-odd rule over the edges that a pixel's row crosses."""
    crossings = []
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        if y0 != y1:
            at = f"(CAST({x0} AS DOUBLE) + CAST(y - {y0} AS DOUBLE) * CAST({(x1 - x0) / (y1 - y0)!r} AS DOUBLE))"
            crossings.append(f"CASE WHEN y >= {min(y0, y1)} AND y < {max(y0, y1)} AND CAST(x AS DOUBLE) >= {at} THEN 1 ELSE 0 END")
    return Ex(f"(({' + '.join(crossings)}) % 2 = 1)")


def drawn(covered: Ex, color, names=("r", "g", "b", "a")) -> Op:
    """A shape of one colour on an image."""
    return Op({c: when((covered, float(v)), c) for c, v in zip(names, color, strict=True)})
