"""Queries of transforms that SQL can't say, and one law of each that it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import ex
from ..operators import filters, frequency, layers, repair, sampling, stats, texture, tiles
from ..operators.adapters import RGBA_SQL, load
from ..operators.image import Roi
from .base import GRAY_SQL, K, gray, register, rgba, rounded, table_query


def _dft_sql(source: str, w: int, h: int, back: bool = False) -> str:
    """(image_id, y, x, re, im): the unitary transform by its definition, rows and then columns."""
    turn = lambda c, n: f"(CAST(2 * {c} * k.v AS DOUBLE) * pi() / CAST({n} AS DOUBLE))"
    sign = "-" if back else "+"
    parts = lambda t: (f"sum(re * cos({t}) {sign} im * sin({t}))", f"sum(im * cos({t}) {'+' if back else '-'} re * sin({t}))")
    tx, ty = turn("x", w), turn("y", h)
    rows = f"SELECT image_id, y, CAST(k.v AS INT) AS x, {parts(tx)[0]} AS re, {parts(tx)[1]} AS im FROM ({source}) AS s0, range({w}) AS k(v) GROUP BY image_id, y, k.v"
    size = f"sqrt(CAST({w * h} AS DOUBLE))"
    return f"SELECT image_id, CAST(k.v AS INT) AS y, x, {parts(ty)[0]} / {size} AS re, {parts(ty)[1]} / {size} AS im FROM ({rows}) AS s1, range({h}) AS k(v) GROUP BY image_id, k.v, x"


def _response_sql(factor: str, w: int = 64, h: int = 50) -> str:
    """(image_id, y, x, v): grey images with their frequencies weighted by `factor` of the squared frequency f2."""
    part = lambda c, n: f"pow(CAST(CASE WHEN {c} < {(n + 1) // 2} THEN {c} ELSE {c} - {n} END AS DOUBLE) / CAST({n} AS DOUBLE), 2)"
    forward = _dft_sql(f"SELECT *, v AS re, CAST(0 AS DOUBLE) AS im FROM ({GRAY_SQL}) AS g0", w, h)
    weighted = f"SELECT image_id, y, x, re * {factor} AS re, im * {factor} AS im FROM (SELECT *, {part('y', h)} + {part('x', w)} AS f2 FROM ({forward}) AS f0) AS f1"
    return f"SELECT image_id, y, x, re AS v FROM ({_dft_sql(weighted, w, h, True)}) AS b0"


def _frequency() -> None:
    import math

    import numpy as np

    from .images import _conv

    forward = _dft_sql(f"SELECT *, v AS re, CAST(0 AS DOUBLE) AS im FROM ({GRAY_SQL}) AS g0", 64, 50)
    table_query("fft_forward", lambda s, d: frequency.fft(gray(s, d)).df, forward, K, ("re", "im"))
    table_query(
        "fft_polar",
        lambda s, d: frequency.fft(gray(s, d)).apply(frequency.to_polar()).df.select(*K, "size"),
        f"SELECT image_id, y, x, sqrt(re * re + im * im) AS size FROM ({forward}) AS p0",
        K,
        ("size",),
    )
    low = lambda sigma: f"exp(CAST({-2 * (math.pi * sigma) ** 2!r} AS DOUBLE) * f2)"
    one = "CAST(1 AS DOUBLE)"
    table_query("fft_blur", lambda s, d: frequency.fft_blur(gray(s, d), 1.5).df, _response_sql(low(1.5)), K, ("v",))
    table_query("fft_highpass", lambda s, d: frequency.fft_highpass(gray(s, d), 1.5).df, _response_sql(f"({one} - {low(1.5)})"), K, ("v",))
    table_query(
        "fft_sharpen", lambda s, d: frequency.fft_sharpen(gray(s, d), 1.5, 0.7).df, _response_sql(f"({one} + CAST(0.7 AS DOUBLE) * ({one} - {low(1.5)}))"), K, ("v",)
    )
    kernel = np.arange(1.0, 16.0).reshape(3, 5) ** 1.3
    square = np.zeros((5, 5))
    square[1:4] = kernel
    # A convolution meets the kernel from its end.
    table_query("fft_convolve", lambda s, d: frequency.fft_convolve(gray(s, d), kernel / kernel.sum()).df, _conv(square[::-1, ::-1] / kernel.sum(), mode="periodic"), K, ("v",))
    whole = lambda s, d: frequency.fft(gray(s, d)).df.groupBy("image_id").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("energy"))
    # The transform keeps energy (a last image with missing rows counts as padded with zeros).
    table_query("fft_energy", whole, f"SELECT image_id, sum(v * v) AS energy FROM ({GRAY_SQL}) AS g0 GROUP BY image_id", ["image_id"], ("energy",))
    back = lambda s, d: frequency.ifft(frequency.fft(gray(s, d), marked=True)).df
    table_query("fft_inverse", back, GRAY_SQL, K, ("v",))
    known = frequency.KNOWN
    circle = lambda s, d: frequency.fft(gray(s, d), marked=True).apply(frequency.to_polar(known)).apply(frequency.to_complex(known))
    table_query("fft_polar_inverse", lambda s, d: frequency.ifft(circle(s, d)).df, GRAY_SQL, K, ("v",))


def _repair() -> None:
    holed = lambda s, d: rgba(s, d).select({c: F.when((F.col("x") + F.col("y")) % 5 == 0, 0.0).otherwise(F.col(c)) for c in ("r", "g", "b", "a")})
    one = "CAST(1 AS DOUBLE)"
    base = f"SELECT image_id, y, x, {', '.join(f'CASE WHEN (x + y) % 5 = 0 THEN {one} * 0 ELSE {c} END AS {c}' for c in 'rgba')} FROM ({RGBA_SQL}) AS h0"
    ups = ", ".join(f"sum({c} * a) / sum(a) AS u{c}" for c in "rgb")
    pick = ", ".join(f"CASE WHEN p.a < CAST(0.001 AS DOUBLE) AND f.ua IS NOT NULL THEN f.u{c} ELSE p.{c} END AS {c}" for c in "rgba")
    table_query(
        "re_push_pull",
        lambda s, d: repair.push_pull(holed(s, d)).df,
        f"WITH base AS ({base}), sums AS (SELECT image_id, l.v AS lv, y >> l.v AS fy, x >> l.v AS fx, {ups}, avg(a) AS ua FROM base, (SELECT CAST(v AS INT) AS v FROM range(1, 7) AS q(v)) AS l "
        "WHERE a >= CAST(0.001 AS DOUBLE) GROUP BY 1, 2, 3, 4), "
        "ranked AS (SELECT b.image_id, b.y, b.x, s.ur, s.ug, s.ub, s.ua, row_number() OVER (PARTITION BY b.image_id, b.y, b.x ORDER BY s.lv) AS k FROM base AS b JOIN sums AS s "
        "ON s.image_id = b.image_id AND s.fy = b.y >> s.lv AND s.fx = b.x >> s.lv WHERE b.a < CAST(0.001 AS DOUBLE)) "
        f"SELECT p.image_id, p.y, p.x, {pick} FROM base AS p LEFT JOIN (SELECT * FROM ranked WHERE k = 1) AS f ON f.image_id = p.image_id AND f.y = p.y AND f.x = p.x",
        K,
        ("r", "g", "b", "a"),
    )
    table_query(
        "re_holes",
        lambda s, d: repair.holes(holed(s, d)),
        f"SELECT image_id, count(*) FILTER (WHERE (x + y) % 5 = 0 OR a < CAST(0.001 AS DOUBLE)) AS n FROM ({RGBA_SQL}) AS h0 GROUP BY image_id",
        ["image_id", "n"],
    )


_frequency()
_repair()


def _layers() -> None:
    every = lambda s, d: layers.merged({"beauty": rgba(s, d), "id": rgba(s, d).select({"r": F.col("a")})})
    table_query(
        "la_list",
        lambda s, d: layers.listed(every(s, d)),
        f"SELECT l AS layer, count(*) AS pixels, count(DISTINCT image_id) AS images FROM ({RGBA_SQL}) AS p, (VALUES ('beauty'), ('id')) AS v(l) GROUP BY l",
        ["layer", "pixels", "images"],
    )
    table_query("la_pick", lambda s, d: layers.picked(every(s, d), "id").select(*K, "r"), f"SELECT image_id, y, x, a AS r FROM ({RGBA_SQL}) AS p", K, ("r",))
    bins = "CASE WHEN value <= 0 THEN 0 WHEN value >= 1 THEN 15 ELSE CAST(least(floor(value / CAST(1 AS DOUBLE) * 16), 15) AS INT) END"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} AS value FROM ({RGBA_SQL}) AS c{c}" for c in "rgba")
    table_query(
        "st_histograms",
        lambda s, d: stats.histograms(rgba(s, d), 16, 0.0, 1.0),
        f"SELECT channel, {bins} AS bin, count(*) AS n FROM ({rows}) AS r0 GROUP BY 1, 2",
        ["channel", "bin", "n"],
    )


#: Texture lookups: an event each, spread over all images.
LOOKUPS_SQL = """SELECT event_id AS key, event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings) AS image_id, coalesce(value, CAST(0 AS DOUBLE)) / CAST(97.0 AS DOUBLE) AS u,
  CAST(event_id AS DOUBLE) / CAST(1013.0 AS DOUBLE) AS v, CAST(event_id % 7 AS DOUBLE) * CAST(0.0131 AS DOUBLE) AS dudx, CAST(event_id % 3 AS DOUBLE) * CAST(0.0021 AS DOUBLE) AS dvdx,
  CAST(event_id % 2 AS DOUBLE) * CAST(0.0013 AS DOUBLE) AS dudy, CAST(event_id % 5 AS DOUBLE) * CAST(0.0093 AS DOUBLE) AS dvdy FROM events"""


def _images(s, d) -> int:
    return load(s, d, "embeddings").agg(F.max("vec_id")).first()[0] // 50 + 1


def _lookups(s, d):
    n = _images(s, d)
    step = lambda m, f: (F.col("event_id") % m).cast("double") * f
    return load(s, d, "events").select(
        F.col("event_id").alias("key"), (F.col("event_id") % n).alias("image_id"), (F.coalesce("value", F.lit(0.0)) / 97.0).alias("u"),
        (F.col("event_id").cast("double") / 1013.0).alias("v"), step(7, 0.0131).alias("dudx"), step(3, 0.0021).alias("dvdx"), step(2, 0.0013).alias("dudy"), step(5, 0.0093).alias("dvdy"),
    )


def _trilinear_sql(lookups: str, pyramid: str, wrap: str = "periodic") -> str:
    """(key, v) of lookups (key, image_id, u, v, level), each the sum of its weighted texels."""
    two = (
        "SELECT key, image_id, u, v, l, w, greatest(1, 64 >> l) AS wl, greatest(1, 50 >> l) AS hl FROM ("
        f"SELECT key, image_id, u, v, CAST(least(floor(level), 6) AS INT) AS l, CAST(1 AS DOUBLE) - (level - least(floor(level), 6)) AS w FROM ({lookups}) AS k0 UNION ALL "
        f"SELECT key, image_id, u, v, CAST(least(least(floor(level), 6) + 1, 6) AS INT), level - least(floor(level), 6) FROM ({lookups}) AS k1) AS k2 WHERE w > 0"
    )
    at = f"SELECT key, image_id, l, w, wl, hl, u * wl - CAST(0.5 AS DOUBLE) AS sx, v * hl - CAST(0.5 AS DOUBLE) AS sy FROM ({two}) AS k3"
    inside = (lambda c, n: f"((({c}) % {n}) + {n}) % {n}") if wrap == "periodic" else (lambda c, n: f"greatest(0, least({n} - 1, {c}))")
    taps = " UNION ALL ".join(
        f"SELECT key, image_id, l, {inside(f'CAST(floor(sx) AS INT) + {dx}', 'wl')} AS x, {inside(f'CAST(floor(sy) AS INT) + {dy}', 'hl')} AS y, "
        f"w * {'(sx - floor(sx))' if dx else '(CAST(1 AS DOUBLE) - (sx - floor(sx)))'} * {'(sy - floor(sy))' if dy else '(CAST(1 AS DOUBLE) - (sy - floor(sy)))'} AS w FROM spots"
        for dx in (0, 1) for dy in (0, 1)
    )
    return (
        f"WITH spots AS MATERIALIZED ({at}), taps AS ({taps}), mip AS MATERIALIZED ({pyramid}) "
        "SELECT taps.key, coalesce(sum(taps.w * mip.v), CAST(0 AS DOUBLE)) AS v FROM taps LEFT JOIN mip ON mip.image_id = taps.image_id AND mip.level = taps.l AND mip.y = taps.y AND mip.x = taps.x GROUP BY taps.key"
    )


def _textures() -> None:
    from .base import SQL

    mip = "SELECT level, image_id, y, x, v FROM (" + SQL["tx_mip"].replace("round(v, 6) + CAST(0.0 AS DOUBLE) AS v", "v") + ") AS mip0"
    level = sampling.mip_level(ex("dudx") * 64.0, ex("dvdx") * 50.0, ex("dudy") * 64.0, ex("dvdy") * 50.0, 7)
    levelled = f"SELECT *, {level.sql} AS level FROM ({LOOKUPS_SQL}) AS lk"
    table_query(
        "tx_trilinear", lambda s, d: texture.trilinear(texture.levelled(_lookups(s, d), gray(s, d)), gray(s, d)), _trilinear_sql(levelled, mip), ["key"], ("v",)
    )
    side = lambda a, b: f"sqrt(pow({a} * CAST(64 AS DOUBLE), 2) + pow({b} * CAST(50 AS DOUBLE), 2))"
    feet = f"SELECT *, {side('dudx', 'dvdx')} AS fa, {side('dudy', 'dvdy')} AS fb FROM ({LOOKUPS_SQL}) AS f0"
    counted = f"SELECT *, CAST(greatest(1, least(16, ceil(greatest(fa, fb) / greatest(greatest(least(fa, fb), CAST(0.000001 AS DOUBLE)), CAST(1 AS DOUBLE))))) AS INT) AS n FROM ({feet}) AS f1"
    place = "((CAST(i AS DOUBLE) - CAST(0.5 AS DOUBLE)) / CAST(n AS DOUBLE) - CAST(0.5 AS DOUBLE))"
    spread = (
        f"SELECT key * 16 + i - 1 AS key, image_id, u + CASE WHEN fa >= fb THEN dudx ELSE dudy END * {place} AS u, v + CASE WHEN fa >= fb THEN dvdx ELSE dvdy END * {place} AS v, "
        f"least(CAST(6 AS DOUBLE), log2(greatest(CAST(1 AS DOUBLE), greatest(fa, fb) / n))) AS level FROM ({counted}) AS f2, range(1, 17) AS q(i) WHERE i <= n"
    )
    table_query(
        "tx_anisotropic",
        lambda s, d: texture.anisotropic(_lookups(s, d), gray(s, d)),
        f"SELECT key // 16 AS key, avg(v) AS v FROM ({_trilinear_sql(spread, mip)}) AS an GROUP BY 1",
        ["key"],
        ("v",),
    )
    depth = "(SELECT max(vec_id) // 50 + 1 FROM embeddings)"
    slices = f"SELECT *, greatest(CAST(0 AS DOUBLE), least(dudx * 10 * {depth} - CAST(0.5 AS DOUBLE), CAST({depth} - 1 AS DOUBLE))) AS pos FROM ({LOOKUPS_SQL}) AS s0"
    both = (
        f"SELECT key * 2 AS key, CAST(floor(pos) AS BIGINT) AS image_id, u, v, CAST(0 AS DOUBLE) AS level, CAST(1 AS DOUBLE) - (pos - floor(pos)) AS zw FROM ({slices}) AS s1 UNION ALL "
        f"SELECT key * 2 + 1, CAST(least(floor(pos) + 1, {depth} - 1) AS BIGINT), u, v, CAST(0 AS DOUBLE), pos - floor(pos) FROM ({slices}) AS s2"
    )
    table_query(
        "tx_volume",
        lambda s, d: texture.volume(_lookups(s, d).withColumn("t", F.col("dudx") * 10), gray(s, d), _images(s, d)),
        f"SELECT z.key // 2 AS key, sum(z.zw * t.v) AS v FROM ({both}) AS z JOIN ({_trilinear_sql(both, mip, 'clamp')}) AS t ON t.key = z.key GROUP BY 1",
        ["key"],
        ("v",),
    )
    way = "SELECT key, image_id, u - CAST(0.5 AS DOUBLE) AS dx, sin(v) AS dy, cos(v * CAST(3 AS DOUBLE)) AS dz, CAST(key % 4 AS DOUBLE) * CAST(0.7 AS DOUBLE) AS level FROM ({}) AS w0"
    u, v = sampling.environment_st("dx", "dy", "dz")

    def directions(s, d):
        return _lookups(s, d).select("key", "image_id", (F.col("u") - 0.5).alias("dx"), F.sin("v").alias("dy"), F.cos(F.col("v") * 3.0).alias("dz"), ((F.col("key") % 4).cast("double") * 0.7).alias("level"))

    turned = f"SELECT key, image_id, {u.sql} AS u, {v.sql} AS v, level FROM ({way.format(LOOKUPS_SQL)}) AS w1"
    table_query("tx_environment_texels", lambda s, d: texture.environment(directions(s, d), gray(s, d)), _trilinear_sql(turned, mip), ["key"], ("v",))
    level = sampling.mip_level(ex("r") * 64.0, ex("g") * 50.0, ex("b") * 64.0, ex("a") * 50.0, 7)
    table_query(
        "tx_level",
        lambda s, d: rgba(s, d).df.select(*K, level.col.alias("level")),
        f"SELECT image_id, y, x, {level.sql} AS level FROM ({RGBA_SQL}) AS p",
        K,
        ("level",),
    )


def _tiles() -> None:
    import numpy as np

    gauss = filters.gaussian_weights(0.8)
    from .images import _agg, _conv

    table_query("fi_gauss_tiles", lambda s, d: tiles.gaussian(gray(s, d), 0.8, 16).df, _conv(np.outer(gauss, gauss)), K, ("v",))
    table_query("fi_median_tiles", lambda s, d: tiles.median(gray(s, d), 3, 16).df, _agg(1, "list_sort(list(n))[5]"), K, ("v",))
    table_query("ti_there_and_back", lambda s, d: tiles.from_tiles(tiles.to_tiles(gray(s, d), 16, 2), gray(s, d), 16).df, GRAY_SQL, K, ("v",))
    own = "CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN r WHEN y % 2 = 1 AND x % 2 = 1 THEN b ELSE g END"
    for method in ("vng", "ahd"):
        register(f"de_{method}", lambda s, d, m=method: rounded(tiles.demosaic(gray(s, d), "RGGB", m, 16).df, K, ("r", "g", "b")))
        # A pixel keeps the value that it was made of.
        table_query(
            f"de_{method}_sites", lambda s, d, m=method: tiles.demosaic(gray(s, d), "RGGB", m, 16).df.select(*K, F.expr(own).alias("v")), GRAY_SQL, K, ("v",)
        )
    m, box = sampling.whole_turn(Roi(0, 16, 0, 50), 30.0)
    marked = f"SELECT *, CAST(1 AS DOUBLE) AS covered FROM ({RGBA_SQL}) AS m0"
    turned = sampling.sampled_sql(marked, ("r", "g", "b", "a", "covered"), Roi(0, 16, 0, 50), box, m)
    table_query(
        "wa_rotate_whole",
        lambda s, d: sampling.rotate_whole(rgba(s, d), 30.0, (0.5,)).df,
        f"SELECT image_id, y, x, {', '.join(f'CASE WHEN covered > 0 THEN {c} ELSE CAST(0.5 AS DOUBLE) END AS {c}' for c in 'rgba')} FROM ({turned}) AS t0",
        K,
        ("r", "g", "b", "a"),
    )


def _files() -> None:
    """Images written as files of a format and read again."""
    from ..sources import files

    names = ("r", "g", "b")

    def there_and_back(s, d, kind, bits):
        img = rgba(s, d)
        rows = img.df.select(F.col("image_id").cast("string").alias("path"), F.col("y").alias("py"), F.col("x").alias("px"), *names)
        back = files.decoded(files.encoded(rows, kind, channels=names, bits=bits), names)
        return back.select(F.col("path").cast("bigint").alias("image_id"), F.col("py").alias("y"), F.col("px").alias("x"), *names)

    single = "CAST(CAST({c} AS FLOAT) AS DOUBLE)"
    unit = "CAST(CAST(least(greatest({c}, 0.0), 1.0) AS FLOAT) AS DOUBLE)"
    cut = "floor(CAST(CAST(" + unit + " * {top} AS FLOAT) AS DOUBLE)) / {top}.0"
    top3 = "greatest(" + ", ".join(single.format(c=c) for c in names) + ", CAST(0 AS DOUBLE))"
    unit8 = f"pow(CAST(2 AS DOUBLE), floor(log2({top3})) - 7)"  # the value of one step of a shared exponent
    rgbe = f"CASE WHEN {top3} > 0 THEN floor(greatest(CAST(CAST({{c}} AS FLOAT) AS DOUBLE), CAST(0 AS DOUBLE)) / {unit8}) * {unit8} ELSE CAST(0 AS DOUBLE) END"
    near = "floor(" + unit + " * CAST({top} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / {top}.0"
    for name, kind, bits, formula, top in (
        ("exr", "exr", None, single, 1), ("pfm", "pfm", None, single, 1), ("tiff32", "tiff", 32, single, 1), ("tiff16", "tiff", 16, cut, 65535),
        ("png16", "png", 16, cut, 65535), ("png8", "png", 8, cut, 255), ("ppm8", "ppm", 8, cut, 255), ("dpx16", "dpx", 16, near, 65535),
        ("dpx", "dpx", 10, near, 1023), ("dpx12", "dpx", 12, near, 4095), ("dpx8", "dpx", 8, near, 255), ("tiff8", "tiff", 8, cut, 255), ("dds", "dds", None, cut, 255),
        ("hdr", "hdr", None, rgbe, 1),
    ):
        table_query(
            f"so_{name}",
            lambda s, d, k=kind, b=bits: there_and_back(s, d, k, b),
            f"SELECT image_id, y, x, {', '.join(f'CAST(CAST({formula.format(c=c, top=top)} AS FLOAT) AS DOUBLE) AS {c}' for c in names)} FROM ({RGBA_SQL}) AS p",
            K,
            names,
        )


def _more_files() -> None:
    """Deep, wavelet-packed, lossy, several in one file, levels, boxes, tiles, headers and batches."""
    from ..operators import adapters, deep
    from ..sources import exr, files
    from .base import RGBA

    names = ("r", "g", "b")
    single = "CAST(CAST({} AS FLOAT) AS DOUBLE)".format

    def rows(s, d, channels=names):
        img = rgba(s, d)
        return img.df.select(F.col("image_id").cast("string").alias("path"), F.col("y").alias("py"), F.col("x").alias("px"), *channels)

    def placed(df, channels=names):
        return df.select(F.col("path").cast("bigint").alias("image_id"), F.col("py").alias("y"), F.col("px").alias("x"), *channels)

    floats = f"SELECT image_id, y, x, {', '.join(f'{single(c)} AS {c}' for c in names)} FROM ({RGBA_SQL}) AS p"
    for name, compression in (("piz", exr.PIZ), ("rle", exr.RLE), ("none", exr.NONE)):
        table_query(f"so_exr_{name}", lambda s, d, k=compression: placed(files.decoded(files.encoded(rows(s, d), "exr", channels=names, compression=k), names)), floats, K, names)
    table_query(
        "so_exr_tiles", lambda s, d: placed(files.decoded(files.encoded(rows(s, d), "exr", channels=names, tile=8), names)), floats, K, names
    )
    table_query(
        "so_exr_box",
        lambda s, d: placed(files.decoded(files.encoded(rows(s, d), "exr", channels=names, tile=8), names, box=(3, 10, 12, 33))),
        f"SELECT * FROM ({floats}) AS b0 WHERE x BETWEEN 3 AND 11 AND y BETWEEN 10 AND 32",
        K,
        names,
    )
    extra = ("diffuse.R", "id")

    def others(s, d):
        wide = rows(s, d, RGBA).withColumn("diffuse.R", F.col("r") + F.col("g")).withColumn("id", F.col("px").cast("double"))
        back = files.decoded(files.encoded(wide, "exr", channels=(*names, *extra)))
        return placed(back.select("path", "py", "px", F.col("others")["diffuse.R"].alias("diffuse"), F.col("others")["id"].alias("id")), ("diffuse", "id"))

    table_query("so_other_channels", others, f"SELECT image_id, y, x, {single('r + g')} AS diffuse, CAST(x AS DOUBLE) AS id FROM ({RGBA_SQL}) AS p", K, ("diffuse", "id"))
    # A grey image of squares that JPEG holds exactly at full quality.
    square = "floor(((y // 8) * 7 + (x // 8) * 3 + image_id) % 32) * 8"

    def jpeg(s, d):
        level = F.expr("CAST(((y div 8) * 7 + (x div 8) * 3 + image_id) % 32 * 8 AS DOUBLE) / 255D")
        grey = rgba(s, d).df.select(F.col("image_id").cast("string").alias("path"), F.col("y").alias("py"), F.col("x").alias("px"), (level + 1e-6).alias("y"))
        back = files.decoded(files.encoded(grey, "jpeg", channels=("y",)), ("y",))
        return back.select(F.col("path").cast("bigint").alias("image_id"), F.col("py").alias("y"), F.col("px").alias("x"), F.round(F.col("y") * 255 / 8).cast("int").alias("step"))

    table_query("so_jpeg", jpeg, f"SELECT image_id, y, x, CAST({square} / 8 AS INT) AS step FROM ({RGBA_SQL}) AS p", [*K, "step"])

    def deep_file(s, d):
        # Orders of one file each hundred, lines below each other.
        found = deep.exploded(deep.gathered(adapters.deep(s, d))).where("y < 2000")
        told = found.select(F.expr("CAST(y div 100 AS STRING)").alias("path"), (F.col("y") % 100).cast("int").alias("y"), F.col("x").cast("int").alias("x"), "s", "z", "a", "r", "g", "b")
        back = files.decoded_deep(files.encoded_deep(told, tile=4))
        return back.select(F.col("path").cast("bigint").alias("file"), "y", "x", "s", "z", "zback", "a", "r", "g", "b")

    ordered = f"SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY z, zback, a, r, g, b) - 1 AS s FROM ({adapters.DEEP_SQL}) AS dp"
    table_query(
        "so_deep_exr",
        deep_file,
        f"SELECT y // 100 AS file, CAST(y % 100 AS INT) AS y, CAST(x AS INT) AS x, CAST(s AS INT) AS s, {single('z')} AS z, {single('z')} AS zback, "
        f"{', '.join(f'{single(c)} AS {c}' for c in 'argb')} FROM ({ordered}) AS o WHERE y < 2000",
        ["file", "y", "x", "s"],
        ("z", "zback", "a", "r", "g", "b"),
    )

    kinds = ("png", "exr", "dpx", "tiff", "pfm", "hdr", "jpeg", "dds")

    def headers(s, d):
        made = None
        for kind in kinds:
            some = files.encoded(rows(s, d), kind, channels=names)
            made = some if made is None else made.unionByName(some)
        return files.described(made).select(F.col("path").cast("bigint").alias("image_id"), "format", "width", "height", F.array_join("channel_names", "").alias("names"))

    table_query(
        "so_headers",
        headers,
        f"SELECT image_id, f AS format, CAST(max(x) + 1 AS INT) AS width, CAST(max(y) + 1 AS INT) AS height, CASE WHEN f = 'dds' THEN 'rgba' ELSE 'rgb' END AS names "
        f"FROM ({RGBA_SQL}) AS p, (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in kinds)}) AS v(f) GROUP BY image_id, f",
        ["image_id", "format", "width", "height", "names"],
    )

    def estimates(s, d):
        told = files.described(files.encoded(rows(s, d).where("px <= image_id"), "png", channels=names))
        return files.estimated(told, 8000).select(F.col("path").cast("bigint").alias("image_id"), "memory_bytes", "strategy")

    table_query(
        "so_estimates",
        estimates,
        f"SELECT image_id, n AS memory_bytes, CASE WHEN n < 2000 THEN 'whole' WHEN n <= 8000 THEN 'strips' ELSE 'tiles' END AS strategy FROM "
        f"(SELECT image_id, CAST((max(x) + 1) * (max(y) + 1) * 3 * 4 AS BIGINT) AS n FROM ({RGBA_SQL}) AS p WHERE x <= image_id GROUP BY image_id) AS e0",
        ["image_id", "memory_bytes", "strategy"],
    )

    def broken(s, d):
        # Each third file is cut short.
        made = files.encoded(rows(s, d), "png", channels=names)
        cut = made.withColumn("content", F.when(F.col("path").cast("int") % 3 == 0, F.expr("substring(content, 1, 20)")).otherwise(F.col("content")))
        return files.decoded(cut, names).groupBy(F.col("path").cast("bigint").alias("image_id")).agg(F.count("px").alias("pixels"), F.count("error").alias("errors"))

    table_query(
        "so_broken",
        broken,
        f"SELECT image_id, sum(CASE WHEN image_id % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS pixels, CAST(max(CASE WHEN image_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM ({RGBA_SQL}) AS p GROUP BY image_id",
        ["image_id", "pixels", "errors"],
    )


def _layer_changes() -> None:
    from .images import _conv

    both = lambda s, d: layers.merged({"beauty": rgba(s, d).select({"v": F.col("r")}), "id": rgba(s, d).select({"v": F.col("a")})})
    box = Roi(0, 16, 0, 50)
    beauty = f"SELECT 'beauty' AS layer, image_id, y, x, r AS v FROM ({RGBA_SQL}) AS p"
    table_query(
        "la_crop",
        lambda s, d: layers.transformed(both(s, d), "id", box, ("v",), lambda i: i.crop(Roi(2, 9, 5, 20))),
        f"{beauty} UNION ALL SELECT 'id', image_id, y, x, a FROM ({RGBA_SQL}) AS q WHERE x BETWEEN 2 AND 8 AND y BETWEEN 5 AND 19",
        ["layer", *K],
        ("v",),
    )
    import numpy as np

    k = np.full((3, 3), 1 / 9)
    blurred = _conv(k, source=f"SELECT image_id, y, x, a AS v FROM ({RGBA_SQL}) AS q", box=box)
    table_query(
        "la_blur",
        lambda s, d: layers.transformed(both(s, d), "id", box, ("v",), lambda i: filters.box_blur(i, 3)),
        f"{beauty} UNION ALL SELECT 'id', image_id, y, x, v FROM ({blurred}) AS q",
        ["layer", *K],
        ("v",),
    )


_layers()
_textures()
_tiles()
_files()
_more_files()
_layer_changes()
