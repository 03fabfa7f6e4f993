"""Queries of two-image, geometric, neighbourhood and sampling operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.expr import Ex, Op, ex
from ..operators import composite, filters, geometry, patterns, sampling
from ..operators.adapters import ROWS
from ..operators.image import Roi
from .base import GRAY_SQL, K, RGBA, RGBA_SQL, gray, gray_query, image_query, rgba, table_query

W, H = 16, ROWS
BOX, GRAY_BOX = Roi(0, W, 0, H), Roi(0, 64, 0, H)
#: The second image of pair queries: the first one moved, so that borders differ.
MOVED_SQL = f"SELECT image_id, CAST(y + 5 AS INT) AS y, CAST(x + 3 AS INT) AS x, b AS r, r AS g, g AS b, a FROM ({RGBA_SQL}) AS m0"


def moved(s, d):
    img = rgba(s, d)
    img = img.moved(F.col("x") + 3, F.col("y") + 5, img.roi.moved(3, 5))
    return img.select({"r": F.col("b"), "g": F.col("r"), "b": F.col("g"), "a": F.col("a")})


PAIR_SQL, INNER_SQL = composite.paired_sql(RGBA_SQL, MOVED_SQL), composite.paired_sql(RGBA_SQL, MOVED_SQL, inner=True)


def pair_query(name: str, op: Op, inner: bool = False) -> None:
    image_query(
        name,
        lambda s, d: composite.paired(rgba(s, d), moved(s, d), inner).apply(op),
        op.sql(INNER_SQL if inner else PAIR_SQL, K),
        tuple(op.out),
    )


def _pairs() -> None:
    for name in composite.BINARY:
        pair_query(f"ar_{name}", composite.binary(name))
    pair_query("ar_scale", composite.binary("mul"), inner=True)
    pair_query("ch_append", Op({c: c for c in (*RGBA, "r2", "g2", "b2", "a2")}))
    for name, op in composite.COMPOSITES.items():
        pair_query(f"cm_{name}", op)
    image_query(
        "cm_under",
        lambda s, d: composite.composite("under", rgba(s, d), moved(s, d)),
        composite.COMPOSITES["over"].sql(composite.paired_sql(MOVED_SQL, RGBA_SQL), K),
        RGBA,
    )
    for mode in composite.BLENDS:
        pair_query(f"cm_blend_{mode}", composite.blend(mode, 0.75))
    depth = {"z": Ex("round(r * 4.0)"), "z2": Ex("round(g2 * 4.0)")}
    over = composite.zover()
    pair_query("cm_zover", Op(over.out, {k: v.cast("DOUBLE") for k, v in depth.items()}, *over.steps))
    image_query(
        "ge_paste",
        lambda s, d: composite.paste(rgba(s, d), rgba(s, d), 4, 7),
        f"SELECT p.image_id, p.y, p.x, {', '.join(f'coalesce(q.{c}, p.{c}) AS {c}' for c in RGBA)} FROM ({RGBA_SQL}) AS p "
        f"LEFT JOIN ({RGBA_SQL}) AS q ON p.image_id = q.image_id AND p.y = q.y + 7 AND p.x = q.x + 4",
        RGBA,
    )
    over_sql = ", ".join(f"coalesce(q.{c}, CAST(0 AS DOUBLE)) + p.{c} * (CAST(1 AS DOUBLE) - coalesce(q.a, CAST(0 AS DOUBLE))) AS {c}" for c in RGBA)
    image_query(
        "ge_paste_over",
        lambda s, d: composite.paste(rgba(s, d), rgba(s, d), 4, 7, alpha=True),
        f"SELECT p.image_id, p.y, p.x, {over_sql} FROM ({RGBA_SQL}) AS p "
        f"LEFT JOIN ({RGBA_SQL}) AS q ON p.image_id = q.image_id AND p.y = q.y + 7 AND p.x = q.x + 4",
        RGBA,
    )


def key_query(name: str, f, x: str, y: str, where: str = "TRUE") -> None:
    image_query(
        f"ge_{name}",
        lambda s, d: f(rgba(s, d)),
        f"SELECT image_id, CAST({y} AS INT) AS y, CAST({x} AS INT) AS x, r, g, b, a FROM ({RGBA_SQL}) AS k0 WHERE {where}",
        RGBA,
    )


def _geometry() -> None:
    key_query("crop", lambda i: i.crop(Roi(2, 9, 5, 40)), "x", "y", "x >= 2 AND x < 9 AND y >= 5 AND y < 40")
    key_query("flip", geometry.flip, "x", f"{H - 1} - y")
    key_query("flop", geometry.flop, f"{W - 1} - x", "y")
    key_query("transpose", geometry.transpose, "y", "x")
    key_query("rot90", geometry.rotate90, f"{H - 1} - y", "x")
    key_query("rot180", geometry.rotate180, f"{W - 1} - x", f"{H - 1} - y")
    key_query("rot270", geometry.rotate270, "y", f"{W - 1} - x")
    key_query("shift", lambda i: geometry.circular_shift(i, 5, -7), f"(x + 5) % {W}", f"(y - 7 + {H}) % {H}")
    key_query("reorient5", lambda i: geometry.reorient(i, 5), "y", "x")
    key_query("reorient7", lambda i: geometry.reorient(i, 7), "y", "x")
    key_query("reorient6", lambda i: geometry.reorient(i, 6), f"{H - 1} - y", "x")
    image_query("ch_shuffle", lambda s, d: geometry.shuffle_pattern(rgba(s, d), "BGR1"),
                f"SELECT image_id, y, x, b AS r, g, r AS b, CAST(1.0 AS DOUBLE) AS a FROM ({RGBA_SQL}) AS k0", RGBA)
    image_query("ch_reorder", lambda s, d: geometry.channels(rgba(s, d), ["a", 0.25, "r"], ["p", "q", "s"]),
                f"SELECT image_id, y, x, a AS p, CAST(0.25 AS DOUBLE) AS q, r AS s FROM ({RGBA_SQL}) AS k0", ("p", "q", "s"))
    image_query("ch_alpha", lambda s, d: geometry.alpha(rgba(s, d)), f"SELECT image_id, y, x, a FROM ({RGBA_SQL}) AS k0", ("a",))
    image_query(
        "ge_pad",
        lambda s, d: geometry.pad(rgba(s, d), 2, 3, 4, 1, 0.5),
        f"SELECT g0.image_id, g0.y, g0.x, {', '.join(f'coalesce(k0.{c}, CAST(0.5 AS DOUBLE)) AS {c}' for c in RGBA)} FROM "
        f"(SELECT image_id, CAST(gy.v AS INT) AS y, CAST(gx.v AS INT) AS x FROM (SELECT DISTINCT image_id FROM ({RGBA_SQL}) AS i0) AS i1, "
        f"range({H + 6}) AS gy(v), range({W + 4}) AS gx(v)) AS g0 LEFT JOIN ({RGBA_SQL}) AS k0 "
        "ON g0.image_id = k0.image_id AND g0.y = k0.y + 2 AND g0.x = k0.x + 1",
        RGBA,
    )
    image_query(
        "ge_tile",
        lambda s, d: geometry.tile(rgba(s, d), 40, 60),
        f"SELECT k0.image_id, CAST(gy.v AS INT) AS y, CAST(gx.v AS INT) AS x, r, g, b, a FROM ({RGBA_SQL}) AS k0, range(60) AS gy(v), range(40) AS gx(v) "
        f"WHERE gy.v % {H} = k0.y AND gx.v % {W} = k0.x",
        RGBA,
    )


def _tap_sql(r: int, mode: str = "clamp", source: str = GRAY_SQL, box: Roi = GRAY_BOX) -> str:
    """(image_id, y, x, v, dy, dx, n): every neighbour of every pixel as a row."""
    ny, nx = (sampling.wrapped(Ex(f"(p.{c} + d{c}.v)"), lo, hi, mode).sql for c, lo, hi in (("y", box.y0, box.y1), ("x", box.x0, box.x1)))
    n = "q.v" if mode != "black" else "coalesce(q.v, CAST(0.0 AS DOUBLE))"
    return (
        f"SELECT p.image_id, p.y, p.x, p.v, CAST(dy.v AS INT) AS dy, CAST(dx.v AS INT) AS dx, {n} AS n FROM ({source}) AS p, "
        f"range({-r}, {r + 1}) AS dy(v), range({-r}, {r + 1}) AS dx(v) "
        f"{'LEFT JOIN' if mode == 'black' else 'JOIN'} ({source}) AS q ON q.image_id = p.image_id AND q.y = {ny} AND q.x = {nx}"
    )


def _agg(r: int, value: str, **how) -> str:
    return f"SELECT image_id, y, x, {value} AS v FROM ({_tap_sql(r, **how)}) AS nb GROUP BY image_id, y, x"


def _weights(k: np.ndarray) -> str:
    r = k.shape[0] // 2
    arms = " ".join(f"WHEN dy = {i - r} AND dx = {j - r} THEN CAST({float(k[i, j])!r} AS DOUBLE)" for i in range(2 * r + 1) for j in range(2 * r + 1))
    return f"CASE {arms} END"


def _conv(k: np.ndarray, **how) -> str:
    k = np.asarray(k, float)
    return _agg(k.shape[0] // 2, f"sum({_weights(k)} * n)", **how)


def _filters() -> None:
    gray_query("fi_box", lambda i: filters.box_blur(i, 5), _agg(2, "avg(n)"))
    gauss = filters.gaussian_weights(0.8)
    gray_query("fi_gauss", lambda i: filters.blur(i, 0.8), _conv(np.outer(gauss, gauss)))
    gray_query("fi_median", lambda i: filters.median(i, 3), _agg(1, "list_sort(list(n))[5]"))
    low, high = _agg(1, "min(n)"), _agg(1, "max(n)")
    gray_query("fi_dilate", lambda i: filters.dilate(i, 3), high)
    gray_query("fi_erode", lambda i: filters.erode(i, 3), low)
    again = lambda f, s: _agg(1, f"{f}(n)", source=s)
    gray_query("fi_open", lambda i: filters.morph_open(i, 3), again("max", low))
    gray_query("fi_close", lambda i: filters.morph_close(i, 3), again("min", high))
    less = lambda p, q: f"SELECT image_id, y, x, p.v - q.v AS v FROM ({p}) AS p JOIN ({q}) AS q USING (image_id, y, x)"
    gray_query("fi_gradient", lambda i: filters.morph_gradient(i, 3), less(high, low))
    gray_query("fi_tophat", lambda i: filters.top_hat(i, 3), less(GRAY_SQL, again("max", low)))
    gray_query("fi_blackhat", lambda i: filters.black_hat(i, 3), less(again("min", high), GRAY_SQL))
    gray_query("fi_laplacian", filters.laplacian, _conv(filters.kernel("laplacian")))
    gray_query("fi_sharpen", filters.sharpen, _conv(filters.kernel("sharpen")))
    gx, gy = _weights(filters.kernel("sobel_x")), _weights(filters.kernel("sobel_y"))
    gray_query("fi_sobel", filters.sobel, _agg(1, f"sqrt(pow(sum({gx} * n), 2) + pow(sum({gy} * n), 2))"))
    blurred = _conv(np.outer(gauss, gauss))
    gray_query(
        "fi_unsharp",
        lambda i: filters.unsharp_mask(i, 0.8, 1.5, 0.02),
        "SELECT image_id, y, x, CASE WHEN abs(p.v - q.v) >= CAST(0.02 AS DOUBLE) THEN p.v + (p.v - q.v) * CAST(1.5 AS DOUBLE) ELSE p.v END AS v "
        f"FROM ({GRAY_SQL}) AS p JOIN ({blurred}) AS q USING (image_id, y, x)",
    )
    w = "exp(CAST(-(dx * dx + dy * dy) AS DOUBLE) / CAST(2.0 AS DOUBLE) - (n - v) * (n - v) / CAST(0.02 AS DOUBLE))"
    gray_query("fi_bilateral", lambda i: filters.bilateral(i, 1.0, 0.1, 2), _agg(2, f"sum({w} * n) / sum({w})"))
    for name in ("prewitt_x", "prewitt_y", "emboss"):
        gray_query(f"fi_{name}", lambda i, name=name: filters.convolve(i, filters.kernel(name)), _conv(filters.kernel(name)))
    for name, p in (("disk", 2.0), ("log", 1.2), ("unsharp", 1.0), ("box", 1.0)):
        k = filters.kernel(name, 5, 5, p)
        gray_query(f"fi_kernel_{name}", lambda i, k=k: filters.convolve(i, k), _conv(k))
    k = np.arange(1.0, 26.0).reshape(5, 5) / 325
    for mode in ("black", "periodic", "mirror"):
        gray_query(f"fi_border_{mode}", lambda i, mode=mode: filters.convolve(i, k, mode), _conv(k, mode=mode))
    holes = "CASE WHEN (x + y) % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE v END"
    holed = f"SELECT image_id, y, x, {holes} AS v FROM ({GRAY_SQL}) AS h0"
    spoil = lambda i: i.select({"v": F.expr(holes)})
    gray_query("st_fix_black", lambda i: filters.fix_non_finite(spoil(i)), f"SELECT image_id, y, x, CASE WHEN isnan(v) THEN CAST(0.0 AS DOUBLE) ELSE v END AS v FROM ({holed}) AS f0")
    gray_query(
        "st_fix_box3",
        lambda i: filters.fix_non_finite(spoil(i), "box3"),
        _agg(1, "CASE WHEN isnan(any_value(v)) THEN avg(n) FILTER (WHERE NOT isnan(n)) ELSE any_value(v) END", source=holed),
    )
    bayer = {}
    for c in "RGB":
        arms = []
        for py in (0, 1):
            for px in (0, 1):
                own = "RGGB"[py * 2 + px]
                here = f"any_value(y % 2) = {py} AND any_value(x % 2) = {px}"
                if own == c:
                    arms.append(f"WHEN {here} THEN any_value(v)")
                    continue
                taps = [
                    f"(dy = {dy} AND dx = {dx})" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
                    if "RGGB"[((py + dy) % 2) * 2 + (px + dx) % 2] == c and (c == "G" or own == "G" or (dy and dx))
                ]
                arms.append(f"WHEN {here} THEN avg(n) FILTER (WHERE {' OR '.join(taps)})")
        bayer[c.lower()] = f"CASE {' '.join(arms)} END"
    raw = (
        f"SELECT p.image_id, p.y, p.x, p.v, CAST(dy.v AS INT) AS dy, CAST(dx.v AS INT) AS dx, q.v AS n FROM ({GRAY_SQL}) AS p, range(-1, 2) AS dy(v), "
        f"range(-1, 2) AS dx(v) JOIN ({GRAY_SQL}) AS q ON q.image_id = p.image_id AND q.y = p.y + dy.v AND q.x = p.x + dx.v"
    )
    gray_query(
        "de_bilinear", filters.demosaic,
        f"SELECT image_id, y, x, {', '.join(f'{e} AS {c}' for c, e in bayer.items())} FROM ({raw}) AS nb GROUP BY image_id, y, x", ("r", "g", "b"),
    )


def sample_query(name: str, m: sampling.Map, target: Roi = BOX, digits: int = 6) -> None:
    image_query(
        name,
        lambda s, d: sampling.sampled(rgba(s, d), target, m),
        sampling.sampled_sql(RGBA_SQL, RGBA, BOX, target, m),
        RGBA,
        digits,
    )


def _sampling() -> None:
    for kind in ("nearest", "bilinear", "bicubic"):
        sample_query(f"ge_resize_{kind}", sampling.resize_map(BOX, 11, 31, kind), Roi(0, 11, 0, 31))
    w, h = geometry.fit_size(W, H, 40, 40)
    sample_query("ge_fit", sampling.resize_map(BOX, w, h), Roi(0, w, 0, h))
    sample_query("wa_rotate", sampling.affine_map(sampling.rotation(0.3, BOX)))
    for wrap in ("black", "clamp", "periodic", "mirror"):
        sample_query(f"wa_affine_{wrap}", sampling.affine_map([[1.1, 0.2, -3], [-0.1, 0.9, 4], [0, 0.002, 1]], wrap))
    warps = {
        "barrel": sampling.barrel(BOX, 0.2, 0.05), "pincushion": sampling.pincushion(BOX, 0.2, 0.05), "fisheye": sampling.fisheye(BOX, 0.8),
        "twist": sampling.twist(BOX, 40, 0.9), "wave": sampling.wave(BOX, 0.1, 2.0), "spherize": sampling.spherize(BOX, 0.5, 0.8),
        "ripple": sampling.ripple(BOX, 0.05, 3.0, 1.5),
    }
    for name, m in warps.items():
        sample_query(f"wa_{name}", m)
    m = sampling.st_map(BOX, True, False, "mirror")
    st_sql = f"SELECT image_id, y, x, r AS s, a AS t FROM ({RGBA_SQL}) AS st0"
    image_query(
        "wa_st",
        lambda s, d: sampling.st_warp(rgba(s, d), rgba(s, d).select({"s": F.col("r"), "t": F.col("a")}), flip_s=True, wrap="mirror"),
        sampling.sampled_sql(RGBA_SQL, RGBA, BOX, BOX, m, st_sql),
        RGBA,
    )
    tx = sampling.lookup_map(BOX)
    uv = f"SELECT image_id, y, x, g * CAST(1.5 AS DOUBLE) AS u, b - CAST(0.3 AS DOUBLE) AS v FROM ({RGBA_SQL}) AS uv0"
    image_query(
        "tx_sample",
        lambda s, d: sampling.sampled(rgba(s, d), BOX, tx, rgba(s, d).df.select(*K, F.expr("g * 1.5D").alias("u"), F.expr("b - 0.3D").alias("v"))),
        sampling.sampled_sql(RGBA_SQL, RGBA, BOX, BOX, tx, uv),
        RGBA,
    )
    s_, t_ = sampling.environment_st("r", "g", "b")
    env = Op({"u": s_, "v": t_, "level": sampling.mip_level(ex("r") * 8.0, ex("g") * 8.0, ex("b") * 8.0, ex("a") * 8.0, 6)})
    image_query("tx_environment", lambda s, d: rgba(s, d).apply(env), env.sql(RGBA_SQL, K), tuple(env.out))
    taps = sampling.filter_taps(64, 20, "lanczos3"), sampling.filter_taps(H, 30, "lanczos3")
    values = [", ".join(f"({s}, {t}, CAST({w!r} AS DOUBLE))" for s, t, w in axis) for axis in taps]
    one = "SELECT image_id, {o}, t AS {a}, sum(v * w) AS v FROM ({src}) AS f{i} JOIN (VALUES {values}) AS taps(s, t, w) ON {a} = s GROUP BY image_id, {o}, t"
    wide = one.format(o="y", a="x", src=GRAY_SQL, i=0, values=values[0])
    both = one.format(o="x", a="y", src=wide, i=1, values=values[1])
    gray_query("ge_resize_lanczos3", lambda i: sampling.resize_filtered(i, 20, 30), f"SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM ({both}) AS rs")
    # Mitchell's filter by its polynomial, in SQL.
    poly = (
        "CASE WHEN d < 1 THEN (CAST(7 AS DOUBLE) * d * d * d - CAST(12 AS DOUBLE) * d * d + CAST(16 AS DOUBLE) / 3) / 6 "
        "WHEN d < 2 THEN (CAST(-7 AS DOUBLE) / 3 * d * d * d + CAST(12 AS DOUBLE) * d * d - CAST(20 AS DOUBLE) * d + CAST(32 AS DOUBLE) / 3) / 6 ELSE CAST(0 AS DOUBLE) END"
    )

    def axis(a: str, o: str, n: int, m: int, source: str) -> str:
        scale, wide = n / m, max(1.0, n / m)
        at = f"((CAST(t.v AS DOUBLE) + CAST(0.5 AS DOUBLE)) * CAST({scale!r} AS DOUBLE) - CAST(0.5 AS DOUBLE))"
        far = f"SELECT t.v AS t, least(greatest(k.v, 0), {n - 1}) AS s, abs(CAST(k.v AS DOUBLE) - {at}) / CAST({wide!r} AS DOUBLE) AS d FROM range({m}) AS t(v), range(-20, {n + 20}) AS k(v)"
        taps = f"SELECT t, s, {poly} AS w FROM ({far}) AS f0 WHERE d < 2"
        return (
            f"SELECT image_id, {o}, CAST(t AS INT) AS {a}, sum(p.v * w) / sum(w) AS v FROM ({source}) AS p JOIN ({taps}) AS q ON p.{a} = q.s GROUP BY image_id, {o}, t"
        )

    gray_query("ge_resize_mitchell", lambda i: sampling.resize_filtered(i, 20, 70, "mitchell"), f"SELECT image_id, y, x, v FROM ({axis('y', 'x', H, 70, axis('x', 'y', 64, 20, GRAY_SQL))}) AS rs")
    m = sampling.composed(sampling.translation(-7, -20), sampling.scaling(1.2, 0.8), sampling.shear(0.2, -0.1), sampling.translation(8, 22))
    sample_query("wa_composed", sampling.affine_map(m))
    level_sql, w, h, every = GRAY_SQL, 64, H, [f"SELECT CAST(0 AS INT) AS level, image_id, y, x, v FROM ({GRAY_SQL}) AS l0"]
    for i in range(1, sampling.mip_levels(64, H)):
        sx, sy = (2 if w > 1 else 1), (2 if h > 1 else 1)
        w, h = max(1, w // 2), max(1, h // 2)
        level_sql = (
            f"SELECT image_id, CAST(y // {sy} AS INT) AS y, CAST(x // {sx} AS INT) AS x, avg(v) AS v FROM ({level_sql}) AS m{i} "
            f"WHERE x // {sx} < {w} AND y // {sy} < {h} GROUP BY image_id, y // {sy}, x // {sx}"
        )
        every.append(f"SELECT CAST({i} AS INT) AS level, image_id, y, x, v FROM ({level_sql}) AS l{i}")
    table_query("tx_mip", lambda s, d: sampling.mip_pyramid(gray(s, d)), " UNION ALL ".join(every), ["level", *K], ("v",))


def _patterns() -> None:
    roi = Roi(-3, 45, -2, 40)
    ops = {
        "pa_checker": patterns.checker(5, 7, (0.1, 0.2, 0.3), (0.9, 0.8, 0.7), (1, 2)),
        "pa_gradient": patterns.gradient(roi, (0, 0.5, 1), (1, 0.25, 0)),
        "pa_corners": patterns.corners(roi, (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)),
        "pa_constant": patterns.constant((0.25, 0.5)),
        "pa_noise_uniform": patterns.noise("uniform", -1.0, 1.0, seed=3),
        "pa_noise_gaussian": patterns.noise("gaussian", 0.5, 0.2, seed=5),
        "pa_noise_salt": patterns.noise("salt", 1.0, 0.1, True, seed=9),
    }
    for name, op in ops.items():
        image_query(name, lambda s, d, op=op: patterns.painted(s, roi, op, 2), op.sql(patterns.blank_sql(roi, 2), K), tuple(op.out))
    box = Roi(0, 64, 0, 64)
    image_query("pa_blue_noise", lambda s, d: patterns.painted(s, box, patterns.blue_noise(box)), patterns.blue_noise(box).sql(patterns.blank_sql(box), K), ("v",))
    page = Roi(0, 80, 0, 30)
    written = patterns.drawn(patterns.in_text("Take 7:\nshot_42?", 3, 4, 1, "center", 70), (0.9, 0.8, 0.7, 1.0))
    paper = Op({"r": 0.1, "g": 0.2, "b": 0.3, "a": 1.0})
    image_query(
        "dr_text", lambda s, d: patterns.painted(s, page, paper).apply(written), written.sql(paper.sql(patterns.blank_sql(page), K), K), RGBA
    )
    shapes = {
        "line": patterns.on_line(1, 2, 13, 41), "line_steep": patterns.on_line(14, 3, 2, 9), "box": patterns.in_box(3, 5, 11, 30, False),
        "circle": patterns.in_circle(8, 20, 6), "circle_outline": patterns.in_circle(8, 20, 6, False), "ellipse": patterns.in_ellipse(8, 25, 5, 15),
        "polygon": patterns.in_polygon([(2, 3), (13, 10), (8, 40), (3, 25)]),
    }
    for name, covered in shapes.items():
        op = patterns.drawn(covered, (1.0, 0.5, 0.25, 1.0))
        image_query(f"dr_{name}", lambda s, d, op=op: rgba(s, d).apply(op), op.sql(RGBA_SQL, K), RGBA)


_pairs()
_geometry()
_filters()
_sampling()
_patterns()
