"""Queries of per-pixel operations."""

from __future__ import annotations

import numpy as np

from ..functions import color, curves, gamut, sql, transfer
from ..functions.expr import Op, ex, least
from .base import K, RGBA_SQL, pixel_query, rgba, table_query

ALL = ("r", "g", "b", "a")


def _transfer_queries() -> None:
    for name in transfer.CURVES:
        scale = {"pq": 1e-4, "pq_100": 1e-2}.get(name, 1.0)
        for direction in ("encode", "decode"):
            f = transfer.CURVES[name][direction == "decode"]
            # Light of the samples ranges beyond one for curves that reach further.
            one = (lambda f, k: lambda v: f(v) * k)(f, scale) if direction == "decode" else (lambda f, k: lambda v: f(v * (1 / k)))(f, scale)
            pixel_query(f"tf_{name}_{direction}", Op({c: one(ex(c)) for c in ALL}), view="samples")


def _chained(one: Op, other: Op) -> Op:
    """One operation after another on r, g and b."""
    return Op(other.out, *one.steps, {c: one.out[c] for c in ("r", "g", "b")}, *other.steps)


def _curve_ops() -> dict[str, Op]:
    s_shape = curves.fitted([(0.0, 0.0), (0.25, 0.15), (0.6, 0.7), (1.0, 1.0)])
    lift = curves.fitted([(0.0, 0.05), (0.5, 0.5), (1.0, 0.9)])
    zones = {
        "blacks": curves.Zone((1.2, 1.0, 0.9, 1.1), 0.4, 0.4), "shadows": curves.Zone((0.8, 1.1, 1.0, 1.2), 0.5, 0.0),
        "midtones": curves.Zone((1.3, 0.9, 1.0, 0.8), 0.4, 0.6), "highlights": curves.Zone((0.7, 1.2, 1.0, 1.1), 0.3, 1.0),
        "whites": curves.Zone((1.2, 0.9, 1.0, 0.95), 0.4, 0.5),
    }
    hues = {
        "hue_hue": curves.periodic([(0.0, 0.03), (0.33, 0.3), (0.66, 0.7)], climbs=True), "hue_sat": curves.periodic([(0.1, 1.2), (0.6, 0.8)]),
        "hue_lum": curves.periodic([(0.2, 1.1), (0.7, 0.9)]), "sat_sat": curves.fitted([(0.0, 0.0), (0.5, 0.6), (1.0, 1.0)]),
        "lum_sat": curves.fitted([(0.0, 0.8), (0.5, 1.0), (1.0, 1.2)]), "sat_lum": curves.fitted([(0.0, 1.0), (1.0, 1.1)]),
        "lum_lum": curves.fitted([(0.0, 0.0), (0.5, 0.55), (1.0, 1.0)]), "hue_fx": curves.periodic([(0.0, 0.0), (0.5, 0.02)]),
    }
    odt = gamut.rgb_to_rgb("aces_ap1", "srgb", "bradford")
    tone = color.tone_mapped()
    shown = {c: transfer.encode("srgb", color.clamp(e)) for c, e in color.matrixed(odt).out.items() if c != "a"}
    return {
        "gr_rgb_curves": curves.rgb_curves(s_shape, None, lift, s_shape),
        "gr_rgb_curves_inverse": curves.rgb_curves(s_shape, None, lift, s_shape, inverse=True),
        "gr_tone_log": curves.tone("log", **zones, s_contrast=1.3),
        "gr_tone_log_inverse": curves.tone("log", **zones, s_contrast=1.3, inverse=True),
        "gr_tone_video_soft": curves.tone("video", midtones=zones["midtones"], s_contrast=0.7),
        "gr_tone_linear": curves.tone("linear", midtones=curves.Zone((1.2, 1.0, 0.9, 1.1), 0.0, 5.0), highlights=curves.Zone((0.8, 1.0, 1.0, 1.0), -1.0, 4.0)),
        "gr_hue_curves_log": curves.hue_curves("log", **hues),
        "gr_hue_curves_vid": curves.hue_curves("vid", **hues),
        "ff_gamma_log": color.each(curves.gamma_log()),
        "ff_double_log": color.each(curves.double_log()),
        "ac_rrt_odt": Op({**shown, "a": "a"}, {f"t_{c}": tone.out[c] for c in color.RGB}, {c: f"t_{c}" for c in color.RGB}),
    }


def _color_queries() -> None:
    ops = {
        "ar_add_const": color.with_constant("add", (0.1, 0.2, 0.3)),
        "ar_sub_const": color.with_constant("sub", (0.25,)),
        "ar_mul_const": color.with_constant("mul", (2.0, 0.5)),
        "ar_div_const": color.with_constant("div", (0.0, 3.0)),
        "ar_abs": Op({c: Op({c: f"abs({c} - 0.5)"}).out[c] for c in ALL}),
        "ar_pow": color.raised((2.2, 1.5)),
        "ar_clamp": color.clamped((0.2,), (0.7, 0.8)),
        "ar_invert": Op({c: ex(1.0) - c for c in ALL}),
        "ar_mad": color.mad((2.0, 0.5), (0.1,)),
        "ar_normalize": color.normalized(0.5, 0.5, 0.5),
        "co_premult": color.premultiplied(),
        "co_unpremult": color.unpremultiplied(),
        "co_saturate": color.saturated(1.4),
        "co_contrast": color.contrast_remap(0.1, 0.9, 0.0, 1.0),
        "co_contrast_sigmoid": color.contrast_remap(0.1, 0.9, 0.0, 1.0, 5.0, 0.45),
        "co_contrast_step": color.contrast_remap(0.5, 0.5),
        "co_rangecompress": color.range_compressed(),
        "co_rangecompress_luma": color.range_compressed(True),
        "co_rangeexpand_luma": _chained(color.range_compressed(True), color.range_expanded(True)),
        "co_rangeexpand": color.each(lambda v: color.expand(least(v, 0.9))),  # the curve is infinite at 1
        "co_matrix4": color.matrixed4(np.array([[0.9, 0.1, 0, 0], [0.05, 0.8, 0.1, 0], [0, 0.1, 0.9, 0], [0, 0, 0.02, 1]])),
        "ga_rgb2xyz": color.matrixed(gamut.rgb_to_xyz("srgb")),
        "ga_xyz2rgb": color.matrixed(gamut.xyz_to_rgb("rec2020")),
        "ga_ap0_to_ap1": color.matrixed(gamut.rgb_to_rgb("aces_ap0", "aces_ap1")),
        "ga_p3_to_rec709_adapted": color.matrixed(gamut.rgb_to_rgb("dci_p3", "rec709", "bradford")),
        "ga_adapt_cat02": color.matrixed(gamut.adaptation("D60", "D65", "cat02")),
        "ga_adapt_vonkries": color.matrixed(gamut.adaptation("D50", "D65", "vonkries")),
        "gr_cdl": color.cdl((1.1, 1.0, 0.9), (0.02, 0.0, -0.02), (1.0, 1.2, 0.8), 1.1),
        "gr_cdl_noclamp": color.cdl((1.1, 1.0, 0.9), (-0.2, 0.0, -0.02), (1.0, 1.2, 0.8), 0.9, "noclamp"),
        "gr_exponent_clamp": color.exponent((2.2, 2.4, 1.8)),
        "gr_exponent_mirror": color.exponent((2.2, 2.4, 1.8), "mirror"),
        "gr_exponent_pass": color.exponent((2.2, 2.4, 1.8), "pass"),
        "gr_log_affine": color.log_affine(10.0, 0.3, 0.6, 0.9, 0.05),
        "gr_log_affine_inverse": color.log_affine(10.0, 0.3, 0.6, 0.9, 0.05, True),
        "gr_log_camera": color.log_camera(2.0, 0.07, 0.4, 1.0, 0.01, 0.005),
        "gr_log_camera_inverse": color.log_camera(2.0, 0.07, 0.4, 1.0, 0.01, 0.005, True),
        "gr_range": color.ranged(0.1, 0.8, 0.0, 1.0),
        "gr_range_unclamped": color.ranged(0.1, 0.8, 0.0, 1.0, False),
        "gr_ec_linear": color.exposure_contrast("linear", 0.5, 1.2, 1.1),
        "gr_ec_video": color.exposure_contrast("video", 0.5, 1.2, 0.9),
        "gr_ec_log": color.exposure_contrast("log", 0.5, 1.2, 1.0),
        "gr_primary_log": color.grading_primary("log", brightness=(10, 0, -10), contrast=(1.2, 1.1, 1), gamma=(1.2, 1, 0.9), saturation=1.1, low=-0.5, high=2.0),
        "gr_primary_linear": color.grading_primary("linear", offset=(0.01, 0, -0.01), exposure=(0.3, 0, -0.2), contrast=(1.2, 1.1, 1.05), saturation=0.9),
        "gr_primary_video": color.grading_primary("video", lift=(0.02, 0, 0.01), gain=(1.1, 1, 0.95), gamma=(1.2, 1.1, 0.9), offset=(0.01, 0, 0)),
        "gr_dynamic": color.dynamic_grade(0.3, 1.2, 1.1, 0.9),
        "gr_allocation_uniform": color.allocation("uniform", -0.2, 1.4),
        "gr_allocation_log2": color.allocation("log2", -8.0, 2.0, 0.004),
        "gr_allocation_log2_inverse": color.allocation("log2", -8.0, 2.0, 0.004, True),
        "ff_xyz_to_xyy": color.xyz_to_xyy(),
        "ff_xyy_to_xyz": color.xyy_to_xyz(),
        "ff_xyz_to_uvy": color.xyz_to_uvy(),
        "ff_uvy_to_xyz": color.uvy_to_xyz(),
        "ff_xyz_to_luv": color.xyz_to_luv(),
        "ff_luv_to_xyz": color.luv_to_xyz(),
        "ff_rgb_to_hsv": color.rgb_to_hsv(),
        "ff_hsv_to_rgb": color.hsv_to_rgb(),
        "ff_rgb_to_hsy_lin": color.rgb_to_hsy("lin"),
        "ff_rgb_to_hsy_log": color.rgb_to_hsy("log"),
        "ff_rgb_to_hsy_vid": color.rgb_to_hsy("vid"),
        "ff_hsy_to_rgb_log": color.hsy_to_rgb("log"),
        "ff_gamut_compress": color.gamut_compressed(),
        "ff_gamut_uncompress": color.gamut_compressed(True),
        "ff_red_modifier": color.red_modified(),
        "ff_red_modifier_03": color.red_modified("0.3"),
        "ff_red_modifier_inverse": color.red_modified(inverse=True),
        "gr_primary_log_inverse": color.grading_primary("log", brightness=(10, 0, -10), contrast=(1.2, 1.1, 1), gamma=(1.2, 1, 0.9), saturation=1.1, inverse=True),
        "gr_primary_linear_inverse": color.grading_primary("linear", offset=(0.01, 0, -0.01), exposure=(0.3, 0, -0.2), contrast=(1.2, 1.1, 1.05), saturation=0.9, inverse=True),
        "gr_primary_video_inverse": color.grading_primary("video", lift=(0.02, 0, 0.01), gain=(1.1, 1, 0.95), gamma=(1.2, 1.1, 0.9), offset=(0.01, 0, 0), inverse=True),
        "ff_glow": color.glowed(),
        "ff_glow_03": color.glowed(0.075, 0.1),
        "ff_glow_inverse": color.glowed(inverse=True),
        "ff_dark_to_dim": color.surround(),
        "ff_rec2100_surround": color.surround(1.2, color.REC2100_LUMA, 1e-4),
        "ch_sum": Op({"v": ex("r") * 0.5 + ex("g") * 0.25 + ex("b") * 0.25}),
        "ch_flatten": Op({"v": (ex("r") + "g" + "b" + "a") / 4.0}),
        "st_maxchan": Op({"v": "greatest(r, g, b, a)"}),
        "st_minchan": Op({"v": "least(r, g, b, a)"}),
    }
    ops |= _curve_ops()
    ops |= {f"co_map_{name}": color.color_mapped(name) for name in color.COLOR_MAPS}
    ops |= {f"ac_tone_{name}": color.tone_mapped(name) for name in color.TONE_PRESETS}
    shapes = {
        "inverse_lerp": (0.2, 0.7), "remap": (0.0, 1.0, -1.0, 2.0), "smoothstep": (0.2, 0.8), "smootherstep": (0.2, 0.8), "step": (0.5,),
        "pulse": (0.3, 0.6), "fract": (), "sign": (), "bias": (0.3,), "gain": (0.3,),
    }
    ops |= {f"ma_{k}": Op({c: transfer.shaping(k, ex(c), *p) for c in ALL}) for k, p in shapes.items()}
    for name, op in ops.items():
        pixel_query(name, op, 5 if name == "ff_luv_to_xyz" else 6)


_transfer_queries()
_color_queries()


def _sql_functions() -> None:
    """Functions called from SQL text."""
    hsv = color.rgb_to_hsv()
    names = {"code": transfer.CURVES["acescct"][0](ex("g")), "light": transfer.CURVES["slog3"][1](ex("b"))}

    def called(s, d):
        sql.register(s, ("acescct_encode", "slog3_decode", "rgb_to_hsv"))
        told = "SELECT image_id, y, x, acescct_encode(g) AS code, slog3_decode(b) AS light, rgb_to_hsv(r, g, b) AS hsv FROM {pixels}"
        return s.sql(told, pixels=rgba(s, d).df).select(*K, "code", "light", "hsv.r", "hsv.g", "hsv.b")

    both = f"SELECT h.image_id, h.y, h.x, {', '.join(f'{v.sql} AS {k}' for k, v in names.items())} FROM ({RGBA_SQL}) AS h"
    turned = hsv.sql(RGBA_SQL, K)
    table_query("sql_functions", called, f"SELECT c.*, t.r, t.g, t.b FROM ({both}) AS c JOIN ({turned}) AS t USING (image_id, y, x)", K, ("code", "light", "r", "g", "b"))


_sql_functions()
