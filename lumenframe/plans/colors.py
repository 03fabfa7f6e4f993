"""Queries of look-up tables and of conversions planned by the catalogue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import aces2, curves, icc, lut
from ..functions.color import each as color_each
from ..functions.color import hsy_to_rgb as color_hsy
from ..functions.expr import Op, clamp, ex
from ..functions.lut import Lut1D, Lut3D
from ..operators.adapters import load
from . import catalog, ir
from .base import K, RGBA, RGBA_SQL, image_query, pixel_query, register, rgba, rounded, table_query

CUBE = Lut3D.of(lambda c: np.stack([c[..., 0] ** 1.2, np.sqrt(c[..., 1]) * 0.9 + 0.1 * c[..., 2], c[..., 2] * (1 - 0.2 * c[..., 0])], axis=-1), 5)
CURVE = Lut1D.of(lambda x: x**2.2, 64)


def chain_query(name: str, transforms, digits: int = 6) -> None:
    image_query(name, lambda s, d: ir.applied(rgba(s, d), transforms), ir.as_sql(RGBA_SQL, transforms, K), RGBA, digits)


def _luts() -> None:
    pixel_query("lu_1d", CURVE.op())
    pixel_query("lu_1d_extrapolated", CURVE.op(True))
    pixel_query("lu_1d_inverse", CURVE.inverse(32).op())
    for method in ("trilinear", "tetrahedral", "nearest"):
        pixel_query(f"lu_3d_{method}", CUBE.op(method))
    big = Lut3D.of(lambda c: c**1.5, 33)
    # A cube of three curves is a curve for each channel.
    step = "least(floor(greatest(least({c}, 1.0), 0.0) * 32), 31)"
    at = lambda i: f"pow({i} / CAST(32 AS DOUBLE), CAST(1.5 AS DOUBLE))"
    curve = f"{at(step)} + ({at(f'({step} + 1)')} - {at(step)}) * (greatest(least({{c}}, 1.0), 0.0) * 32 - {step})"
    table_query(
        "lu_3d_33_arrow",
        lambda s, d: big.frame(rgba(s, d).df),
        f"SELECT image_id, y, x, {', '.join(f'{curve.format(c=c)} AS {c}' for c in 'rgb')}, a FROM ({RGBA_SQL}) AS p",
        K,
        RGBA,
    )


def _catalog() -> None:
    c = catalog.standard()
    chain_query("oc_convert_srgb_to_acescg", c.conversion("sRGB", "ACEScg"))
    chain_query("oc_convert_logc3_to_acescct", c.conversion("LogC3", "ACEScct"))
    chain_query("oc_convert_acescg_to_pq", c.conversion("scene_linear", "Rec.2100-PQ"))
    chain_query("oc_looks", c.with_looks("ACEScg", "sRGB", "+warm"))
    chain_query("oc_display", c.display("ACEScg", "sRGB", "Film"))
    chain_query("oc_optimized", [*c.conversion("sRGB", "ACEScg"), *c.conversion("ACEScg", "sRGB"), ir.Exponent((2.0, 2.0, 2.0)), ir.Exponent((0.75, 0.75, 0.75))])
    chain_query("oc_exposure", [ir.ExposureContrast("linear", 0.5, 1.2), *c.conversion("ACEScg", "Display P3")])
    path = "CASE WHEN page_id % 3 = 0 THEN 'shots/plate' || page_id || '.dpx' WHEN page_id % 3 = 1 THEN 'tex/wood_diff.' || page_id || '.png' ELSE 'out.' || page_id || '.exr' END"
    table_query(
        "oc_filerules",
        lambda s, d: load(s, d, "pages").select("page_id", F.expr(path).alias("path")).select("page_id", c.space_of_path(F.col("path")).alias("space")),
        f"SELECT page_id, CASE WHEN path LIKE '%.exr' THEN 'ACEScg' WHEN path LIKE '%\\_diff.%' ESCAPE '\\' THEN 'sRGB' WHEN path LIKE '%plate%.dpx' THEN 'LogC3' ELSE 'raw' END AS space "
        f"FROM (SELECT page_id, {path} AS path FROM pages) AS p",
        ["page_id", "space"],
    )
    broken = catalog.standard()
    broken.roles["compositing"] = "nowhere"
    broken.displays["P3"].append(catalog.View("Bad", "missing", "gone"))

    def lint(s, _):
        return s.createDataFrame(broken.issues(), "severity string, message string").groupBy("severity").agg(F.count("*").alias("n"))

    table_query("oc_validate", lint, "SELECT 'error' AS severity, CAST(3 AS BIGINT) AS n", ["severity", "n"])
    n = 9
    grid = {c_: ex(p).cast("DOUBLE") / float(n - 1) for c_, p in (("r", "ri"), ("g", "gi"), ("b", "bi"))}
    place = Op({**grid, "a": 1.0})
    baked = c.conversion("ACEScct", "sRGB")

    def bake(s, _):
        at = s.range(n**3).select(F.expr(f"CAST(id div {n * n} AS INT)").alias("ri"), F.expr(f"CAST(id div {n} % {n} AS INT)").alias("gi"), F.expr(f"CAST(id % {n} AS INT)").alias("bi"))
        df = place.frame(at, ["ri", "gi", "bi"])
        for op in ir.compiled(baked):
            df = op.frame(df, ["ri", "gi", "bi"])
        return df

    at_sql = f"SELECT CAST(i // {n * n} AS INT) AS ri, CAST(i // {n} % {n} AS INT) AS gi, CAST(i % {n} AS INT) AS bi FROM range({n**3}) AS b(i)"
    table_query("oc_bake", bake, ir.as_sql(place.sql(at_sql, ["ri", "gi", "bi"]), baked, ["ri", "gi", "bi"]), ["ri", "gi", "bi"], RGBA)


#: Transforms as a configuration writes them, one for each kind.
TRANSFORMS = {
    "matrix4": "!<MatrixTransform> {matrix: [1.1, 0.1, 0, 0.05, 0, 0.9, 0.1, 0, 0.05, 0, 1, 0, 0.02, 0, 0, 0.9], offset: [0.01, 0, 0.02, 0.05]}",
    "exponent_linear": "!<ExponentWithLinearTransform> {gamma: [2.4, 2.2, 2.6, 1], offset: [0.055, 0.099, 0.02, 0]}",
    "exponent_linear_back": "!<ExponentWithLinearTransform> {gamma: [2.4, 2.2, 2.6, 1], offset: [0.055, 0.099, 0.02, 0], style: mirror, direction: inverse}",
    "log_affine": "!<LogAffineTransform> {base: 10, log_side_slope: [0.3, 0.25, 0.2], log_side_offset: [0.5, 0.4, 0.3], lin_side_slope: 1.2, lin_side_offset: 2}",
    "log_camera": "!<LogCameraTransform> {base: 10, log_side_slope: [0.3, 0.25, 0.2], log_side_offset: 0.4, lin_side_slope: 5, lin_side_offset: 0.06, lin_side_break: 0.01}",
    "log_camera_back": "!<LogCameraTransform> {base: 10, logSideSlope: 0.25, logSideOffset: 0.4, linSideSlope: 5, linSideOffset: 0.06, linSideBreak: 0.01, direction: inverse}",
    "range": "!<RangeTransform> {min_in_value: 0.1, max_in_value: 0.9, min_out_value: 0, max_out_value: 1}",
    "allocation": "!<AllocationTransform> {allocation: lg2, vars: [-8, 5, 0.5]}",
    "allocation_back": "!<AllocationTransform> {allocation: uniform, vars: [-0.2, 1.4], direction: inverse}",
    "primary": "!<GradingPrimaryTransform> {lift: [0.02, 0, -0.02], gamma: [1.1, 1, 0.9], gain: [1.2, 1, 0.8], offset: 0.01, exposure: 0.2, contrast: 1.1, saturation: 0.8, clamp_black: 0, clamp_white: 2}",
    "primary_back": "!<GradingPrimaryTransform> {lift: [0.02, 0, -0.02], gamma: [1.1, 1, 0.9], gain: [1.2, 1, 0.8], offset: 0.01, contrast: 1.1, saturation: 0.8, direction: inverse}",
    "primary_video": "!<GradingPrimaryTransform> {style: video, gamma: {rgb: [1.1, 1, 0.9], master: 1.2}, gain: {rgb: [1.1, 1, 1], master: 1}, lift: {rgb: [0, 0.01, 0], master: 0.02}}",
    "tone": "!<GradingToneTransform> {shadows: [1.1, 1, 0.9, 1.05], midtones: [1, 1.1, 1, 1], highlights: [0.9, 1, 1, 1], blacks: [0.01, 0, 0, 0.01], whites: [1, 1, 1.1, 1]}",
    "tone_video": "!<GradingToneTransform> {style: video, midtones: {rgb: [1.2, 1, 0.9], master: 1.1, center: 0.4, width: 0.6}, s_contrast: 1.2}",
    "curves": "!<GradingRGBCurveTransform> {red: [[0, 0], [0.4, 0.5], [1, 1.1]], master: [0, 0.05, 0.5, 0.55, 1, 1]}",
    "hue": "!<GradingHueCurveTransform> {style: linear, hue_sat: [[0.1, 1.2], [0.5, 0.8]], lum_lum: [[-7, -7], [0, 0.2], [5, 5]], hue_lum: [[0.2, 1.1], [0.7, 0.9]]}",
    "hue_back": "!<GradingHueCurveTransform> {style: video, hue_hue: [[0.1, 0.15], [0.5, 0.5], [0.8, 0.82]], sat_sat: [[0, 0], [0.5, 0.6], [1, 1.2]], hue_fx: [[0.2, 0.02], [0.7, -0.02]], direction: inverse}",
    "lut1d": "!<Lut1DTransform> {length: 5, values: [0, 0.1, 0.35, 0.7, 1.1]}",
    "lut3d": "!<Lut3DTransform> {gridSize: 2, interpolation: tetrahedral, values: [0, 0, 0, 0.1, 0, 0.9, 0, 1, 0.1, 0, 0.9, 1, 1, 0.1, 0, 0.9, 0, 1, 1, 0.9, 0.2, 1, 1, 1]}",
    "fixed_hsy": "!<GroupTransform> {children: [!<FixedFunctionTransform> {style: RGB_TO_HSY_LIN}, !<MatrixTransform> {matrix: [1, 0, 0, 0, 0, 0.8, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]}, !<FixedFunctionTransform> {style: HSY_LIN_TO_RGB}]}",
    "fixed_pq": "!<FixedFunctionTransform> {style: LIN_TO_PQ}",
    "fixed_gamma_log": "!<FixedFunctionTransform> {style: LIN_TO_GAMMA_LOG, params: [0, 0.08333333333333333, 0.5, 1.7320508075688772, 0, 2.718281828459045, 0.17883277, 0.55991073, 12, -0.28466892]}",
    "fixed_gamma_log_back": "!<FixedFunctionTransform> {style: GAMMA_LOG_TO_LIN}",
    "fixed_double_log": "!<FixedFunctionTransform> {style: LIN_TO_DOUBLE_LOG, params: [10, 0, 0.5, -0.2, 0.2, -1, 0.3, 0.3, 0.7, 1, 0.4, 0.8, 0.3]}",
    "fixed_double_log_back": "!<FixedFunctionTransform> {style: DOUBLE_LOG_TO_LIN}",
    "fixed_surround": "!<FixedFunctionTransform> {style: REC2100_SURROUND, params: [1.2]}",
    "exposure_back": "!<ExposureContrastTransform> {style: video, exposure: 0.5, contrast: 1.2, pivot: 0.2, direction: inverse}",
    "exposure_log_back": "!<ExposureContrastTransform> {style: log, exposure: 0.5, contrast: 1.2, pivot: 0.2, direction: inverse}",
}
#: Built-in styles, of which each part of the tables is taken once.
STYLES = {
    "venice": "SONY_SLOG3-SGAMUT3.CINE-VENICE_to_ACES2065-1", "alexa": "ARRI_ALEXA-LOGC-EI800-AWG_to_ACES2065-1", "proxy": "ACESproxy10i_to_ACES2065-1",
    "adx10": "ADX10_to_ACES2065-1", "adx16": "ADX16_to_ACES2065-1", "blue_light": "ACES-LMT - BLUE_LIGHT_ARTIFACT_FIX",
    "gamut": "ACES-LMT - ACES 1.3 Reference Gamut Compression", "dci": "DISPLAY - CIE-XYZ-D65_to_G2.6-P3-DCI-BFD", "dcdm": "DISPLAY - CIE-XYZ-D65_to_DCDM-D65",
    "mirror": "DISPLAY - CIE-XYZ-D65_to_REC.1886-REC.709 - MIRROR NEGS", "p3hdr": "DISPLAY - CIE-XYZ-D65_to_DisplayP3-HDR", "pq_p3": "DISPLAY - CIE-XYZ-D65_to_ST2084-P3-D65",
    "hlg": "DISPLAY - CIE-XYZ-D65_to_REC.2100-HLG-1000nit", "rec709": "UTILITY - ACES-AP1_to_LINEAR-REC709_BFD", "curve": "CURVE - LINEAR_to_ST-2084",
    "sdr1": "ACES-OUTPUT - ACES2065-1_to_CIE-XYZ-D65 - SDR-VIDEO_1.0",
}


def _configured() -> None:
    for name, text in TRANSFORMS.items():
        chain_query(f"oc_cfg_{name}", catalog.transform(catalog.parse_yaml(f"t: {text}")["t"]))
    for name, style in STYLES.items():
        # Densities of a third of the range, beyond which light grows past what six digits tell.
        first = [ir.Matrix(np.eye(3) * 0.3)] if name == "adx16" else []
        chain_query(f"oc_style_{name}", [*first, *catalog.builtin(style)])
    again = catalog.load(catalog.dumped(catalog.standard()))
    chain_query("oc_dumped", again.display("ACEScg", "sRGB", "Film"))
    hue = {"hue_hue": curves.periodic([(0.1, 0.12), (0.6, 0.62)], True), "lum_sat": curves.fitted([(0, 1.0), (0.5, 1.2), (1.0, 0.9)]), "sat_lum": curves.fitted([(0, 1.0), (1.0, 1.1)])}
    for style in ("lin", "log"):
        pixel_query(f"gr_hue_curves_{style}_gains", curves.hue_curves(style, **hue))
        # Colours near grey, which the curves reach.
        chain_query(f"gr_hue_curves_{style}_back", [ir.Matrix(np.full((3, 3), 0.1) + np.eye(3) * 0.1, (0.2,) * 3), _Ready(curves.hue_curves(style, True, **hue))])
    pixel_query("ff_hsy_lin_to_rgb", color_hsy("lin"))
    n = 9

    def table_of(s, _):
        cube = ir.baked(s, again.conversion("ACEScct", "sRGB"), n)
        rows = [(r, g, b, *map(float, cube.cube[r, g, b])) for r in range(n) for g in range(n) for b in range(n)]
        return s.createDataFrame(rows, "ri int, gi int, bi int, r double, g double, b double")

    grid = Op({**{c_: ex(p).cast("DOUBLE") / float(n - 1) for c_, p in (("r", "ri"), ("g", "gi"), ("b", "bi"))}, "a": 1.0})
    at_sql = f"SELECT CAST(i // {n * n} AS INT) AS ri, CAST(i // {n} % {n} AS INT) AS gi, CAST(i % {n} AS INT) AS bi FROM range({n**3}) AS b(i)"
    keys = ["ri", "gi", "bi"]
    table_query("oc_baked", table_of, ir.as_sql(grid.sql(at_sql, keys), catalog.standard().conversion("ACEScct", "sRGB"), keys), keys, ("r", "g", "b"))


def _appearance() -> None:
    pixel_query("ac2_jmh", aces2.rgb_to_jmh())
    chain = lambda ops: [_Ready(op) for op in ops]
    chain_query("ac2_jmh_there_and_back", chain([aces2.rgb_to_jmh(), aces2.jmh_to_rgb()]))
    for peak in (100.0, 1000.0):
        pixel_query(f"ac2_tonescale_{int(peak)}", color_each(aces2.ToneScale(peak).forward))
    chain_query("ac2_tone_scaled", chain([aces2.rgb_to_jmh(), aces2.tone_scaled(), aces2.jmh_to_rgb()]))
    # Scene light up to 4, a little of it negative.
    lit = ir.Matrix(np.eye(3) * 2.0)
    for peak, limit in ((100.0, "rec709"), (1000.0, "display_p3"), (500.0, "rec2020")):
        chain_query(f"ac2_output_{limit}", [lit, *chain(aces2.output_transform(peak, limit))])
    # Colours well inside the gamut, where the way back is steady.
    inside = ir.Matrix(np.full((3, 3), 0.1) + np.eye(3) * 0.2, (0.2,) * 3)
    chain_query("ac2_output_rec709_back", [inside, *chain(aces2.output_transform(100.0, "rec709", True))])
    chain_query("ac2_tone_back", chain([aces2.rgb_to_jmh(), aces2.tone_scaled(), aces2.tone_scaled(inverse=True), aces2.jmh_to_rgb()]))
    pixel_query("ac2_gamut_fitted", _jmh_of_channels())


CLF = [
    ("matrix", (np.array([[1.1, 0.05, 0], [0, 0.95, 0.02], [0.01, 0, 0.9]]), np.array([0.01, 0.0, -0.01]))), ("range", (0.0, 1.0, 0.1, 0.9, True)),
    ("lut1d", Lut1D(np.linspace(0, 1, 9)[:, None] ** 1.5)), ("exponent", ("basicFwd", {"exponent": 1.2})),
    ("log", ("linToLog", {"base": 10.0, "logSideSlope": 0.3, "logSideOffset": 0.5, "linSideSlope": 1.2, "linSideOffset": 0.4})),
]
CORRECTION = """<ColorDecisionList><ColorDecision><ColorCorrection id="a"><SOPNode><Slope>1.1 1 0.9</Slope><Offset>0.02 0 -0.02</Offset><Power>1.2 1 0.9</Power></SOPNode>
<SatNode><Saturation>0.8</Saturation></SatNode></ColorCorrection></ColorDecision></ColorDecisionList>"""


def _written_tables() -> None:
    """Tables and corrections as texts of their formats, read again, against the values they were made of."""
    chain_query("lu_cube_file", catalog.from_file("x.cube", lut.write_cube(CUBE)))
    chain_query("lu_spi1d_file", catalog.from_file("x.spi1d", lut.write_spi1d(CURVE)))
    chain_query("lu_spi3d_file", catalog.from_file("x.spi3d", lut.write_spi3d(CUBE)))
    chain_query("lu_spimtx_file", catalog.from_file("x.spimtx", lut.write_spimtx(np.diag([1.2, 1.0, 0.8]), (0.1, 0.0, -0.1))))
    chain_query("lu_clf_file", catalog.from_file("x.clf", lut.write_clf(CLF)))
    chain_query("lu_correction_file", catalog.from_file("x.cdl", CORRECTION))
    p3 = icc.named("display_p3", icc.Curve(*icc.SRGB))
    again = icc.read(icc.write(p3))
    chain_query("icc_srgb_to_p3", icc.conversion(icc.srgb(), again))
    chain_query("icc_p3_to_linear", icc.conversion(again, icc.named("aces_ap1"), "relative"))
    chain_query("icc_absolute", icc.conversion(icc.srgb(), icc.named("prophoto", icc.Curve(1.8)), "absolute"))
    table = icc.Profile(p3.matrix, (icc.Curve(table=tuple(np.linspace(0, 1, 33) ** 2.0)),) * 3, p3.adaptation)
    chain_query("icc_table", icc.conversion(table, icc.named("display_p3")))


def _jmh_of_channels() -> Op:
    """The gamut compression of colours whose J, M and h are made of the channels."""
    fitted = aces2.gamut_fitted()
    first = {"r": ex("r") * 60.0 + 20.0, "g": clamp(ex("g"), 0.0, 2.0) * 80.0, "b": clamp(ex("b"), 0.0, 0.999) * 360.0}
    return Op(fitted.out, first, *fitted.steps)


class _Ready:
    """An operation as a transform of a chain."""

    def __init__(self, op: Op):
        self._op = op

    def identity(self) -> bool:
        return False

    def op(self) -> Op:
        return self._op


_luts()
_catalog()
_configured()
_written_tables()
_appearance()
