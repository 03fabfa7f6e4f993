"""Functions and plans against published values and each other."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import color, gamut, lut, transfer
from lumenframe.functions.expr import Op, ex
from lumenframe.operators import filters, geometry, image, stats
from lumenframe.plans import catalog, ir


def column(spark, values, f):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return np.array([r.o for r in df.select("i", f(ex("v")).col.alias("o")).orderBy("i").collect()])


RAMP = np.linspace(0, 1, 256)
GOLDEN = {  # minimum, maximum, mean and deviation of a curve over a grey ramp
    "apple_log": (-0.0564109, 12.0000019, 1.4866019, 2.6281667),
    "clog2": (-0.0147269, 59.2345009, 6.2912736, 12.2666864),
    "clog3": (-0.0738133, 14.6683016, 2.3025289, 3.4752867),
    "pq_100": (0.0, 100.0, 10.8352318, 20.7775612),
    "acescct": (-0.0069169, 222.8610840, 18.7180748, 42.2506714),
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden_curves(spark, name):
    out = column(spark, RAMP, transfer.CURVES[name][1])
    assert np.allclose([out.min(), out.max(), out.mean(), out.std()], GOLDEN[name], atol=2e-4, rtol=2e-5)


@pytest.mark.parametrize("name", sorted(transfer.CURVES))
def test_curves_round_trip(spark, name):
    values = np.array([0.001, 0.01, 0.02, 0.05, 0.18, 0.5, 0.9, 1.0])
    encode, decode = transfer.CURVES[name]
    light = values * {"pq": 1000}.get(name, 1)
    assert np.allclose(column(spark, light, lambda v: decode(encode(v))), light, rtol=3e-3, atol=1e-5)


def test_sql_functions(spark):
    from lumenframe.functions import sql

    names = sql.register(spark, prefix="lf_")
    assert {"lf_srgb_encode", "lf_pq_decode", "lf_rgb_to_hsv"} <= set(names) and len(names) == 2 * len(transfer.CURVES) + len(sql.OPERATIONS)
    row = spark.sql("SELECT lf_srgb_decode(0.5) AS v, lf_hsv_to_rgb(lf_rgb_to_hsv(0.2, 0.5, 0.9).r, lf_rgb_to_hsv(0.2, 0.5, 0.9).g, 0.9) AS c").first()
    assert row.v == pytest.approx(((0.5 + 0.055) / 1.055) ** 2.4) and (row.c.r, row.c.g, row.c.b) == pytest.approx((0.2, 0.5, 0.9))


def test_published_code_values(spark):
    assert np.allclose(column(spark, [0.0, 0.0078125], lambda v: transfer.encode("acescct", v)), [0.0729055, 0.15525114], atol=1e-6)
    assert np.allclose(column(spark, [0.18], lambda v: transfer.encode("slog3", v)), [420 / 1023], atol=1e-6)
    assert np.allclose(column(spark, [100.0], lambda v: transfer.encode("pq", v)), [0.508078], atol=1e-5)


def test_matrices():
    assert np.allclose(gamut.rgb_to_xyz("srgb") @ [1, 1, 1], gamut.white_xyz("D65"))
    assert np.allclose(gamut.rgb_to_xyz("srgb")[1], [0.2126, 0.7152, 0.0722], atol=2e-4)
    cube = np.stack(np.meshgrid(*[np.linspace(0, 1, 8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    out = cube @ gamut.rgb_to_rgb("aces_ap0", "aces_ap1").T
    assert np.allclose([out.min(), out.max(), out.mean(), out.std()], [-0.4514393, 1.4514393, 0.5, 0.4054831], atol=1e-5)
    for method in gamut.CONES:
        a = gamut.adaptation("D60", "D65", method)
        assert np.allclose(a @ gamut.white_xyz("D60"), gamut.white_xyz("D65"))


def rgb_frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(rows)], "i int, r double, g double, b double, a double")


def run(spark, rows, *ops):
    df = rgb_frame(spark, rows)
    for op in ops:
        df = op.frame(df, ["i"])
    return np.array([[r.r, r.g, r.b] for r in df.orderBy("i").collect()])


CUBE8 = np.stack(np.meshgrid(*[np.linspace(0, 1, 8)] * 3, indexing="ij"), -1).reshape(-1, 3)


#: Published statistics (least, greatest, mean, deviation) of code values 0 to 255 decoded. Fixed values.
GOLDEN_CURVES = {
    "apple_log": (-0.0564109, 12.0000019, 1.4866019, 2.6281667),
    "clog2": (-0.0147269, 59.2345009, 6.2912736, 12.2666864),
    "clog3": (-0.0738133, 14.6683016, 2.3025289, 3.4752867),
    "pq_100": (0.0, 100.0, 10.8352318, 20.7775612),
    "hlg": (0.0, 3.0, 0.5726982, 0.7275777),
    "acescct": (-0.0069169, 222.8610840, 18.7180748, 42.2506714),
}
#: The same of a colour cube of 8 steps through matrices and colour decisions. Fixed values.
GOLDEN_CUBES = {
    "srgb_to_xyz": (0.0, 1.0888300, 0.5065500, 0.2558608),
    "ap0_to_ap1": (-0.4514393, 1.4514393, 0.5, 0.4054831),
    "identity": (0.0, 1.0, 0.5, 0.3273268),
    "warmup": (0.0, 1.0, 0.4955523, 0.3361615),
    "contrast": (0.0, 0.8812404, 0.3723364, 0.3046936),
}
#: The published matrix from sRGB to XYZ. Fixed values.
SRGB_TO_XYZ = [[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]


def statistics(x):
    return [x.min(), x.max(), x.mean(), x.std()]


@pytest.mark.parametrize("name", sorted(GOLDEN_CURVES))
def test_golden_curves(spark, name):
    got = column(spark, np.linspace(0, 1, 256), lambda v: transfer.decode(name, v))
    # The published HLG light is 3 where that of the curve is 1.
    assert np.allclose(statistics(got * (3 if name == "hlg" else 1)), GOLDEN_CURVES[name], rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("name", sorted(GOLDEN_CUBES))
def test_golden_cubes(spark, name):
    op = {
        "srgb_to_xyz": color.matrixed(np.array(SRGB_TO_XYZ)),
        "ap0_to_ap1": color.matrixed(gamut.rgb_to_rgb("aces_ap0", "aces_ap1")),
        "identity": color.cdl((1, 1, 1), (0, 0, 0), (1, 1, 1)),
        "warmup": color.cdl((1.1, 1.0, 0.9), (0.02, 0.0, -0.02), (1, 1, 1), 1.1),
        "contrast": color.cdl((1, 1, 1), (-0.1,) * 3, (1.2,) * 3),
    }[name]
    assert np.allclose(statistics(run(spark, CUBE8, op)), GOLDEN_CUBES[name], atol=1e-5)


#: Published matrices to XYZ, and adaptations from D65 to D50. Fixed values.
TO_XYZ = {
    "rec2020": [[0.6369580, 0.1446169, 0.1688810], [0.2627002, 0.6779981, 0.0593017], [0.0, 0.0280727, 1.0609851]],
    "aces_ap0": [[0.9525523959, 0.0, 0.0000936786], [0.3439664498, 0.7281660966, -0.0721325464], [0.0, 0.0, 1.0088251844]],
    "aces_ap1": [[0.6624541811, 0.1340042065, 0.1561876870], [0.2722287168, 0.6740817658, 0.0536895174], [-0.0055746495, 0.0040607335, 1.0103391003]],
}
TO_D50 = {
    "bradford": [[1.0478112, 0.0228866, -0.0501270], [0.0295424, 0.9904844, -0.0170491], [-0.0092345, 0.0150436, 0.7521316]],
    "cat02": [[1.0425731, 0.0308912, -0.0528126], [0.0221935, 1.0018566, -0.0210738], [-0.0011648, -0.0034205, 0.7617891]],
}


@pytest.mark.parametrize("name", ["rec2020", "aces_ap0", "aces_ap1"])
def test_published_gamuts(name):
    assert np.allclose(gamut.rgb_to_xyz(name), TO_XYZ[name], atol=1e-3)


@pytest.mark.parametrize("name", sorted(TO_D50))
def test_published_adaptations(name):
    assert np.allclose(gamut.adaptation("D65", "D50", name), TO_D50[name], atol=6e-4)


def test_restated_cases(spark):
    """Slope 2 and offset 0.1 of greys, an exposure of one stop, pivoted contrast, ranges, and the log curves' values."""
    grey = [[0.0] * 3, [0.5] * 3]
    assert np.allclose(run(spark, grey, color.cdl((2,) * 3, (0.1,) * 3, (1,) * 3, style="noclamp")), [[0.1] * 3, [1.1] * 3])
    assert np.allclose(run(spark, CUBE8, color.exposure_contrast("linear", 1.0, 1.0)), CUBE8 * 2)
    assert np.allclose(run(spark, [[0.18] * 3], color.exposure_contrast("linear", 0.0, 1.5)), 0.18, atol=1e-9)
    assert np.allclose(run(spark, [[0.0] * 3, [0.5] * 3, [1.0] * 3], color.ranged(0, 1, -1, 1, True))[:, 0], [-1, 0, 1])
    assert np.allclose(run(spark, CUBE8, color.ranged(0, 1, 0, 1, False)), CUBE8)
    assert np.allclose(run(spark, [[0.5] * 3], color.matrixed(np.diag([1.2, 1.0, 0.8]))), [[0.6, 0.5, 0.4]])
    assert np.allclose(column(spark, [0.0, 0.0078125, 0.18, 1.0], lambda v: transfer.encode("acescct", v)), [0.0729055341958355, 0.155251141552511, 0.4135, 0.5548], atol=2e-4)
    assert np.allclose(column(spark, [0.18, 1.0], lambda v: transfer.encode("acescc", v)), [0.4135, 0.5548], atol=2e-4)
    assert run(spark, [[1.0, 0.2, 0.1]], color.red_modified())[0][0] <= 1.0
    curve = lut.Lut1D.of(lambda x: x**2.2, 256)
    at = np.linspace(0, 1, 97)
    assert np.allclose(run(spark, np.stack([at] * 3, 1), curve.op())[:, 1], np.interp(at, np.linspace(0, 1, 256), np.linspace(0, 1, 256) ** 2.2))


def test_golden_matrices():
    assert np.allclose(gamut.rgb_to_xyz("srgb"), SRGB_TO_XYZ, atol=1e-3)
    want = [[1.4514393161, -0.2365107469, -0.2149285693], [-0.0765537734, 1.1762296998, -0.0996759264], [0.0083161484, -0.0060324498, 0.9977163014]]
    assert np.allclose(gamut.rgb_to_rgb("aces_ap0", "aces_ap1"), want, atol=1e-8)


@pytest.mark.parametrize(
    ("forward", "back"),
    [(color.rgb_to_hsv(), color.hsv_to_rgb()), (color.rgb_to_hsy("log"), color.hsy_to_rgb("log")), (color.rgb_to_hsy("vid"), color.hsy_to_rgb("vid")),
     (color.xyz_to_xyy(), color.xyy_to_xyz()), (color.xyz_to_uvy(), color.uvy_to_xyz()), (color.xyz_to_luv(), color.luv_to_xyz()),
     (color.gamut_compressed(), color.gamut_compressed(True)), (color.glowed(), color.glowed(inverse=True))],
)
def test_inverses(spark, forward, back):
    rows = np.random.default_rng(0).random((60, 3)) * 0.8 + 0.1
    assert np.allclose(run(spark, rows, forward, back), rows, atol=1e-6)


def test_tables_agree_with_numpy(spark):
    rows = np.random.default_rng(1).random((80, 3)) * 1.2 - 0.1
    cube = lut.Lut3D.of(lambda c: c**1.5 + 0.1 * c[..., ::-1], 5)
    for method in ("trilinear", "tetrahedral"):
        want = cube.apply(rows, method)
        assert np.allclose(run(spark, rows, cube.op(method)), want, atol=1e-12)
        got = cube.frame(rgb_frame(spark, rows), method).orderBy("i").collect()
        assert np.allclose([[r.r, r.g, r.b] for r in got], want, atol=1e-12)
    same = lut.identity3d(9)
    inside = np.clip(rows, 0, 1)
    assert np.allclose(same.apply(rows, "tetrahedral"), inside) and np.allclose(same.apply(rows), inside)
    curve = lut.Lut1D.of(lambda x: x**2.2, 512)
    assert np.allclose(run(spark, inside, curve.op(), curve.inverse(4096).op()), inside, atol=6e-3)


def test_table_formats():
    cube = lut.Lut3D(np.random.default_rng(2).random((4, 4, 4, 3)))
    assert np.allclose(lut.parse(lut.write_cube(cube, "t"), ".cube").cube, cube.cube)
    assert np.allclose(lut.parse(lut.write_spi3d(cube), "spi3d").cube, cube.cube)
    curve = lut.Lut1D(np.random.default_rng(3).random((7, 3)), -0.5, 2.0)
    for text, kind in ((lut.write_cube(curve), "cube"), (lut.write_spi1d(curve), "spi1d")):
        got = lut.parse(text, kind)
        assert np.allclose(got.tables, curve.tables) and (got.low, got.high) == (-0.5, 2.0)
    rows = cube.cube.reshape(-1, 3)
    dl = "0 341 682 1023\n" + "\n".join(" ".join(str(round(v * 1023)) for v in r) for r in rows)
    assert np.allclose(lut.parse(dl, "3dl").cube, cube.cube, atol=1e-3)
    m, o = lut.parse("1 0 0 655.35\n0 2 0 0\n0 0 3 0", "spimtx")
    assert np.allclose(m, np.diag([1, 2, 3])) and np.allclose(o, [0.01, 0, 0])
    assert np.allclose(lut.parse(lut.write_spimtx(m, o), "spimtx")[0], m)
    c = lut.Cdl((1.1, 1.0, 0.9), (0.1, 0.0, 0.0), (1.0, 2.0, 1.0), 0.8, "x")
    assert lut.parse_cdl(lut.write_cdl([c, c]))[1] == c
    clf = '<ProcessList><Matrix inBitDepth="32f" outBitDepth="32f"><Array dim="3 3">1.2 0 0 0 1 0 0 0 0.8</Array></Matrix><Range style="Clamp"><minInValue>0</minInValue><maxInValue>1</maxInValue><minOutValue>0</minOutValue><maxOutValue>1</maxOutValue></Range></ProcessList>'
    chain = catalog.from_file("x.clf", clf)
    assert np.allclose(chain[0].m, np.diag([1.2, 1, 0.8])) and chain[1] == ir.Range(0, 1, 0, 1)


def test_more_table_formats():
    cube = lut.Lut3D(np.random.default_rng(4).random((3, 3, 3, 3)).astype(np.float32).astype(float))
    red_fastest = cube.cube.transpose(2, 1, 0, 3).reshape(-1, 3)
    numbers = "\n".join(" ".join(map(repr, map(float, r))) for r in red_fastest)
    assert np.allclose(lut.parse(f"LUT_3D_SIZE 3\n{numbers}", "itx").cube, cube.cube)
    assert np.allclose(lut.parse(f"Version 3\nType 3D\nFrom 0.0 1.0\nTo 0 1\nLength 3\nLUT:\n3D {{\n{numbers}\n}}", "lut").cube, cube.cube)
    curve = lut.parse("Version 1\nType RGB\nFrom -1 2\nLength 3\nLUT:\nR { 0 0.25 1 }\nG { 0 0.5 1 }\nB { 0 0.75 1 }", "lut")
    assert curve.tables.shape == (3, 3) and (curve.low, curve.high, curve.tables[1, 2]) == (-1, 2, 0.75)
    data = red_fastest.astype("<f4").tobytes().hex()
    assert np.allclose(lut.parse(f"<look><LUT><size>3</size><data>{data}</data></LUT></look>", "look").cube, cube.cube)
    csp = f"CSPLUTV100\n3D\n\n2\n0 1\n0 1\n2\n0 1\n0 1\n2\n0 1\n0 1\n\n3 3 3\n{numbers}\n"
    assert np.allclose(lut.parse(csp, "csp").cube, cube.cube)
    blue_fastest = "\n".join(" ".join(map(repr, map(float, r))) for r in cube.cube.reshape(-1, 3))
    assert np.allclose(lut.parse(f"#Inventor V2.1 ascii\ngrid_size 3 3 3\ndata\n{blue_fastest}", "vf").cube, cube.cube)
    assert np.allclose(lut.parse("LUT: 3 4\n" + "\n".join(map(str, [0, 85, 170, 255] * 3)), "1dl").tables[:, 1], [0, 1 / 3, 2 / 3, 1])


@pytest.mark.parametrize("style", ["log", "linear", "video"])
def test_primary_grades_invert(spark, style):
    rows = np.random.default_rng(12).random((30, 3)) * 0.8 + 0.1
    how = {
        "log": {"brightness": (10, 0, -10), "contrast": (1.2, 1.1, 1), "gamma": (1.2, 1, 0.9)},
        "linear": {"offset": (0.01, 0, -0.01), "exposure": (0.3, 0, -0.2), "contrast": (1.2, 1.1, 1.05)},
        "video": {"lift": (0.02, 0, 0.01), "gain": (1.1, 1, 0.95), "gamma": (1.2, 1.1, 0.9), "offset": (0.01, 0, 0)},
    }[style]
    both = [color.grading_primary(style, **how, saturation=1.2, inverse=i) for i in (False, True)]
    assert np.allclose(run(spark, rows, *both), rows, atol=1e-9)


def test_red_modifier_inverts(spark):
    rows = np.array([[0.8, 0.1, 0.12], [0.5, 0.2, 0.1], [0.1, 0.7, 0.2]])
    # The way back weighs the hue of the modified colour, so it is near, not exact.
    assert np.allclose(run(spark, rows, color.red_modified(), color.red_modified(inverse=True)), rows, atol=1e-2)


CONFIG = """
# a configuration
ocio_profile_version: 2
environment: {SHOT: sh010}
search_path: luts:more
roles:
  scene_linear: lin
  default: raw
colorspaces:
  - !<ColorSpace>
    name: lin
    aliases: [linear, "Linear Light"]
    encoding: scene-linear
    isdata: false
  - !<ColorSpace>
    name: tv
    family: display
    categories: [file-io]
    from_reference: !<GroupTransform>
      children:
        - !<MatrixTransform> {matrix: [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1]}
        - !<ExponentTransform> {value: [2, 2, 2, 1], direction: inverse}
  - !<ColorSpace>
    name: raw
    isdata: true
looks:
  - !<Look>
    name: dim
    process_space: lin
    transform: !<CDLTransform> {slope: [0.5, 0.5, 0.5],
      sat: 1}
displays:
  main:
    - !<View> {name: film, colorspace: tv, looks: +dim}
file_rules:
  - !<Rule> {name: exr, colorspace: lin, pattern: "*", extension: exr}
  - !<Rule> {name: Default, colorspace: raw}
"""


def test_catalog(spark):
    c = catalog.load(CONFIG)
    assert c.issues() == [] and c.space("LINEAR LIGHT").name == "lin" and c.space("scene_linear").name == "lin"
    rows = np.array([[0.02, 0.08, 0.5]])
    df = run(spark, rows, *ir.compiled(c.conversion("lin", "tv")))
    assert np.allclose(df, np.sqrt(rows * 2))
    assert np.allclose(run(spark, df, *ir.compiled(c.conversion("tv", "lin"))), rows)
    assert np.allclose(run(spark, rows, *ir.compiled(c.display("lin", "main", "film"))), np.sqrt(rows))
    # A clamping exponent there and back leaves the clamp of negatives.
    assert [type(t).__name__ for t in ir.optimized([*c.conversion("lin", "tv"), *c.conversion("tv", "lin")])] == ["Matrix", "Exponent", "Matrix"]
    assert c.conversion("lin", "raw") == [] and c.equivalent("lin", "scene_linear") and not c.equivalent("lin", "tv")
    assert c.resolve("a/${SHOT}/$SHOT.$NOPE_X") == "a/sh010/sh010.$NOPE_X"
    with pytest.raises(catalog.Missing):
        c.resolve("$NOPE_X", strict=True)
    got = spark.createDataFrame([("a/b.exr",), ("a/b.EXR",), ("x.png",)], "p string").select(c.space_of_path(F.col("p")).alias("s")).collect()
    assert [r.s for r in got] == ["lin", "lin", "raw"]
    assert c.by(category="file-io") == ["tv"] and c.by(family="display") == ["tv"]
    held = catalog.Processors(c)
    assert held.get("lin", "tv") is held.get("lin", "tv") and held.hits == 1
    with pytest.raises(catalog.Missing):
        catalog.builtin("unknown style")
    assert catalog.parsed_looks("+a, -b") == [("a", True), ("b", False)]


BUILTINS = (
    "identity srgb_to_linear acescct_to_acescg acescc_to_acescg ap0_to_ap1 ap1_to_ap0 ap0_to_xyz_d65 ap1_to_xyz_d65 arri_logc3_to_ap0 arri_logc4_to_ap0 slog3_sgamut3_to_ap0 "
    "slog3_sgamut3cine_to_ap0 vlog_vgamut_to_ap0 log3g10_rwg_to_ap0 redlogfilm_rwg_to_ap0 canon_clog2_to_ap0 canon_clog3_to_ap0 apple_log_rec2020_to_ap0 xyz_d65_to_srgb "
    "xyz_d65_to_rec1886_rec709 xyz_d65_to_rec1886_rec2020 xyz_d65_to_display_p3 xyz_d65_to_g26_p3_d65 xyz_d65_to_rec2100_pq xyz_d65_to_rec2100_hlg gamut_compress_13"
).split()


@pytest.mark.parametrize("name", BUILTINS)
def test_builtins_invert(spark, name):
    chain = catalog.builtin(name.upper().replace("_", "-"))
    # Colours inside every gamut here: display curves clamp what is negative.
    rows = np.array([[0.3, 0.32, 0.33], [0.4, 0.42, 0.45]])
    both = [*chain, ir.Chain(tuple(chain)).inverse()]
    assert np.allclose(run(spark, rows, *ir.compiled(both, optimize=False)), rows, atol=1e-5)


def test_optimizer_keeps_results(spark):
    rows = np.random.default_rng(5).random((10, 3))
    chain = [ir.Matrix(np.eye(3) * 2, (0.1, 0, 0)), ir.Matrix(np.eye(3)), ir.Matrix(np.diag([1, 0.5, 0.25])), ir.Exponent((2.0,) * 3), ir.Exponent((0.4,) * 3), ir.Curve("srgb"), ir.Curve("srgb", False)]
    assert len(ir.optimized(chain)) == 2
    assert np.allclose(run(spark, rows, *ir.compiled(chain)), run(spark, rows, *ir.compiled(chain, optimize=False)), atol=1e-9)


def grid_image(spark, h=7, w=9, channels=("v",)):
    rows = [(0, y, x, *[float((y * 31 + x * 17 + k * 7) % 23) / 22 for k in range(len(channels))]) for y in range(h) for x in range(w)]
    df = spark.createDataFrame(rows, "image_id bigint, y int, x int, " + ", ".join(f"{c} double" for c in channels))
    return image.Img(df, image.Roi(0, w, 0, h), channels)


def array(img):
    out = np.full((img.roi.height, img.roi.width), np.nan)
    for r in img.df.collect():
        out[r.y - img.roi.y0, r.x - img.roi.x0] = r[img.channels[0]]
    return out


def test_filters_against_numpy(spark):
    img = grid_image(spark)
    a = array(img)
    wide = np.pad(a, 2, mode="edge")
    patches = np.lib.stride_tricks.sliding_window_view(wide, (5, 5))
    assert np.allclose(array(filters.box_blur(img, 5)), patches.mean(axis=(2, 3)))
    assert np.allclose(array(filters.median(img, 5)), np.median(patches, axis=(2, 3)))
    assert np.allclose(array(filters.dilate(img, 5)), patches.max(axis=(2, 3)))
    for mode, pad in (("periodic", "wrap"), ("mirror", "symmetric"), ("black", "constant")):
        k = np.random.default_rng(6).random((5, 3))
        p = np.lib.stride_tricks.sliding_window_view(np.pad(a, ((2, 2), (1, 1)), mode=pad), (5, 3))
        assert np.allclose(array(filters.convolve(img, k, mode)), (p * k).sum(axis=(2, 3)))
    with pytest.raises(ValueError):
        filters.median(img, 4)


def test_geometry_against_numpy(spark):
    img = grid_image(spark)
    a = array(img)
    for f, g in ((geometry.flip, np.flipud), (geometry.flop, np.fliplr), (geometry.transpose, np.transpose), (geometry.rotate90, lambda m: np.rot90(m, -1)),
                 (geometry.rotate180, lambda m: np.rot90(m, 2)), (geometry.rotate270, np.rot90)):
        assert np.array_equal(array(f(img)), g(a))
    assert np.array_equal(array(geometry.circular_shift(img, 2, -3)), np.roll(a, (-3, 2), (0, 1)))
    for n in range(1, 9):
        assert geometry.reorient(img, n).df.count() == a.size
    assert np.array_equal(array(geometry.pad(img, 1, 2, 3, 4, 0.5)), np.pad(a, ((1, 3), (4, 2)), constant_values=0.5))


def test_statistics_of_odd_samples(spark):
    df = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 0, 1, float("inf")), (0, 1, 0, 2.0), (0, 1, 1, 4.0)], "image_id bigint, y int, x int, v double")
    img = image.Img(df, image.Roi(0, 2, 0, 2), ("v",))
    r = stats.pixel_stats(img).first()
    assert (r["min"], r["max"], r["avg"], r["stddev"], r.nan_count, r.inf_count, r.finite_count) == (2.0, 4.0, 3.0, 1.0, 1, 1, 2)
    fixed = array(filters.fix_non_finite(img, "box3"))
    # The border stands for its nearest pixels, so a corner's own side counts twice.
    assert np.allclose(fixed, [[8 / 3, 10 / 3], [2, 4]])
    same = stats.pixel_hash(img).first()["hash"]
    assert same == stats.pixel_hash(image.Img(df.repartition(4), img.roi, img.channels)).first()["hash"] and len(same) == len(hashlib.sha256().hexdigest())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    """Pixel operations don't shuffle, scans read what is asked for, filters take two shuffles."""
    from lumenframe.operators.adapters import rgba, samples

    op = Op({"r": transfer.decode("srgb", "r"), "g": "g", "b": "b", "a": "a"})
    assert "Exchange" not in plan(rgba(spark, sf_dir).apply(op).df)
    only = plan(samples(spark, sf_dir).select("r"))
    assert "ReadSchema: struct<l_quantity" in only and "l_tax" not in only.split("ReadSchema")[1]
    assert plan(filters.box_blur(grid_image(spark), 3).df).count("Exchange hash") == 2
    assert plan(filters.median(grid_image(spark), 5).df).count("Exchange hash") == 2


def test_slope_curves(spark):
    from lumenframe.functions import curves

    points = [(0.0, 0.0), (0.25, 0.15), (0.6, 0.7), (1.0, 1.0)]
    curve = curves.fitted(points)
    assert np.allclose([curve.at(x) for x, _ in points], [y for _, y in points])
    grid = np.linspace(-0.2, 1.2, 57)
    out = column(spark, grid, curve.forward)
    assert np.allclose(out, [curve.at(v) for v in grid]) and (np.diff(out) > 0).all()
    assert np.allclose(column(spark, out, curve.inverse), grid, atol=1e-9)
    # The slope has no jumps.
    fine = np.linspace(0, 1, 2001)
    assert np.abs(np.diff([curve.at(v) for v in fine], 2)).max() < 1e-5
    given = curves.fitted(points, [1.0, 0.5, 1.0, 0.25])
    assert np.allclose([(given.at(x + 1e-7) - given.at(x - 1e-7)) / 2e-7 for x, _ in points[1:3]], [0.5, 1.0], atol=1e-4)
    around = curves.periodic([(0.1, 1.2), (0.6, 0.8)])
    assert around.at(0.0) == pytest.approx(around.at(1.0))


@pytest.mark.parametrize("style", ["log", "video", "linear"])
def test_tone_inverts(spark, style):
    from lumenframe.functions import curves

    rows = np.random.default_rng(8).random((40, 3)) * 0.9 + 0.02
    one = (1.2, 0.9, 1.0, 0.85)
    top, _, bottom, pivot = curves.TONE_STYLES[style]
    size = top - bottom
    zones = {
        "blacks": curves.Zone(one, bottom + size * 0.4, size * 0.4), "shadows": curves.Zone(one, pivot + size * 0.1, bottom), "midtones": curves.Zone(one, pivot, size * 0.6),
        "highlights": curves.Zone(one, pivot - size * 0.1, top), "whites": curves.Zone(one, bottom + size * 0.4, size * 0.5),
    }
    for chosen in [*({k: v} for k, v in zones.items()), zones]:
        for contrast in (1.0, 1.4, 0.7):
            pair = [curves.tone(style, **chosen, s_contrast=contrast, inverse=i) for i in (False, True)]
            assert np.allclose(run(spark, rows, *pair), rows, atol=1e-6)
    moved = run(spark, rows, curves.tone(style, **zones))
    assert not np.allclose(moved, rows, atol=1e-3)
    assert np.allclose(run(spark, rows, curves.tone(style)), rows, atol=1e-9)


def test_rgb_and_hue_curves(spark):
    from lumenframe.functions import curves

    rows = np.random.default_rng(9).random((40, 3)) * 0.8 + 0.1
    s = curves.fitted([(0.0, 0.0), (0.25, 0.15), (0.6, 0.7), (1.0, 1.0)])
    assert np.allclose(run(spark, rows, curves.rgb_curves(s, None, s, s), curves.rgb_curves(s, None, s, s, inverse=True)), rows, atol=1e-9)
    assert np.allclose(run(spark, rows, curves.hue_curves("log")), rows, atol=1e-6)
    line = curves.fitted([(0.0, 0.0), (1.0, 1.0)])
    flat = curves.periodic([(0.1, 1.0), (0.6, 1.0)])
    turn = curves.periodic([(0.0, 0.0), (0.5, 0.5)], climbs=True)
    same = curves.hue_curves("vid", hue_hue=turn, hue_sat=flat, hue_lum=flat, sat_sat=line, lum_lum=line)
    assert np.allclose(run(spark, rows, same), rows, atol=1e-6)


def test_textures(spark):
    from lumenframe.operators import texture

    img = grid_image(spark, 8, 8)
    a = array(img)
    look = spark.createDataFrame([(1, 0, 2.5 / 8, 3.5 / 8, 0.0), (2, 0, 1.0 / 8, 1.0 / 8, 0.0), (3, 0, 0.3, 0.7, 3.0), (4, 0, 2.5 / 8, 3.5 / 8, 0.5)], "key int, image_id bigint, u double, v double, level double")
    got = {r.key: r.v for r in texture.trilinear(look, img).collect()}
    half = a.reshape(4, 2, 4, 2).mean(axis=(1, 3))
    assert got[1] == pytest.approx(a[3, 2]) and got[2] == pytest.approx(a[:2, :2].mean()) and got[3] == pytest.approx(a.mean())
    x, y = 2.5 / 8 * 4 - 0.5, 3.5 / 8 * 4 - 0.5
    i, j, fx, fy = int(x), int(y), x % 1, y % 1
    coarse = (half[j : j + 2, i : i + 2] * np.outer([1 - fy, fy], [1 - fx, fx])).sum()
    assert got[4] == pytest.approx((a[3, 2] + coarse) / 2)
    d = look.selectExpr("key", "image_id", "u", "v", "0.5D AS dudx", "0.0D AS dvdx", "0.0D AS dudy", "0.125D AS dvdy")
    assert texture.anisotropic(d, img).count() == 4


def test_layers(spark):
    from lumenframe.operators import layers

    img = grid_image(spark, 3, 3, ("r", "g", "b", "a", "z"))
    out = layers.color_only(img, color.tone_mapped())
    assert out.channels == ("r", "g", "b", "a", "z")
    assert out.df.select("z").exceptAll(img.df.select("z")).count() == 0
    assert layers.groups(["R", "diff.R", "diff.G"]) == {"": ["R"], "diff": ["diff.R", "diff.G"]}
    assert layers.kinds(["diff.R", "A", "Z", "id", "N.x"]) == {"diff.R": "color", "A": "alpha", "Z": "depth", "id": "id", "N.x": "other"}
    with pytest.raises(ValueError):
        layers.merged({"a": img, "b": grid_image(spark, 4, 3)})


def test_appearance_space(spark):
    from lumenframe.functions import aces2

    rows = np.random.default_rng(11).random((30, 3)) * 2
    assert np.allclose(run(spark, rows, aces2.rgb_to_jmh(), aces2.jmh_to_rgb()), rows, atol=1e-7)
    greys = np.array([[0.18] * 3, [1.0] * 3])
    jmh = run(spark, greys, aces2.rgb_to_jmh())
    assert np.allclose(jmh[:, 1], 0, atol=1e-6) and jmh[1, 0] == pytest.approx(100)
    for peak, grey in ((100.0, 0.1), (1000.0, 0.145)):
        curve = aces2.ToneScale(peak)
        light = np.array([0.01, 0.18, 1.0, 8.0])
        assert column(spark, [0.18], curve.forward)[0] == pytest.approx(grey, abs=6e-4)
        assert np.allclose(column(spark, light, lambda v: curve.inverse(curve.forward(v))), light, rtol=1e-6)  # noqa: B023


@pytest.mark.parametrize(("peak", "limit"), [(100.0, "rec709"), (1000.0, "display_p3")])
def test_rendering(spark, peak, limit):
    """The projection against the same in numpy; tables' corners; greys; and the way back."""
    from lumenframe.functions import aces2

    k, rng = aces2.rendering(peak, limit), np.random.default_rng(3)
    rows = np.concatenate([10 ** rng.uniform(-3, 1, (60, 3)), [[0.18] * 3, [0.0] * 3, [-0.1, 0.2, 0.1]]])
    shown = run(spark, rows, *aces2.output_transform(peak, limit))
    with np.errstate(all="ignore"):
        want = np.array(k.forward(list(rows.T), aces2._Arrays)).T
    assert np.allclose(shown, want, atol=1e-9)
    grey = {100.0: 0.1, 1000.0: 0.145}[peak]
    assert np.allclose(shown[60], grey, atol=6e-4) and np.allclose(shown[61], 0, atol=1e-9)
    assert shown.min() > -0.1 * peak / 100 and shown.max() < 1.2 * peak / 100
    # What the display can show comes back to itself.
    display = rng.random((60, 3)) * 0.96 * peak / 100 + 0.01
    there = run(spark, display, *aces2.output_transform(peak, limit, True))
    assert np.allclose(run(spark, there, *aces2.output_transform(peak, limit)), display, atol=1e-4 * peak)
    # A knot stands at each corner of the cube, and its cusp is that corner.
    for corner in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]):
        j, m, h, _ = aces2._to_jmh(k.out, [np.array([c * peak / 100]) for c in map(float, corner)], aces2._Arrays)
        at = int(np.abs(k.hues - h).argmin())
        assert abs(k.hues[at] - h[0]) < 1e-6
        assert np.allclose(k.cusps[at], [j[0], m[0] * (1 + 0.27 * 0.12)], rtol=1e-4)
    # Beyond the reach at peak lightness a channel of the reach gamut is negative, just below it none.
    for hue in (0, 90, 201):
        edge = lambda m: np.min(aces2._from_jmh(k.reach, np.array(k.top), np.array(m), np.array(float(hue)), aces2._Arrays))  # noqa: B023, E731
        assert edge(k.reaches[hue] + 0.02) < 0 <= edge(k.reaches[hue] - 0.02) + 1e-6


@pytest.mark.parametrize("size", [4, 64])
def test_tiles(spark, size):
    from lumenframe.operators import tiles

    img = grid_image(spark, 13, 11)
    assert np.allclose(array(tiles.gaussian(img, 0.8, size)), array(filters.blur(img, 0.8)))
    assert np.allclose(array(tiles.median(img, 5, size)), array(filters.median(img, 5)))
    back = tiles.from_tiles(tiles.to_tiles(img, size, 2), img, size)
    assert np.array_equal(array(back), array(img))


@pytest.mark.parametrize("method", ["bilinear", "vng", "ahd"])
def test_demosaic_of_smooth_colours(spark, method):
    from lumenframe.operators import tiles

    h, w = 12, 14
    y, x = np.mgrid[:h, :w]
    true = np.stack([0.2 + 0.02 * x, 0.5 + 0.01 * y, 0.8 - 0.02 * x], axis=-1)
    rows = [(0, int(j), int(i), float(true[j, i, "RGB".index("RGGB"[(j % 2) * 2 + i % 2])])) for j in range(h) for i in range(w)]
    img = image.Img(spark.createDataFrame(rows, "image_id bigint, y int, x int, v double"), image.Roi(0, w, 0, h), ("v",))
    out = filters.demosaic(img) if method == "bilinear" else tiles.demosaic(img, "RGGB", method, 5)
    for r in out.df.where("y BETWEEN 3 AND 8 AND x BETWEEN 3 AND 10").collect():
        assert np.allclose([r.r, r.g, r.b], true[r.y, r.x], atol=0.02)


def test_rotate_whole(spark):
    from lumenframe.operators import sampling

    img = grid_image(spark, 5, 8)
    right = sampling.rotate_whole(img, -90.0)
    a = array(img)
    assert (right.roi.width, right.roi.height) == (5, 8)
    assert np.allclose(array(right), np.rot90(a, 1)) or np.allclose(array(right), np.rot90(a, -1))
    tilted = sampling.rotate_whole(img, 45.0, (0.25,))
    assert array(tilted)[0, 0] == 0.25 and tilted.df.count() == tilted.roi.width * tilted.roi.height
