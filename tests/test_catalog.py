"""Configurations: what they say, there and back, against numpy."""

import numpy as np
import pytest

from lumenframe.functions import color, curves
from lumenframe.plans import catalog, ir
from lumenframe.plans.colors import STYLES, TRANSFORMS

RNG = np.random.default_rng(12)
ROWS = RNG.random((40, 4)) * 0.8 + 0.1

CONFIG = """ocio_profile_version: 2.5
environment:
  {}
search_path: ""
description: |
  Two lines: with a colon, [brackets
  and "quotes".
roles:
  scene_linear: Linear AP1
  default: Raw
file_rules:
  - !<Rule> {name: Movies, colorspace: Show, regex: ".*\\\\.([mM][oO][vV])$"}
  - !<Rule> {name: Default, colorspace: Raw}
shared_views:
  - !<View> {name: Toned, view_transform: Tone (SDR), display_colorspace: <USE_DISPLAY_NAME>}
displays:
  Show:
    - !<View> {name: Raw, colorspace: Raw}
    - !<Views> [Toned]
view_transforms:
  - !<ViewTransform>
    name: Tone (SDR)
    from_scene_reference: !<GroupTransform>
      children:
        - !<ExponentTransform> {value: [0.9, 0.9, 0.9, 1]}
        - !<BuiltinTransform> {style: UTILITY - ACES-AP0_to_CIE-XYZ-D65_BFD}
  - !<ViewTransform>
    name: Un-tone-mapped
    from_scene_reference: !<BuiltinTransform> {style: UTILITY - ACES-AP0_to_CIE-XYZ-D65_BFD}
display_colorspaces:
  - !<ColorSpace>
    name: Show
    from_display_reference: !<BuiltinTransform> {style: DISPLAY - CIE-XYZ-D65_to_sRGB}
colorspaces:
  - !<ColorSpace>
    name: Linear AP1
    aliases: [ap1]
    description: Text with a comma, and a colon: here
    to_scene_reference: !<BuiltinTransform> {style: ACEScg_to_ACES2065-1}
  - !<ColorSpace>
    name: Raw
    isdata: true
named_transforms:
  - !<NamedTransform>
    name: log
    inverse_transform: !<LogTransform> {base: 2}
"""


def run(spark, transforms, rows=ROWS):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, r double, g double, b double, a double")
    for op in ir.compiled(transforms):
        df = op.frame(df, ["i"])
    return np.array([[r.r, r.g, r.b, r.a] for r in df.orderBy("i").collect()])


def made(name):
    return catalog.transform(catalog.parse_yaml(f"t: {TRANSFORMS[name]}")["t"])


def test_a_configuration_with_views(spark):
    c = catalog.load(CONFIG)
    assert c.issues() == [] and set(c.spaces) == {"Show", "Linear AP1", "Raw"} and c.rules[0].regex == r".*\.([mM][oO][vV])$"
    assert [v.name for v in c.displays["Show"]] == ["Raw", "Toned"] and c.space("ap1").name == "Linear AP1"
    assert c.display("ap1", "Show", "Raw") == []
    seen = run(spark, c.display("ap1", "Show", "Toned"))
    # The same by hand: to the reference, the view's power, XYZ, Rec.709 and its curve.
    from lumenframe.functions import gamut

    light = ROWS[:, :3] @ gamut.rgb_to_rgb("aces_ap1", "aces_ap0").T
    xyz = (np.maximum(light, 0) ** 0.9) @ (gamut.adaptation("D60", "D65") @ gamut.rgb_to_xyz("aces_ap0")).T
    rgb = xyz @ gamut.xyz_to_rgb("srgb").T
    want = np.where(rgb <= 0.0031308, rgb * 12.92, 1.055 * np.maximum(rgb, 1e-9) ** (1 / 2.4) - 0.055)
    assert np.allclose(seen[:, :3], want, atol=2e-5)
    # Without a view the plain view transform stands between the two references.
    there = run(spark, [*c.conversion("ap1", "Show"), *c.conversion("Show", "ap1")])
    assert np.allclose(there, ROWS, atol=1e-6)
    assert np.allclose(run(spark, c.named["log"])[:, 0], 2.0 ** ROWS[:, 0])
    with pytest.raises(catalog.Missing):
        c.display("ap1", "Show", "Nothing")


def test_active_spaces():
    c = catalog.standard()
    c.active, c.inactive = ("sRGB", "raw", "nowhere"), ("raw",)
    assert c.active_spaces() == ["sRGB"]
    assert catalog.load(catalog.dumped(c)).active_spaces() == ["sRGB"]


def test_dumped_and_loaded_again(spark):
    one = catalog.standard()
    two = catalog.load(catalog.dumped(one))
    assert set(two.spaces) == set(one.spaces) and two.roles == one.roles and two.displays == one.displays
    assert [(r.name, r.space, r.pattern, r.extension, r.regex) for r in two.rules] == [(r.name, r.space, r.pattern, r.extension, r.regex) for r in one.rules]
    assert two.default_space == one.default_space
    for a, b in (("LogC3", "sRGB"), ("ACEScg", "Rec.2100-PQ")):
        assert np.allclose(run(spark, one.conversion(a, b)), run(spark, two.conversion(a, b)), atol=1e-9)
    for name in ("matrix4", "log_affine", "log_camera_back", "range", "allocation", "primary", "lut3d"):
        chain = made(name)
        again = catalog.transform(catalog.parse_yaml("t: " + catalog._text(catalog.node_of(ir.Chain(tuple(chain)))))["t"])
        assert np.allclose(run(spark, chain), run(spark, again), atol=1e-9), name


@pytest.mark.parametrize("name", ["matrix4", "exponent_linear", "log_affine", "log_camera", "allocation", "primary_back", "primary_video", "tone_video", "curves", "hue_back", "exposure_back", "exposure_log_back", "fixed_gamma_log", "fixed_gamma_log_back"])
def test_transforms_have_inverses(spark, name):
    chain = made(name)
    rows = ROWS * [0.1, 0.1, 0.1, 1] + [0.4, 0.4, 0.4, 0] if name in ("hue_back", "primary_back") else ROWS
    there = run(spark, chain, rows)
    back = run(spark, [ir.Chain(tuple(chain)).inverse()], there)
    assert np.allclose(back, rows, atol=1e-6)


def test_transforms_against_numpy(spark):
    rgb = ROWS[:, :3]
    m = np.array([1.1, 0.1, 0, 0.05, 0, 0.9, 0.1, 0, 0.05, 0, 1, 0, 0.02, 0, 0, 0.9]).reshape(4, 4)
    assert np.allclose(run(spark, made("matrix4")), ROWS @ m.T + [0.01, 0, 0.02, 0.05])
    want = np.log10(rgb * 1.2 + 2) * [0.3, 0.25, 0.2] + [0.5, 0.4, 0.3]
    assert np.allclose(run(spark, made("log_affine"))[:, :3], want)
    want = np.log10(rgb * 5 + 0.06) * [0.3, 0.25, 0.2] + 0.4
    assert np.allclose(run(spark, made("log_camera"))[:, :3], want)
    assert np.allclose(run(spark, made("allocation"))[:, :3], (np.log2(rgb + 0.5) + 8) / 13)
    assert np.allclose(run(spark, made("lut1d"))[:, :3], np.interp(rgb, np.linspace(0, 1, 5), [0, 0.1, 0.35, 0.7, 1.1]))
    lifted = rgb * 2**0.2
    lifted = np.maximum((lifted + np.array([0.02, 0, -0.02]) * (1 - lifted)) * [1.2, 1, 0.8], 0) ** (1 / np.array([1.1, 1, 0.9])) + 0.01
    lifted = 0.18 + (lifted - 0.18) * 1.1
    y = lifted @ [0.2126, 0.7152, 0.0722]
    assert np.allclose(run(spark, made("primary"))[:, :3], np.clip(y[:, None] + (lifted - y[:, None]) * 0.8, 0, 2))
    y = rgb @ [0.2126, 0.7152, 0.0722]
    dark, light = np.clip((0.09 - y) / 0.09, 0, 1), np.clip((y - 0.5) / 0.39, 0, 1)
    middle = np.maximum(1 - dark - light, 0)
    gain = 1 + np.outer(dark, np.array([1.1, 1, 0.9]) * 1.05 - 1) + np.outer(middle, [0, 0.1, 0]) + np.outer(light, [-0.1, 0, 0])
    assert np.allclose(run(spark, made("tone"))[:, :3], (rgb + [0.02, 0.01, 0.01]) * gain * [1, 1, 1.1])
    g, o = 2.4, 0.055
    want = np.where(rgb[:, 0] > o / (g - 1), ((rgb[:, 0] + o) / (1 + o)) ** g, 0)
    got = run(spark, made("exponent_linear"))[:, 0]
    assert np.allclose(got[rgb[:, 0] > 0.1], want[rgb[:, 0] > 0.1])


def test_hue_saturation_luma_there_and_back(spark):
    for variant in ("lin", "log", "vid"):
        rows = np.concatenate([ROWS, ROWS * [0.005, 0.005, 0.005, 1], [[0.5, 0.5, 0.5, 1], [0.0, 0.0, 0.0, 1]]])
        got = run(spark, [ir.Ready(color.rgb_to_hsy(variant)), ir.Ready(color.hsy_to_rgb(variant))], rows)
        assert np.allclose(got, rows, atol=1e-6), variant


def test_hue_curves_have_inverses(spark):
    hue = {
        "hue_hue": curves.periodic([(0.1, 0.12), (0.6, 0.62)], True), "lum_sat": curves.fitted([(0, 1.0), (0.5, 1.2), (1.0, 0.9)]), "sat_lum": curves.fitted([(0, 1.0), (1.0, 1.1)]),
        "hue_sat": curves.periodic([(0.2, 1.1), (0.7, 0.9)]), "hue_lum": curves.periodic([(0.3, 0.9), (0.8, 1.1)]), "lum_lum": curves.fitted([(-8, -8), (0, 0.1), (8, 8)]),
    }
    rows = ROWS * [0.2, 0.2, 0.2, 1] + [0.3, 0.3, 0.3, 0]
    for style in ("lin", "log", "vid"):
        got = run(spark, [ir.Ready(curves.hue_curves(style, **hue)), ir.Ready(curves.hue_curves(style, True, **hue))], rows)
        assert np.allclose(got, rows, atol=1e-5), style


def test_built_in_styles(spark):
    for style in STYLES.values():
        assert np.isfinite(run(spark, catalog.builtin(style))).all(), style
    same = lambda a, b: np.allclose(run(spark, catalog.builtin(a)), run(spark, catalog.builtin(b)))
    assert same("ARRI_ALEXA-LOGC-EI800-AWG_to_ACES2065-1", "arri_logc3_to_ap0")
    assert same("DISPLAY - CIE-XYZ-D65_to_REC.1886-REC.709", "xyz_d65_to_rec1886_rec709")
    # Density 0.6 of 10 bits: code 95 + 300, past the last point of the curve.
    code = np.array([[(95 + 500 * 0.6) / 1023] * 3 + [1.0]])
    density = 0.6 * np.array([[0.75573, 0.22197, 0.02230], [0.05901, 0.96928, -0.02829], [0.16134, 0.07406, 0.76460]]).sum(1)
    want = 10 ** (np.where(density < 0.6, -0.926545676714876, -0.926545676714876 + (density - 0.6) * 100 / 55))
    got = np.linalg.solve(np.array(([0.72286, 0.12630, 0.15084], [0.11923, 0.76418, 0.11659], [0.01427, 0.08213, 0.90359])), run(spark, catalog.builtin("ADX10_to_ACES2065-1"), code)[0, :3])
    assert np.allclose(got, want, rtol=1e-4)
    # Code 426.5 of 10 bits is 1.0 at 2.5 stops above 425 less 2.5 stops.
    proxy = np.array([[(425 + 2.5 * 50) / 1023] * 3 + [1.0]])
    assert np.allclose(run(spark, catalog.builtin("ACESproxy10i_to_ACES2065-1"), proxy)[0, :3], 1.0, atol=1e-6)
    with pytest.raises(catalog.Missing):
        catalog.builtin("no such style")


def test_baked(spark):
    chain = catalog.standard().conversion("ACEScct", "sRGB")
    cube = ir.baked(spark, chain, 17)
    at = RNG.integers(0, 17, (20, 3))
    want = run(spark, chain, np.concatenate([at / 16, np.ones((20, 1))], 1))[:, :3]
    assert np.allclose([cube.cube[tuple(i)] for i in at], want)
    curve = ir.baked(spark, [ir.Curve("srgb")], 33, False)
    assert np.allclose(curve.op and run(spark, [ir.Table(curve)], np.full((1, 4), 0.5))[0, 0], run(spark, [ir.Curve("srgb")], np.full((1, 4), 0.5))[0, 0], atol=1e-6)
