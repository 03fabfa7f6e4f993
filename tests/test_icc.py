import numpy as np
import pytest

from lumenframe.functions import gamut, icc, lut
from lumenframe.plans import ir

ROWS = np.random.default_rng(1).random((30, 3)) * 0.9 + 0.05


def run(spark, transforms, rows=ROWS):
    df = spark.createDataFrame([(i, *map(float, r), 1.0) for i, r in enumerate(rows)], "i int, r double, g double, b double, a double")
    for op in ir.compiled(transforms):
        df = op.frame(df, ["i"])
    return np.array([[r.r, r.g, r.b] for r in df.orderBy("i").collect()])


def decoded(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def test_written_and_read_again():
    p = icc.srgb()
    q = icc.read(icc.write(p))
    assert np.allclose(q.matrix, p.matrix, atol=2e-5) and np.allclose(q.adaptation, p.adaptation, atol=2e-5) and q.description == "srgb"
    assert np.allclose(q.matrix @ [1, 1, 1], icc.D50, atol=2e-3)
    x = np.linspace(0, 1, 50)
    assert np.allclose(q.curves[0].at(x), decoded(x), atol=2e-4)
    table = icc.Profile(p.matrix, (icc.Curve(table=(0.0, 0.2, 1.0)),) * 3)
    assert np.allclose(icc.read(icc.write(table)).curves[2].table, (0, 0.2, 1), atol=1e-4)


def test_broken_profiles():
    good = icc.write(icc.srgb())
    rng = np.random.default_rng(2)
    with pytest.raises(icc.BadProfile):
        icc.read(good.replace(b"RGB ", b"CMYK"))
    for _ in range(100):
        try:
            icc.read(good[: rng.integers(0, len(good))])
        except icc.BadProfile:
            pass


def test_parametric_kinds():
    import struct

    fixed = lambda *v: struct.pack(f">{len(v)}i", *(round(x * 65536) for x in v))
    make = lambda kind, *v: icc._curve(b"para\0\0\0\0" + struct.pack(">HH", kind, 0) + fixed(*v))
    x = np.linspace(0, 1, 9)
    assert np.allclose(make(0, 2.0).at(x), x**2)
    assert np.allclose(make(1, 2.0, 1.5, -0.5).at(x), np.where(x >= 1 / 3, (1.5 * x - 0.5) ** 2, 0), atol=1e-4)
    assert np.allclose(make(2, 2.0, 1.5, -0.5, 0.1).at(x), np.where(x >= 1 / 3, (1.5 * x - 0.5) ** 2, 0) + 0.1, atol=1e-4)
    assert np.allclose(make(3, 2.0, 0.9, 0.1, 0.2, 0.25).at(x), np.where(x >= 0.25, (0.9 * x + 0.1) ** 2, 0.2 * x), atol=1e-4)
    assert np.allclose(make(4, 2.0, 0.9, 0.1, 0.2, 0.25, 0.05, 0.01).at(x), np.where(x >= 0.25, (0.9 * x + 0.1) ** 2 + 0.05, 0.2 * x + 0.01), atol=1e-4)
    assert icc._curve(b"curv\0\0\0\0" + struct.pack(">IH", 1, 563)).g == pytest.approx(2.2, abs=1e-2)


def test_conversions(spark):
    to_p3 = run(spark, icc.conversion(icc.srgb(), icc.named("display_p3")))
    want = decoded(ROWS) @ gamut.rgb_to_rgb("srgb", "display_p3").T
    assert np.allclose(to_p3, want, atol=1e-4)
    there = icc.conversion(icc.srgb(), icc.named("rec2020", icc.Curve(2.2)), "relative")
    back = icc.conversion(icc.named("rec2020", icc.Curve(2.2)), icc.srgb(), "relative")
    assert np.allclose(run(spark, [*there, *back]), ROWS, atol=1e-6)
    # Absolute: white D65 of one stays the colour it is in a space of white D50.
    white = run(spark, icc.conversion(icc.srgb(), icc.named("prophoto"), "absolute"), np.ones((1, 3)))[0]
    assert np.allclose(gamut.rgb_to_xyz("prophoto") @ white, gamut.white_xyz("D65"), atol=1e-6)
    with pytest.raises(ValueError):
        icc.conversion(icc.srgb(), icc.srgb(), "other")


def test_process_lists_there_and_back():
    from lumenframe.plans.colors import CLF

    nodes = [*CLF, ("lut3d", lut.Lut3D.of(lambda c: c**1.1, 3)), ("cdl", (lut.Cdl((1.1, 1.0, 0.9), (0.0, 0.1, 0.0), (1.0, 1.2, 1.0), 0.9), "Fwd"))]
    again = lut.parse_clf(lut.write_clf(nodes))
    assert [k for k, _ in again] == [k for k, _ in nodes]
    assert np.allclose(again[0][1][0], nodes[0][1][0]) and np.allclose(again[0][1][1], nodes[0][1][1])
    assert again[1][1] == nodes[1][1] and np.allclose(again[2][1].tables, nodes[2][1].tables) and again[3][1] == nodes[3][1] and again[4][1] == nodes[4][1]
    assert np.allclose(again[5][1].cube, nodes[5][1].cube) and tuple(again[6][1][0].slope) == (1.1, 1.0, 0.9)


def test_tables_that_would_be_read_wrongly():
    rows = "\n".join(f"{r} {g} {b}" for r in (0, 1023) for g in (0, 1023) for b in (0, 1023))
    assert lut.parse_3dl(f"Mesh 1 12\n0 1023\n{rows}").cube.max() == pytest.approx(1023 / 4095)
    assert lut.parse_3dl(f"0 1023\n{rows}").cube.max() == 1.0
    with pytest.raises(ValueError):
        lut.parse_3dl(f"Mesh 1 8\n{rows}")
    shaper = "CSPLUTV100\n1D\n" + "3\n0 0.5 1\n0 {} 1\n" * 3 + "2\n0 0 0\n1 1 1\n"
    assert len(lut.parse_csp(shaper.format(0.5, 0.5, 0.5)).tables) == 2
    with pytest.raises(ValueError):
        lut.parse_csp(shaper.format(0.7, 0.5, 0.5))
