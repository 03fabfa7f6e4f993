"""Formulas written a second time, in numpy or as published numbers, against what the engine makes."""

import numpy as np
import pytest

from lumenframe.functions import transfer
from lumenframe.operators import composite
from lumenframe.operators.image import Img, Roi

RNG = np.random.default_rng(21)
A, B = RNG.random((40, 4)), RNG.random((40, 4))
FG, BG = A[:, :3], B[:, :3]
FA, BA = A[:, 3:], B[:, 3:]


def image(spark, rows):
    df = spark.createDataFrame([(0, 0, i, *map(float, r)) for i, r in enumerate(rows)], "image_id bigint, y int, x int, r double, g double, b double, a double")
    return Img(df, Roi(0, len(rows), 0, 1), ("r", "g", "b", "a"))


def pixels(img):
    return np.array([[r.r, r.g, r.b, r.a] for r in img.df.orderBy("x").collect()])


#: Code values of 18 % grey that the makers of the curves publish. Fixed values.
GREY = {
    "logc3": 0.391007, "logc4": 0.278396, "slog3": 420 / 1023, "vlog": 433 / 1023, "log3g10": 1 / 3, "davinci": 0.336043, "bmd_film5": 0.383561,
    "acescct": 0.413588, "acescc": 0.413588, "srgb": 0.461356, "rec709": 0.409008, "apple_log": 0.488272, "clog3": 0.343389, "clog2": 0.398254, "dlog": 0.398764,
}


@pytest.mark.parametrize("name", sorted(GREY))
def test_published_grey(spark, name):
    df = spark.range(1)
    assert df.select(transfer.encode(name, 0.18).col.alias("v")).first().v == pytest.approx(GREY[name], abs=6e-4)


def test_published_peaks(spark):
    df = spark.range(1)
    value = lambda e: df.select(e.col.alias("v")).first().v
    assert value(transfer.encode("pq", 10000.0)) == pytest.approx(1.0, abs=1e-9)
    assert value(transfer.encode("pq", 203.0)) == pytest.approx(0.58, abs=2e-3)
    assert value(transfer.encode("hlg", 1.0)) == pytest.approx(1.0, abs=1e-6)
    assert value(transfer.encode("hlg", 1 / 12)) == pytest.approx(0.5, abs=1e-6)


def over_alpha(fa, ba):
    return fa + ba * (1 - fa)


SEPARABLE = {
    "multiply": lambda b, f: f * b,
    "screen": lambda b, f: 1 - (1 - f) * (1 - b),
    "difference": lambda b, f: abs(f - b),
    "exclusion": lambda b, f: f + b - 2 * f * b,
    "hardlight": lambda b, f: np.where(f < 0.5, 2 * f * b, 1 - 2 * (1 - f) * (1 - b)),
    "overlay": lambda b, f: np.where(b < 0.5, 2 * f * b, 1 - 2 * (1 - f) * (1 - b)),
}


@pytest.mark.parametrize("mode", sorted(SEPARABLE))
def test_blends_of_opaque_colours(spark, mode):
    """Over an opaque background an opaque foreground gives the blend itself."""
    one = np.column_stack([FG, np.ones(len(FG))])
    two = np.column_stack([BG, np.ones(len(BG))])
    got = pixels(composite.composite(mode, image(spark, one), image(spark, two)))
    assert np.allclose(got[:, :3], SEPARABLE[mode](BG, FG), atol=1e-9)


def test_porter_duff_by_coverage(spark):
    """The operators as weights of both layers on premultiplied colours."""
    pa, pb = np.column_stack([FG * FA, FA]), np.column_stack([BG * BA, BA])
    weights = {"in": (BA, 0), "out": (1 - BA, 0), "atop": (BA, 1 - FA), "xor": (1 - BA, 1 - FA)}
    for mode, (wa, wb) in weights.items():
        got = pixels(composite.composite(mode, image(spark, pa), image(spark, pb)))
        assert np.allclose(got, pa * wa + pb * wb, atol=1e-9), mode


def test_straight_over(spark):
    got = pixels(composite.composite("over", image(spark, A), image(spark, B)))
    alpha = over_alpha(FA, BA)
    assert np.allclose(got[:, 3:], alpha)
    assert np.allclose(got[:, :3], (FG * FA + BG * BA * (1 - FA)) / alpha)
    under = pixels(composite.composite("under", image(spark, A), image(spark, B)))
    assert np.allclose(under, pixels(composite.composite("over", image(spark, B), image(spark, A))))
