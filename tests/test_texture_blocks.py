"""Texture lookups by blocks of texels against the same by hand."""

import numpy as np
import pytest

from lumenframe.operators import image, texture

H, W = 50, 64


def shown(grid, y, x, wrap):
    """The texel that a wrap mode shows at a place."""
    h, w = grid.shape
    if wrap == "black":
        return grid[y, x] if 0 <= y < h and 0 <= x < w else 0.0
    if wrap == "clamp":
        return grid[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    if wrap == "mirror":
        y, x = y % (2 * h), x % (2 * w)
        return grid[y if y < h else 2 * h - 1 - y, x if x < w else 2 * w - 1 - x]
    return grid[y % h, x % w]


@pytest.fixture(scope="module")
def picture(spark):
    a = np.random.default_rng(3).random((H, W))
    rows = [(0, y, x, float(a[y, x]), float(1 - a[y, x])) for y in range(H) for x in range(W)]
    return a, image.Img(spark.createDataFrame(rows, "image_id bigint, y int, x int, v double, o double"), image.Roi(0, W, 0, H), ("v", "o"))


def levels(a):
    out = []
    for i in range(7):
        h, w = max(1, H >> i), max(1, W >> i)
        fy, fx = 2 ** min(i, 5), 2**i
        out.append(a[: h * fy, : w * fx].reshape(h, fy, w, fx).mean(axis=(1, 3)))
    return out


@pytest.mark.parametrize("wrap", ["periodic", "clamp", "mirror", "black"])
def test_trilinear_by_hand(spark, picture, wrap):
    a, img = picture
    rng = np.random.default_rng(5)
    looks = [(k, 0, float(u), float(v), float(lv)) for k, (u, v, lv) in enumerate(zip(rng.uniform(-2.5, 3, 300), rng.uniform(-2.5, 3, 300), rng.uniform(0, 6, 300), strict=True))]
    looks += [(300 + i, 0, u, v, lv) for i, (u, v, lv) in enumerate([(0.0, 0.0, 0.0), (1.0, 1.0, 6.0), (0.125, 0.16, 0.0), (0.999, 0.001, 3.0), (-0.004, 1.004, 0.5)])]
    pyramid = levels(a)

    def one(u, v, lv):
        total = 0.0
        for i, part in ((int(lv), 1 - lv % 1), (min(int(lv) + 1, 6), lv % 1)):
            g = pyramid[i]
            sy, sx = v * g.shape[0] - 0.5, u * g.shape[1] - 0.5
            y, x = int(np.floor(sy)), int(np.floor(sx))
            total += part * sum((sy - y if dy else 1 - sy + y) * (sx - x if dx else 1 - sx + x) * shown(g, y + dy, x + dx, wrap) for dy in (0, 1) for dx in (0, 1))
        return total

    got = {r.key: r.v for r in texture.trilinear(spark.createDataFrame(looks, "key bigint, image_id bigint, u double, v double, level double"), img, wrap).collect()}
    assert len(got) == len(looks)
    for k, _, u, v, lv in looks:
        assert got[k] == pytest.approx(one(u, v, lv), abs=1e-12), (u, v, lv)


def test_a_lookup_is_sent_once_to_a_block(spark, picture):
    """16 places along a short line meet the texels as a few rows, not as 64 and more, and are summed in one step."""
    looks = spark.createDataFrame([(k, 0, 0.03 * k, 0.02 * k, 0.25, 0.0, 0.0, 0.001) for k in range(50)], "key bigint, image_id bigint, u double, v double, dudx double, dvdx double, dudy double, dvdy double")
    found = texture.anisotropic(looks, picture[1])
    assert found.count() == 50
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert len([line for line in plan if "Aggregate [key" in line]) == 1
    assert not any("Generate explode" in line and "sequence(1, n" in line and "transform" not in line for line in plan)


def test_missing_image_gives_zero(spark, picture):
    looks = spark.createDataFrame([(1, 7, 0.5, 0.5, 1.5)], "key bigint, image_id bigint, u double, v double, level double")
    assert [tuple(r) for r in texture.trilinear(looks, picture[1]).collect()] == [(1, 0.0, 0.0)]
