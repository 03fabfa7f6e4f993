"""Images that lack pixels inside their box: a last image without all its rows, and rows missing within."""

import duckdb
import numpy as np
import pytest

from lumenframe.operators import filters, image, tiles
from lumenframe.plans import registry

#: Queries whose rows come from neighbours on windows.
WINDOWS = ["fi_gauss", "fi_median", "fi_sobel", "fi_bilateral", "fi_emboss", "fi_kernel_box", "fi_border_black", "fi_border_periodic", "fi_border_mirror",
           "fi_box", "fi_open", "st_fix_box3", "de_bilinear"]
#: Queries whose rows come from tiles.
TILES = ["fi_gauss_tiles", "fi_median_tiles", "de_vng_sites", "de_ahd_sites"]
#: Queries whose rows come from Fourier transforms.
TRANSFORMS = ["fft_convolve", "fft_inverse", "fft_polar_inverse", "fft_forward", "fft_energy"]


@pytest.fixture(scope="module", params=["vec_id < 120", "vec_id < 151", "vec_id < 120 AND vec_id NOT IN (10, 11, 25, 49)"])
def lacking(request, sf_dir, tmp_path_factory):
    """A folder whose embeddings fill no whole number of images, and a connection that sees them."""
    folder, con = tmp_path_factory.mktemp("lacking"), duckdb.connect()
    con.execute(f"COPY (SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet') WHERE {request.param}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    return str(folder), con


def same_rows(spark, lacking, name):
    folder, con = lacking
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b), (name, len(a), len(b))


@pytest.mark.parametrize("name", WINDOWS)
def test_windows(spark, lacking, name):
    same_rows(spark, lacking, name)


def lacking_image(spark, value, h=12, w=14, last=9, gap=4):
    """Rows `last` and beyond and row `gap` aren't there."""
    rows = [(0, y, x, float(value(y, x))) for y in range(last) if y != gap for x in range(w)]
    return image.Img(spark.createDataFrame(rows, "image_id bigint, y int, x int, v double"), image.Roi(0, w, 0, h), ("v",))


def test_neighbours_that_exist(spark):
    img = lacking_image(spark, lambda y, x: y * 100 + x)
    for r in filters.neighbours(img, 1, 2).df.collect():
        at = [(min(max(r.y + dy, 0), 11), min(max(r.x + dx, 0), 13)) for dy in range(-2, 3) for dx in range(-1, 2)]
        assert r.n_v == [None if y >= 9 or y == 4 else y * 100 + x for y, x in at]


def test_nan_is_no_gap(spark):
    img = lacking_image(spark, lambda y, x: np.nan if (y, x) == (2, 3) else 1.0)
    got = {(r.y, r.x): r.v for r in filters.convolve(img, np.ones((3, 3)) / 9).df.collect()}
    assert np.isnan(got[1, 3]) and got[8, 5] == pytest.approx(6 / 9)


@pytest.mark.parametrize("name", TILES)
def test_tiles(spark, lacking, name):
    same_rows(spark, lacking, name)


@pytest.mark.parametrize("method", ["vng", "ahd"])
def test_demosaic_beside_gaps(spark, method):
    true = lambda y, x: (0.2 + 0.02 * x, 0.5 + 0.01 * y, 0.8 - 0.02 * x)
    img = lacking_image(spark, lambda y, x: true(y, x)["RGB".index("RGGB"[(y % 2) * 2 + x % 2])])
    made = {size: {(r.y, r.x): (r.r, r.g, r.b) for r in tiles.demosaic(img, "RGGB", method, size).df.collect()} for size in (3, 64)}
    assert made[3].keys() == made[64].keys() and len(made[3]) == 8 * 14
    for at, rgb in made[64].items():
        assert np.allclose(rgb, made[3][at]), at
    # The colours are smooth; beside a gap an estimate may use neighbours of one side only.
    inner = [np.abs(np.array(rgb) - true(*at)).max() for at, rgb in made[64].items() if 3 <= at[1] <= 10 and at[0] in (6, 7, 8)]
    assert max(inner) < 0.2


@pytest.mark.parametrize("name", TRANSFORMS)
def test_transforms(spark, lacking, name):
    same_rows(spark, lacking, name)
