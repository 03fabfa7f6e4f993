"""Deep queries over samples that nearly or quite meet."""

import duckdb
import pytest

from lumenframe.operators import deep
from lumenframe.plans import registry


@pytest.fixture(scope="module")
def close(tmp_path_factory):
    """Line items of a few pixels, whose prices are equal, a cent apart, or a step of the moved half (1050) apart."""
    folder, con = tmp_path_factory.mktemp("close"), duckdb.connect()
    prices = [20000.0, 20000.0, 20000.01, 21050.0, 21050.0, 21050.01, 30000.0, 84000.0, 84000.05]
    rows = [(k, 1 + i % 2, float(1 + (i * 7 + k) % 50), p, (i * 3 + k) % 11 / 100, (i + k) % 9 / 100) for k in range(40) for i, p in enumerate(prices[: k % 10])]
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY lineitem TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["dp_merge", "dp_tidy"])
def test_samples_that_meet(spark, close, name):
    folder, con = close
    got, want = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b), (len(a), len(b))


def test_overlaps_merge_by_default(spark):
    one = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0)], "y int, x int, z double, zback double, a double, r double, g double, b double")
    assert deep.exploded(deep.merged(one, one)).count() == 1 and deep.exploded(deep.merged(one, one, overlaps=False)).count() == 2


def crowded(spark, n=200):
    rows = [(k % 3, 0, (i * 7 % (n // 4)) / 10, (i * 7 % (n // 4)) / 10, 0.02 + (i * k) % 5 / 1000, (i % 9) / 9, (i % 7) / 7, 0.25) for k in range(3) for i in range(n if k else 1)]
    return deep.gathered(spark.createDataFrame(rows, "y int, x int, z double, zback double, a double, r double, g double, b double"))


def test_crowded_pixels(spark):
    """Sorting, merging and culling as by hand, on pixels of one sample and of many."""
    pixels = crowded(spark)
    want = {}
    for p in pixels.collect():
        runs = []
        for s in sorted(tuple(v) for v in p.samples):
            if runs and runs[-1][0] == s[0]:
                m, a = runs[-1], runs[-1][2] + s[2] * (1 - runs[-1][2])
                runs[-1] = (*m[:2], a, *[(m[c] * m[2] + s[c] * s[2] * (1 - m[2])) / a for c in (3, 4, 5)])
            else:
                runs.append(s)
        total, kept = 0.0, []
        for s in runs:
            if total < deep.OPAQUE:
                kept.append(s)
            total += s[2] * (1 - total)
        want[p.y] = kept
    got = {p.y: [tuple(v) for v in p.samples] for p in deep.tidied(pixels).collect()}
    assert got.keys() == want.keys()
    for y in want:
        assert len(got[y]) == len(want[y]) and all(g == pytest.approx(w) for g, w in zip(got[y], want[y], strict=True))


def test_values_are_computed_once_for_a_pixel(spark):
    """Neither the sorting nor the opaque depth of a pixel stands inside a step over its samples."""
    plan = deep.tidied(crowded(spark, 4)).select("y", "samples")._jdf.queryExecution().analyzed().toString()
    assert plan.count("sort_array(samples") + plan.count("array_sort(samples") == 1
