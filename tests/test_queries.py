"""Every query with a mirror gives the mirror's rows."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def groups():
    from lumenframe.plans import registry

    return sorted({n.split("_")[0] for n in registry.queries()})


@pytest.mark.parametrize("prefix", groups())
def test_against_sql(spark, sf_dir, duck, prefix):
    from lumenframe.plans import registry

    mirrors = registry.oracle_sql()
    found = {n: q for n, q in registry.queries().items() if n.split("_")[0] == prefix}
    # Small jobs wait for each other more than they work; four at a time keep the cores busy.
    with ThreadPoolExecutor(4) as pool:
        results = dict(zip(found, pool.map(lambda q: q(spark, sf_dir).toPandas(), found.values()), strict=True))
    for name, got in results.items():
        if name not in mirrors:
            assert len(got), name
            continue
        want = duck.execute(mirrors[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        assert [got[c].dtype for c in columns] == [want[c].dtype for c in columns], name
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), (name, len(a), len(b))


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
