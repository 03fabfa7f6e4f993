"""Queries that SQL can say give the rows of their SQL."""

import os

import duckdb
import pytest

from lumenframe.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert [a[c].dtype for c in columns] == [b[c].dtype for c in columns]
    assert a.equals(b)


def test_sharding_mirror_with_awkward_texts(spark, duck):
    from lumenframe.llm import sharding

    rows = [(None, "x"), (7, None), (8, ""), (9, "é日😀"), (9, "é日😀"), (-3, "a\tb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted(map(str, sharding.op5_query(df).select("doc_id", "size", "text_crc32", "shard", "grown_shard").collect()))
    want = con.execute(sharding.OP5_SQL).df()
    assert len(got) == len(want) == 6
    assert sorted(zip(want["size"], want["text_crc32"], want["shard"], want["grown_shard"], strict=True)) == sorted(
        tuple(r) for r in sharding.op5_query(df).select("size", "text_crc32", "shard", "grown_shard").collect()
    )
