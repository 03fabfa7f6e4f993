"""Driver tables as images and deep pixels, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .image import Img, Roi

ROWS = 50


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rgba(spark: SparkSession, sf_dir: str) -> Img:
    """Every ROWS embeddings as an image of 16 x ROWS RGBA pixels, values around [0, 1], alpha in it."""
    at = lambda c: F.get("embedding", F.col("x") * 4 + c).cast("double") * 2.0
    df = (
        load(spark, sf_dir, "embeddings")
        .select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
        .select(
            F.expr(f"vec_id div {ROWS}").alias("image_id"),
            (F.col("vec_id") % ROWS).cast("int").alias("y"),
            "x",
            (at(0) + 0.4).alias("r"),
            (at(1) + 0.4).alias("g"),
            (at(2) + 0.4).alias("b"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(3) + 0.6)).alias("a"),
        )
    )
    return Img(df, Roi(0, 16, 0, ROWS), ("r", "g", "b", "a"))


RGBA_SQL = f"""SELECT CAST(vec_id // {ROWS} AS BIGINT) AS image_id, CAST(vec_id % {ROWS} AS INT) AS y, CAST(t.x AS INT) AS x,
  CAST(embedding[4 * t.x + 1] AS DOUBLE) * CAST(2.0 AS DOUBLE) + CAST(0.4 AS DOUBLE) AS r,
  CAST(embedding[4 * t.x + 2] AS DOUBLE) * CAST(2.0 AS DOUBLE) + CAST(0.4 AS DOUBLE) AS g,
  CAST(embedding[4 * t.x + 3] AS DOUBLE) * CAST(2.0 AS DOUBLE) + CAST(0.4 AS DOUBLE) AS b,
  greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), CAST(embedding[4 * t.x + 4] AS DOUBLE) * CAST(2.0 AS DOUBLE) + CAST(0.6 AS DOUBLE))) AS a
  FROM embeddings, range(0, 16) AS t(x)"""


def gray(spark: SparkSession, sf_dir: str) -> Img:
    """Every ROWS embeddings as an image of 64 x ROWS single-channel pixels."""
    df = (
        load(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("x", "v"))
        .select(
            F.expr(f"vec_id div {ROWS}").alias("image_id"), (F.col("vec_id") % ROWS).cast("int").alias("y"), "x", F.col("v").cast("double").alias("v")
        )
    )
    return Img(df, Roi(0, 64, 0, ROWS), ("v",))


GRAY_SQL = f"""SELECT CAST(vec_id // {ROWS} AS BIGINT) AS image_id, CAST(vec_id % {ROWS} AS INT) AS y, CAST(t.x AS INT) AS x,
  CAST(embedding[t.x + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) AS t(x)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of four channels in [0, 1] (no unique key)."""
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity").cast("double") / 50.0).alias("r"),
        (F.col("l_extendedprice").cast("double") / 105000.0).alias("g"),
        F.col("l_discount").cast("double").alias("b"),
        F.col("l_tax").cast("double").alias("a"),
    )


SAMPLES_SQL = """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) / CAST(50.0 AS DOUBLE) AS r,
  CAST(l_extendedprice AS DOUBLE) / CAST(105000.0 AS DOUBLE) AS g, CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS a FROM lineitem"""


def deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that share (order, line) as the samples of one deep pixel.

    The factors have many digits so that sums don't fall on the halves of a rounding.
    """
    s = samples(spark, sf_dir)
    return s.select(
        F.col("l_orderkey").alias("y"),
        F.col("l_linenumber").alias("x"),
        F.col("g").alias("z"),
        F.col("g").alias("zback"),
        (F.col("b") * 4.91275183917).alias("a"),
        (F.col("r") * 0.97713459273).alias("r"),
        (F.col("a") * 3.98312875413).alias("g"),
        F.lit(0.25331947218).alias("b"),
    )


DEEP_SQL = f"""SELECT l_orderkey AS y, l_linenumber AS x, g AS z, g AS zback, b * CAST(4.91275183917 AS DOUBLE) AS a,
  r * CAST(0.97713459273 AS DOUBLE) AS r, a * CAST(3.98312875413 AS DOUBLE) AS g, CAST(0.25331947218 AS DOUBLE) AS b FROM ({SAMPLES_SQL}) AS s"""
