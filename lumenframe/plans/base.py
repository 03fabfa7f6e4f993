"""How queries are registered: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.expr import Op
from ..operators.adapters import GRAY_SQL, RGBA_SQL, SAMPLES_SQL, gray, rgba, samples
from ..operators.image import KEYS, Img

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = list(KEYS)
RGBA = ("r", "g", "b", "a")


def register(name: str, query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"two queries are called {name}")
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _round(c: str, digits: int) -> str:
    return f"round({c}, {digits}) + CAST(0.0 AS DOUBLE) AS {c}"


def rounded(df: DataFrame, keys, channels, digits: int = 6) -> DataFrame:
    return df.selectExpr(*keys, *[_round(c, digits) for c in channels])


def rounded_sql(sql: str, keys, channels, digits: int = 6) -> str:
    return f"SELECT {', '.join([*keys, *[_round(c, digits) for c in channels]])} FROM ({sql}) AS rounded_"


def image_query(name: str, make, sql: str | None, channels, digits: int = 6) -> None:
    """`make(spark, sf_dir)` gives an image; its pixels are the result."""

    def query(spark, sf_dir):
        img: Img = make(spark, sf_dir)
        return rounded(img.df.select(*K, *channels), K, channels, digits)

    register(name, query, sql and rounded_sql(sql, K, channels, digits))


def pixel_query(name: str, op: Op, digits: int = 6, view: str = "rgba") -> None:
    """A per-pixel operation on the RGBA images, or on the line items as samples."""
    if view == "rgba":
        image_query(name, lambda s, d: rgba(s, d).apply(op), op.sql(RGBA_SQL, K), tuple(op.out), digits)
        return
    keys = ["l_orderkey", "l_linenumber"]
    register(
        name,
        lambda s, d: rounded(op.frame(samples(s, d), keys), keys, tuple(op.out), digits),
        rounded_sql(op.sql(SAMPLES_SQL, keys), keys, tuple(op.out), digits),
    )


def gray_query(name: str, make, sql: str | None, channels=("v",), digits: int = 6) -> None:
    image_query(name, lambda s, d: make(gray(s, d)), sql, channels, digits)


def table_query(name: str, make, sql: str | None, keys, channels=(), digits: int = 6) -> None:
    """`make(spark, sf_dir)` gives a table; doubles among its columns are rounded."""
    register(
        name,
        lambda s, d: rounded(make(s, d), keys, channels, digits),
        sql and rounded_sql(sql, keys, channels, digits),
    )


__all__ = [
    "GRAY_SQL", "K", "QUERIES", "RGBA", "RGBA_SQL", "SAMPLES_SQL", "SQL", "gray", "gray_query", "image_query", "pixel_query", "register", "rgba",
    "rounded", "rounded_sql", "samples", "table_query",
]
