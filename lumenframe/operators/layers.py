"""Layers of an image: tables with a layer column, and the meaning of channels by their names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Op
from .image import KEYS, Img


def kinds(channels) -> dict[str, str]:
    """color, alpha, depth, id or other, by name."""
    def one(name: str) -> str:
        last = name.rsplit(".", 1)[-1].lower()
        if last in ("r", "g", "b", "red", "green", "blue", "y"):
            return "color"
        if last in ("a", "alpha"):
            return "alpha"
        if last in ("z", "depth", "zback"):
            return "depth"
        return "id" if last in ("id", "crypto", "objectid") else "other"

    return {c: one(c) for c in channels}


def groups(channels) -> dict[str, list[str]]:
    """Channel names by layer: what stands before the last dot."""
    out: dict[str, list[str]] = {}
    for c in channels:
        out.setdefault(layer_of(c), []).append(c)
    return out


def layer_of(channel: str) -> str:
    """The layer of a channel by its name: what stands before the last dot."""
    return channel.rpartition(".")[0]


def layer_expression(column: str):
    return F.regexp_replace(F.when(F.col(column).contains("."), F.col(column)).otherwise(F.lit(".")), r"\.[^.]*$", "")


def listed(df: DataFrame) -> DataFrame:
    """(layer, pixels, images) of a table with a layer column."""
    return df.groupBy("layer").agg(F.count("*").alias("pixels"), F.countDistinct("image_id").alias("images"))


def picked(df: DataFrame, layer: str) -> DataFrame:
    return df.where(F.col("layer") == layer).drop("layer")


def merged(layers: dict[str, Img]) -> DataFrame:
    """Images of one size as layers of one table; other sizes are refused."""
    boxes = {i.roi for i in layers.values()}
    if len(boxes) > 1:
        raise ValueError("layers differ in size")
    out = None
    for name, img in layers.items():
        df = img.df.select(F.lit(name).alias("layer"), *KEYS, *img.channels)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def color_only(img: Img, op: Op) -> Img:
    """A colour operation on r, g, b and a; every other channel passes unchanged."""
    others = [c for c in img.channels if c not in op.out]
    wide = Op({**op.out, **{c: c for c in others}}, *op.steps)
    return replace(img, df=wide.frame(img.df, list(KEYS)), channels=tuple(wide.out))


def transformed(df: DataFrame, layer: str, roi, channels, make) -> DataFrame:
    """A layered table in which one layer is what `make` makes of its image (a crop, a resize, a blur); the others stay."""
    img = make(Img(picked(df, layer).select(*KEYS, *channels), roi, tuple(channels)))
    return df.where(F.col("layer") != layer).unionByName(img.df.select(F.lit(layer).alias("layer"), *KEYS, *img.channels), allowMissingColumns=True)
