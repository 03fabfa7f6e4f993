"""Hole filling by a push-pull pyramid.

Going up, a block is the alpha-weighted mean of its pixels that aren't holes; going
down, a hole takes the colour of the smallest block around it that has one.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .image import KEYS, Img


def holes(img: Img, threshold: float = 1e-3) -> DataFrame:
    """(image_id, n): pixels of each image with alpha below the threshold."""
    return img.df.groupBy("image_id").agg(F.count_if(F.col("a") < threshold).alias("n"))



def _blocks(img: Img, levels: int):
    """An array of (level, by, bx): the blocks of 2, 4, 8, ... pixels that hold a pixel."""
    r = img.roi
    at = lambda c, lo, i: F.floor((F.col(c) - lo) / 2**i).cast("int")
    return F.array(*[F.struct(F.lit(i).alias("level"), at("y", r.y0, i).alias("by"), at("x", r.x0, i).alias("bx")) for i in range(1, levels + 1)])


def push_pull(img: Img, threshold: float = 1e-3) -> Img:
    """Holes take the alpha-weighted mean of the smallest block around them that isn't all holes; other pixels stay.

    Blocks of all sizes are summed in one pass; holes ask for theirs in one join. An image of nothing but holes stays as it is.
    """
    levels = max(1, math.ceil(math.log2(max(img.roi.width, img.roi.height, 2))))
    hole = F.col("a") < threshold
    blocks = _blocks(img, levels)
    colors = [c for c in img.channels if c != "a"]
    full = img.df.where(~hole).select("image_id", *img.channels, F.explode(blocks).alias("k")).select("image_id", "k.*", *img.channels)
    sums = full.groupBy("image_id", "level", "by", "bx").agg(
        *[(F.sum(F.col(c) * F.col("a")) / F.sum("a")).alias(f"up_{c}") for c in colors], F.avg("a").alias("up_a")
    )
    asked = img.df.where(hole).select(*KEYS, F.explode(blocks).alias("k")).select(*KEYS, "k.*")
    ups = [f"up_{c}" for c in img.channels]
    found = asked.join(sums, ["image_id", "level", "by", "bx"]).groupBy(*KEYS).agg(F.min_by(F.struct(*ups), "level").alias("best"))
    filled = img.df.join(found, list(KEYS), "left").select(
        *KEYS, *[F.when(hole & F.col("best").isNotNull(), F.col(f"best.up_{c}")).otherwise(F.col(c)).alias(c) for c in img.channels]
    )
    return replace(img, df=filled)
