"""All queries of the engine by name, and their SQL mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import color, gamut
from ..operators.adapters import rgba
from ..operators.stats import pixel_stats
from . import colors, extras, images, pixels, tables  # noqa: F401  (they register their queries)
from .base import QUERIES, SQL, rounded


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sRGB code values to linear light, to ACEScg, and the statistics of each image and channel."""
    img = rgba(spark, sf_dir).apply(color.transfer("srgb", "decode")).apply(color.matrixed(gamut.rgb_to_rgb("srgb", "aces_ap1", "bradford")))
    stats = pixel_stats(img, ("image_id", "channel"))
    return rounded(stats, ["image_id", "channel", "nan_count", "inf_count", "finite_count"], ["min", "max", "avg", "stddev"])


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
