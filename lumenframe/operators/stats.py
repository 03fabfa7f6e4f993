"""Statistics of images: partial and final aggregates, no pixel leaves its executor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .composite import paired
from .image import KEYS, Img


def finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def long(img: Img) -> DataFrame:
    """(image_id, y, x, channel, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in img.channels])
    return img.df.select(*KEYS, F.explode(pairs).alias("p")).select(*KEYS, "p.channel", "p.value")


def pixel_stats(img: Img, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Range, mean and population deviation of the finite samples of each channel, and counts of the others.

    All channels are summed up side by side in one pass; they become rows after that.
    """
    sums, rows = [], []
    for c in img.channels:
        v = F.col(c)
        fine = F.when(finite(v), v)
        sums += [
            F.min(fine).alias(f"{c}_min"), F.max(fine).alias(f"{c}_max"), F.avg(fine).alias(f"{c}_avg"), F.avg(fine * fine).alias(f"{c}_square"),
            F.count_if(F.isnan(v)).alias(f"{c}_nan"), F.count_if(F.abs(v) == float("inf")).alias(f"{c}_inf"), F.count(fine).alias(f"{c}_n"),
        ]
        mean = F.col(f"{c}_avg")
        rows.append(F.struct(
            F.lit(c).alias("channel"), F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"), mean.alias("avg"),
            F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}_square") - mean * mean)).alias("stddev"),
            F.col(f"{c}_nan").alias("nan_count"), F.col(f"{c}_inf").alias("inf_count"), F.col(f"{c}_n").alias("finite_count"),
        ))
    keys = [k for k in by if k != "channel"]
    return img.df.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*rows)).alias("s")).select(*keys, "s.*").select(*by, "min", "max", "avg", "stddev", "nan_count", "inf_count", "finite_count")


def merged_stats(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Statistics of the union of parts that `pixel_stats` has described, exact for all columns."""
    n = F.col("finite_count")
    mean = F.sum(n * F.col("avg")) / F.sum(n)
    square = F.sum(n * (F.col("stddev") * F.col("stddev") + F.col("avg") * F.col("avg"))) / F.sum(n)
    return parts.groupBy(*by).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("avg"),
        F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("stddev"),
        F.sum("nan_count").alias("nan_count"), F.sum("inf_count").alias("inf_count"), F.sum(n).alias("finite_count"),
    )


def compare(a: Img, b: Img, fail: float, warn: float, fail_relative: float = 0.0) -> DataFrame:
    """Errors of two images over their union: mean, RMS, PSNR, the first greatest one, and counts over thresholds."""
    both, n = paired(a, b), len(a.channels)
    total = lambda parts: sum(parts[1:], parts[0])
    diffs = [F.abs(F.col(c) - F.col(f"{c}2")) for c in a.channels]
    limits = [F.greatest(F.lit(fail), (F.abs(c) + F.abs(f"{c}2")) / 2 * fail_relative) for c in a.channels]
    one = lambda hit: F.when(hit, 1).otherwise(0)
    # The first in scan order among the greatest: the greatest by (difference, place negated).
    worst = [
        F.struct(d.alias("d"), (-F.col("image_id")).alias("i"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"), F.lit(-k).alias("c")) for k, d in enumerate(diffs)
    ]
    rows = both.df.select(
        total(diffs).alias("sum"), total([d * d for d in diffs]).alias("square"), (F.greatest(*worst) if n > 1 else worst[0]).alias("worst"),
        total([one(d > k) for d, k in zip(diffs, limits, strict=True)]).alias("fails"),
        total([one((d > warn) & ~(d > k)) for d, k in zip(diffs, limits, strict=True)]).alias("warns"),
    )
    sums = rows.agg(
        (F.sum("sum") / (F.count("*") * n)).alias("mean_error"), F.sqrt(F.sum("square") / (F.count("*") * n)).alias("rms_error"), F.max("worst").alias("at"),
        F.coalesce(F.sum("fails"), F.lit(0)).alias("nfail"), F.coalesce(F.sum("warns"), F.lit(0)).alias("nwarn"),
    )
    rms = F.col("rms_error")
    return sums.select(
        "mean_error", "rms_error", F.when(rms == 0, F.lit(float("inf"))).otherwise(20 * F.log10(1 / F.when(rms == 0, F.lit(1.0)).otherwise(rms))).alias("psnr"),
        F.col("at.d").alias("max_error"), (-F.col("at.i")).alias("max_image"), (-F.col("at.y")).alias("max_y"), (-F.col("at.x")).alias("max_x"),
        (-F.col("at.c")).alias("max_c"), "nfail", "nwarn",
    )


def constant_color(img: Img, threshold: float = 0.0) -> DataFrame:
    """(image_id, constant): whether every channel stays within `threshold` of the image's first pixel."""
    first = [F.min_by(c, F.struct("y", "x")).alias(f"f_{c}") for c in img.channels]
    ends = [e for c in img.channels for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    within = None
    for c in img.channels:
        one = (F.col(f"hi_{c}") - F.col(f"f_{c}") <= threshold) & (F.col(f"f_{c}") - F.col(f"lo_{c}") <= threshold)
        within = one if within is None else within & one
    return img.df.groupBy("image_id").agg(*first, *ends).select("image_id", within.alias("constant"))



def constant_channel(img: Img, channel: str, value: float, threshold: float = 0.0) -> DataFrame:
    return img.df.groupBy("image_id").agg(F.bool_and(F.abs(F.col(channel) - value) <= threshold).alias("constant"))


def monochrome(img: Img, threshold: float = 0.0) -> DataFrame:
    """(image_id, monochrome): whether all channels stay within `threshold` of the first."""
    same = F.lit(True)
    for c in img.channels[1:]:
        same = same & (F.abs(F.col(c) - F.col(img.channels[0])) <= threshold)
    return img.df.groupBy("image_id").agg(F.bool_and(same).alias("monochrome"))


def bin_of(v: Column, bins: int, low: float, high: float) -> Column:
    """The bin of a value; outliers go to the end bins."""
    inside = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return F.when(v <= low, F.lit(0)).when(v >= high, F.lit(bins - 1)).otherwise(inside)


def histogram(img: Img, channel: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n, share) for every bin, empty ones too; non-finite samples are skipped."""
    counted = img.df.where(finite(channel)).groupBy(bin_of(F.col(channel), bins, low, high).alias("bin")).agg(F.count("*").alias("n"))
    every = img.df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    # As many rows as bins; pixels are counted before this.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return out.select("bin", "n", (F.col("n") / F.greatest(total, F.lit(1))).alias("share"))


def histograms(img: Img, bins: int, low: float, high: float) -> DataFrame:
    """(channel, bin, n) of all channels in one pass; empty bins have no row."""
    v = F.col("value")
    return long(img).where(finite(v)).groupBy("channel", bin_of(v, bins, low, high).alias("bin")).agg(F.count("*").alias("n"))


def range_check(img: Img, low, high) -> DataFrame:
    """(low, high, inside): pixels with a channel below its bound, else above it, else neither."""
    under, over = F.lit(False), F.lit(False)
    for c, lo, hi in zip(img.channels, low, high, strict=True):
        under, over = under | (F.col(c) < lo), over | (F.col(c) > hi)
    return img.df.agg(F.count_if(under).alias("low"), F.count_if(~under & over).alias("high"), F.count_if(~under & ~over).alias("inside"))


def color_count(img: Img, colors: list[list[float]], epsilon=(0.001,)) -> DataFrame:
    """(color, n): pixels that match each reference colour; one conditional count each, in one pass."""
    eps = [float(epsilon[min(i, len(epsilon) - 1)]) for i in range(len(img.channels))]
    counts = []
    for color in colors:
        hit = F.lit(True)
        for c, v, e in zip(img.channels, color, eps, strict=True):
            hit = hit & (F.abs(F.col(c) - float(v)) <= e)
        counts.append(F.count_if(hit))
    one = img.df.agg(F.array(*counts).alias("n"))
    return one.select(F.posexplode("n").alias("color", "n"))


def unique_colors(img: Img, approximate: bool = False) -> DataFrame:
    """The number of distinct colours, at steps of 1 / 65536."""
    steps = [F.round(F.col(c) * 65536).cast("bigint") for c in img.channels]
    if approximate:
        return img.df.agg(F.approx_count_distinct(F.xxhash64(*steps)).alias("n"))
    return img.df.select(*[s.alias(c) for s, c in zip(steps, img.channels, strict=True)]).distinct().agg(F.count("*").alias("n"))


def nonzero_region(img: Img) -> DataFrame:
    """(image_id, x0, x1, y0, y1): the half-open box of pixels that aren't zero; empty images have no row."""
    some = F.lit(False)
    for c in img.channels:
        some = some | (F.abs(F.col(c)) > 1e-10)
    return img.df.where(some).groupBy("image_id").agg(
        F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")
    )


def perceptual_difference(a: Img, b: Img, luminance: float = 100.0, fov: float = 45.0) -> DataFrame:
    """The number of pixels whose adapted luminances differ visibly, over the common box."""
    both = paired(a, b, inner=True)
    luma = lambda s: F.col(f"r{s}") * 0.2126 + F.col(f"g{s}") * 0.7152 + F.col(f"b{s}") * 0.0722
    seen = lambda s: F.pow(F.greatest(luma(s), F.lit(0.0)) * luminance, F.lit(2.2))
    p, q = seen(""), seen("2")
    mean = (p + q) / 2
    limit = 1 / max(0.01, 0.1 * both.roi.width / fov)
    return both.df.agg(F.count_if((mean > 0) & (F.abs(p - q) / F.when(mean > 0, mean).otherwise(1.0) > limit)).alias("n"))


def pixel_hash(img: Img, extra: str = "", digits: int = 6) -> DataFrame:
    """(image_id, hash): an order-free digest of all pixels, wherever they are stored, and of `extra`.

    A pixel's place and channels, rounded to `digits` places, go through MD5; 13 hexadecimal digits from the front and
    from the back of it are summed up, so a task sends two numbers for each image.
    """
    # Numbers too great for that, and those that aren't numbers, stand as they are.
    whole = [F.when(F.abs(c) < 1e12, F.round(F.col(c) * 10**digits).cast("bigint").cast("string")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in img.channels]
    h = F.md5(F.concat_ws("|", F.col("y").cast("string"), F.col("x").cast("string"), *whole).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 13), 16, 10).cast("decimal(38,0)"))
    sums = img.df.groupBy("image_id").agg(part(1).alias("a"), part(20).alias("b"))
    return sums.select("image_id", F.sha2(F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string"), F.lit(extra)).cast("binary"), 256).alias("hash"))



def difference_image(a: Img, b: Img, gain: float = 10.0) -> Img:
    """Amplified absolute difference, at most 1."""
    both = paired(a, b)
    out = {c: F.least(F.lit(1.0), F.abs(F.col(c) - F.col(f"{c}2")) * gain) for c in a.channels}
    return Img(both.df, both.roi, both.channels).select(out)


def cdf(counts: np.ndarray) -> np.ndarray:
    """Cumulative shares of a histogram (driver side; as many numbers as bins)."""
    return np.cumsum(counts) / max(1, counts.sum())
