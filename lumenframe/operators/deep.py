"""Deep pixels: any number of samples along depth at each pixel.

A table of samples (keys, z, zback, a, r, g, b; colours premultiplied) becomes one
row for each pixel with an ordered array of structs; everything after that is
array expressions within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("z", "zback", "a", "r", "g", "b")
OPAQUE, SAME = 0.9999, 1e-6


def gathered(samples: DataFrame, keys=("y", "x")) -> DataFrame:
    """One row for each pixel: its samples in order of depth (ties by the other fields)."""
    return samples.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("samples"))


def exploded(pixels: DataFrame, keys=("y", "x")) -> DataFrame:
    """Samples as rows again, with their position."""
    return pixels.select(*keys, F.posexplode("samples").alias("s", "v")).select(*keys, "s", *[F.col(f"v.{f}").alias(f) for f in FIELDS])


def _sample(**values) -> Column:
    return F.struct(*[values[f].alias(f) for f in FIELDS])


def flattened(samples: Column) -> Column:
    """Front-to-back over: (r, g, b, a); what lies behind an opaque depth adds nothing."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b", "a")])

    def step(acc, s):
        keep = F.when(acc["a"] >= OPAQUE, F.lit(0.0)).otherwise(1.0 - acc["a"])
        return F.struct(*[(acc[c] + s[c] * keep).alias(c) for c in ("r", "g", "b", "a")])

    return F.aggregate(samples, zero, step)


def _bound(value: Column, f) -> Column:
    """`f` of a value that is computed once for a row, however often `f` names it (a lambda would compute it at each element)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _if_several(samples: Column, f) -> Column:
    """`f(samples)`, but pixels of one sample or none, which most are, stay as they are."""
    return _bound(samples, lambda s: F.when(F.size(s) <= 1, s).otherwise(f(s)))


def merge_overlaps(samples: Column) -> Column:
    """Neighbours at the same depth range become one: alphas combine, colours are weighted by them.

    Samples get the number of their run, and each run is folded by itself, so a
    pixel's work grows with its samples, not with their square.
    """
    return _if_several(samples, _merged_runs)


def _merged_runs(samples: Column) -> Column:
    def apart(i):
        a, b = F.get(samples, i - 1), F.get(samples, i)
        return (F.abs(a["z"] - b["z"]) >= SAME) | (F.abs(a["zback"] - b["zback"]) >= SAME)

    def step(last, s):
        a = last["a"] + s["a"] * (1.0 - last["a"])
        safe = F.when(a > 0, a).otherwise(1.0)
        mix = lambda c: F.when(a > 0, (last[c] * last["a"] + s[c] * s["a"] * (1.0 - last["a"])) / safe).otherwise((last[c] + s[c]) / 2)
        return _sample(z=last["z"], zback=last["zback"], a=a, r=mix("r"), g=mix("g"), b=mix("b"))

    n = F.size(samples)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | apart(i))

    def runs(starts):
        def run(begin, k):
            end = F.coalesce(F.get(starts, k + 1), n)
            rest = F.slice(samples, begin + 2, end - begin - 1)
            return F.aggregate(rest, F.get(samples, begin), step)

        # Where every sample begins a run, all stay.
        return F.when(F.size(starts) == n, samples).otherwise(F.transform(starts, run))

    return _bound(starts, runs)


def opaque_z(samples: Column) -> Column:
    """The depth at which alpha has added up to opaque; null if it never does."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(None).cast("double").alias("z"))

    def step(acc, s):
        a = acc["a"] + s["a"] * (1.0 - acc["a"])
        return F.struct(a.alias("a"), F.coalesce(acc["z"], F.when(a >= OPAQUE, s["z"])).alias("z"))

    return F.aggregate(samples, zero, step)["z"]


def culled(samples: Column) -> Column:
    """Without what lies behind the opaque depth."""
    return _if_several(
        samples, lambda every: _bound(opaque_z(every), lambda limit: F.when(limit.isNull(), every).otherwise(F.filter(every, lambda s: s["z"] <= limit)))
    )


def tidied(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("samples", merge_overlaps(F.sort_array("samples"))).withColumn("samples", culled(F.col("samples")))


def merged(a: DataFrame, b: DataFrame, keys=("y", "x"), overlaps: bool = True) -> DataFrame:
    """Samples of both at each pixel, in order; those at the same depth range become one, or all stay (`overlaps` false)."""
    both = gathered(a.unionByName(b), keys)
    return both.withColumn("samples", merge_overlaps(F.col("samples"))) if overlaps else both


def holdout(pixels: DataFrame, z: float) -> DataFrame:
    return pixels.withColumn("samples", F.filter("samples", lambda s: s["z"] <= z))


def holdout_matte(pixels: DataFrame, matte: DataFrame, keys=("y", "x")) -> DataFrame:
    """Without samples behind the nearest one of a matte's pixel."""
    near = matte.groupBy(*keys).agg(F.min("z").alias("near"))
    joined = pixels.join(near, list(keys), "left")
    return joined.select(*keys, F.filter("samples", lambda s: F.col("near").isNull() | (s["z"] <= F.col("near"))).alias("samples"))


def split(samples: Column, depth: float) -> Column:
    """Volume samples that span `depth` become two; each part keeps 1 - (1 - a)^t of the alpha."""

    def one(s):
        t = (F.lit(depth) - s["z"]) / F.when(s["zback"] > s["z"], s["zback"] - s["z"]).otherwise(1.0)
        part = lambda t: F.lit(1.0) - F.pow(1.0 - s["a"], t)
        def piece(z, zback, t):
            k = F.when(s["a"] > 0, part(t) / F.when(s["a"] > 0, s["a"]).otherwise(1.0)).otherwise(t)
            return _sample(z=z, zback=zback, a=part(t), r=s["r"] * k, g=s["g"] * k, b=s["b"] * k)
        spans = (s["z"] < depth) & (s["zback"] > depth)
        return F.when(spans, F.array(piece(s["z"], F.lit(depth), t), piece(F.lit(depth), s["zback"], 1.0 - t))).otherwise(F.array(s))

    return F.flatten(F.transform(samples, one))


def deepened(flat: DataFrame, z: float | None = None, keys=("y", "x")) -> DataFrame:
    """One sample for each pixel, at depth `z` or at that of column z."""
    depth = F.lit(float(z)) if z is not None else F.col("z")
    return flat.select(*keys, F.array(_sample(z=depth, zback=depth, a=F.col("a"), r=F.col("r"), g=F.col("g"), b=F.col("b"))).alias("samples"))


def stats(pixels: DataFrame) -> DataFrame:
    """Counts of samples and the range of depth over all pixels."""
    n = F.size("samples")
    z = lambda f: f(F.transform("samples", lambda s: s["z"]))
    return pixels.agg(
        F.sum(n).alias("total_samples"),
        F.max(n).cast("bigint").alias("max_samples"),
        F.avg(n).alias("avg_samples"),
        F.count_if(n == 0).alias("empty_pixels"),
        F.count_if(n > 1).alias("multi_pixels"),
        F.coalesce(F.min(z(F.array_min)), F.lit(0.0)).alias("min_z"),
        F.coalesce(F.max(z(F.array_max)), F.lit(0.0)).alias("max_z"),
    )


def insert_samples(samples: Column, at: int, new: Column) -> Column:
    return F.concat(F.slice(samples, 1, at), new, F.slice(samples, at + 1, F.greatest(F.size(samples) - at, F.lit(0))))


def erase_samples(samples: Column, at: int, n: int) -> Column:
    return F.concat(F.slice(samples, 1, at), F.slice(samples, at + n + 1, F.greatest(F.size(samples) - at - n, F.lit(0))))
