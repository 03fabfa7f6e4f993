"""Filtered texture lookups: a pyramid, a level for each lookup, and blends of levels and of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ex
from .image import Img
from .sampling import environment_st, mip_level, mip_levels, mip_pyramid


#: The side of a block of texels, and copies of a coarser level's block at most.
SIDE, MOST_COPIES = 8, 4096


def trilinear(lookups: DataFrame, texture: Img, wrap: str = "periodic") -> DataFrame:
    """Lookups (key, image_id, u, v, level) of a texture: bilinear in the two levels around `level`, blended."""
    alone = {"du": F.lit(0.0), "dv": F.lit(0.0), "n": F.lit(1)}
    return _along(lookups.select("key", "image_id", "u", "v", "level", *[c.alias(k) for k, c in alone.items()]), texture, wrap)


def _along(lookups: DataFrame, texture: Img, wrap: str) -> DataFrame:
    """Lookups (key, image_id, u, v, du, dv, n, level): the mean of n trilinear ones, spread evenly along (du, dv) around (u, v).

    The pyramid stands in blocks of texels that overlap by one, so the four texels of any place are in one block. A lookup is sent once
    to each block that its places are in, with their line and not the places, and meets it in one equi-join. A level has fewer blocks the
    coarser it is, and each gets more lookups; so blocks stand there in copies, and lookups are dealt among them by their keys.
    """
    w, h, levels = texture.roi.width, texture.roi.height, mip_levels(texture.roi.width, texture.roi.height)
    low = F.least(F.floor("level"), F.lit(levels - 1)).cast("int")
    both = F.array(
        F.struct(low.alias("l"), (1 - (F.col("level") - low)).alias("lw")),
        F.struct(F.least(low + 1, F.lit(levels - 1)).alias("l"), (F.col("level") - low).alias("lw")),
    )
    line = ["u", "v", "du", "dv", "n"]
    places = lookups.select("key", "image_id", *line, F.explode(both).alias("b")).select("key", "image_id", *line, F.col("b.l").alias("level"), "b.lw").where("lw > 0")
    sent = places.withColumn("block", F.explode(F.array_distinct(F.transform(_places(w, h, wrap), lambda p: p["block"]))))
    sent = sent.withColumn("copy", F.pmod(F.xxhash64("key"), _copies(w, h)).cast("int"))
    found = sent.join(_blocks(texture, wrap), ["image_id", "level", "block", "copy"], "left")

    def value(c: str) -> Column:
        def add(total, p):
            texel = lambda dy, dx: F.coalesce(F.get(F.col(f"t_{c}"), p["at"] + dy * (SIDE + 1) + dx), F.lit(0.0))
            row = lambda dy: (1 - p["fx"]) * texel(dy, 0) + p["fx"] * texel(dy, 1)
            return total + (1 - p["fy"]) * row(0) + p["fy"] * row(1)

        here = F.filter(_places(w, h, wrap), lambda p: p["block"] == F.col("block"))
        return F.col("lw") * F.aggregate(here, F.lit(0.0), add) / F.col("n")

    sums = found.select("key", *[F.when(F.col(f"t_{c}").isNotNull(), value(c)).otherwise(0.0).alias(c) for c in texture.channels])
    return sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in texture.channels])


def _side(full: int) -> Column:
    """The length of an axis at the level of a row."""
    return F.greatest(F.lit(1), F.expr(f"shiftright({full}, level)"))


def _places(w: int, h: int, wrap: str) -> Column:
    """The places of a lookup: the block of each, where its first texel stands in it, and the parts of the next texels along x and y."""

    def spot(i):
        step = (i - 0.5) / F.col("n") - 0.5
        sx, sy = (F.col("u") + F.col("du") * step) * _side(w) - 0.5, (F.col("v") + F.col("dv") * step) * _side(h) - 0.5
        return F.struct(sx.alias("sx"), sy.alias("sy"))

    def strip(s):
        x, y = F.floor(s["sx"]), F.floor(s["sy"])
        return F.struct(_first(x, _side(w), wrap).alias("x"), _first(y, _side(h), wrap).alias("y"), (s["sx"] - x).alias("fx"), (s["sy"] - y).alias("fy"))

    def inside(s):
        at = ((s["y"] % SIDE) * (SIDE + 1) + s["x"] % SIDE).cast("int").alias("at")
        return F.struct(_number(F.floor(s["y"] / SIDE), F.floor(s["x"] / SIDE)), at, s["fx"].alias("fx"), s["fy"].alias("fy"))

    return F.transform(F.transform(F.transform(F.sequence(F.lit(1), F.col("n")), spot), strip), inside)


def _number(by: Column, bx: Column) -> Column:
    return (by.cast("bigint") * (1 << 31) + bx.cast("bigint")).alias("block")


def _first(at: Column, n: Column, wrap: str) -> Column:
    """A place brought into the strip of texels of a wrap mode, from 0; it and the one after it show what `at` and the one after show."""
    if wrap == "periodic":
        return F.pmod(at, n) + 2
    if wrap == "mirror":
        return F.pmod(at, n * 2) + 2
    # Beyond the first and last texel a strip shows these again (clamp) or nothing (black).
    beyond = 1 if wrap == "clamp" else 2
    return F.greatest(F.lit(-beyond), F.least(n + (beyond - 2), at)) + 2


def _shown(at: Column, n: Column, wrap: str) -> Column:
    """All places of a texel in the strip of a wrap mode."""
    more = {
        "periodic": [F.when(at == 0, n)],
        "mirror": [n * 2 - 1 - at, F.when(at == 0, n * 2)],
        "clamp": [F.when(at == 0, F.lit(-1)), F.when(at == n - 1, n)],
    }
    return F.transform(F.array_compact(F.array(at, *more.get(wrap, []))), lambda e: e + 2)


def _copies(w: int, h: int) -> Column:
    """How many copies a level's blocks have: a quarter of the blocks of the first level for each of its own."""
    count = [max(1, -(-(w >> i) // SIDE)) * max(1, -(-(h >> i) // SIDE)) for i in range(mip_levels(w, h))]
    return F.get(F.array(*[F.lit(max(1, min(MOST_COPIES, count[0] // (4 * n)))) for n in count]), F.col("level"))


def _blocks(texture: Img, wrap: str) -> DataFrame:
    """The pyramid as (image_id, level, block, copy, t_<channel>): arrays of SIDE + 1 rows of SIDE + 1 texels, null where none stands."""
    w, h = texture.roi.width, texture.roi.height

    def parts(c: str, n: Column):
        """The blocks along one axis that a texel is in, and where: a block's last row or column is the next one's first."""
        own = lambda p: F.struct(F.floor(p / SIDE).cast("int").alias("b"), (p % SIDE).cast("int").alias("o"))
        last = lambda p: F.struct((F.floor(p / SIDE) - 1).cast("int").alias("b"), F.lit(SIDE).alias("o"))
        return F.flatten(F.transform(_shown(F.col(c), n, wrap), lambda p: F.when(p % SIDE == 0, F.array(own(p), last(p))).otherwise(F.array(own(p)))))

    rows = mip_pyramid(texture).withColumn("__ey", F.explode(parts("y", _side(h))))
    rows = rows.withColumn("__ex", F.explode(parts("x", _side(w))))
    texel = F.struct((F.col("__ey.o") * (SIDE + 1) + F.col("__ex.o")).alias("__spot"), *texture.channels)
    held = rows.select("image_id", "level", _number(F.col("__ey.b"), F.col("__ex.b")), texel.alias("t")).groupBy("image_id", "level", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    full, spots = (SIDE + 1) ** 2, F.transform("ts", lambda t: t["__spot"])

    def dense(c: str) -> Column:
        filled = F.transform(F.sequence(F.lit(0), F.lit(full - 1)), lambda o: F.get(F.col(f"v_{c}"), F.array_position(F.col("spots"), o).cast("int") - 1))
        return F.when(F.size(F.col("spots")) == full, F.col(f"v_{c}")).otherwise(filled)

    flat = held.select("image_id", "level", "block", spots.alias("spots"), *[F.transform("ts", lambda t: t[c]).alias(f"v_{c}") for c in texture.channels])
    made = flat.select("image_id", "level", "block", *[dense(c).alias(f"t_{c}") for c in texture.channels])
    return made.withColumn("copy", F.explode(F.sequence(F.lit(0), _copies(w, h) - 1)))


def levelled(lookups: DataFrame, texture: Img) -> DataFrame:
    """Lookups with derivatives (dudx, dvdx, dudy, dvdy in texture units) get their `level`."""
    w, h = float(texture.roi.width), float(texture.roi.height)
    n = mip_levels(texture.roi.width, texture.roi.height)
    level = mip_level(ex("dudx") * w, ex("dvdx") * h, ex("dudy") * w, ex("dvdy") * h, n)
    return lookups.withColumn("level", level.col)


def anisotropic(lookups: DataFrame, texture: Img, wrap: str = "periodic", most: int = 16) -> DataFrame:
    """Several trilinear lookups along the longer side of the footprint, at the level of the shorter one; their mean."""
    w, h = float(texture.roi.width), float(texture.roi.height)
    n = mip_levels(texture.roi.width, texture.roi.height)
    a = F.sqrt(F.pow(F.col("dudx") * w, 2) + F.pow(F.col("dvdx") * h, 2))
    b = F.sqrt(F.pow(F.col("dudy") * w, 2) + F.pow(F.col("dvdy") * h, 2))
    long, short = F.greatest(a, b), F.greatest(F.least(a, b), F.lit(1e-6))
    count = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(long / F.greatest(short, F.lit(1.0))))).cast("int")
    level = F.least(F.lit(float(n - 1)), F.log2(F.greatest(F.lit(1.0), long / count)))
    du, dv = F.when(a >= b, F.col("dudx")).otherwise(F.col("dudy")), F.when(a >= b, F.col("dvdx")).otherwise(F.col("dvdy"))
    return _along(lookups.select("key", "image_id", "u", "v", du.alias("du"), dv.alias("dv"), count.alias("n"), level.alias("level")), texture, wrap)


def volume(lookups: DataFrame, slices: Img, depth: int) -> DataFrame:
    """Lookups (key, u, v, t) of a texture in space whose slices are images 0 to depth - 1, linear in all directions."""
    at = F.greatest(F.lit(0.0), F.least(F.col("t") * depth - 0.5, F.lit(depth - 1.0)))
    low = F.floor(at)
    pair = F.array(F.struct(low.alias("z"), (1 - (at - low)).alias("zw")), F.struct(F.least(low + 1, F.lit(depth - 1)).alias("z"), (at - low).alias("zw")))
    spread = lookups.select("key", "u", "v", F.explode(pair).alias("p")).select(
        F.struct("key", F.col("p.z").alias("z"), F.col("p.zw").alias("zw")).alias("key"), F.col("p.z").cast("bigint").alias("image_id"), "u", "v", F.lit(0.0).alias("level")
    ).where("key.zw > 0")
    found = trilinear(spread, slices, "clamp")
    return found.groupBy(F.col("key.key").alias("key")).agg(*[F.sum(F.col(c) * F.col("key.zw")).alias(c) for c in slices.channels])


def environment(directions: DataFrame, texture: Img) -> DataFrame:
    """Lookups (key, image_id, dx, dy, dz, level) of latitude-longitude images by direction, trilinear; u goes around."""
    u, v = environment_st("dx", "dy", "dz")
    return trilinear(directions.select("key", "image_id", u.col.alias("u"), v.col.alias("v"), "level"), texture, "periodic")
