"""`python -m lumenframe.cli COMMAND …`: commands on image files, each a short Spark job."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color
from .functions.expr import Op
from .operators import composite, filters, geometry, layers, repair, sampling, sequences, stats
from .operators.image import Img, Roi
from .sources import codecs, files


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lumenframe").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def opened(spark: SparkSession, path: str) -> Img:
    """The image of one file with channels r, g, b, a and whatever else the file has.

    A missing alpha is opaque, other missing channels are black, a grey one fills r, g and b.
    """
    info = files.images(spark, path).orderBy("subimage").first()
    if info is None or info.width is None:
        raise SystemExit(f"can't read {path}: {info.error if info else 'no such file'}")
    own = info.channel_names
    px = files.pixels(spark, path, tuple(own)).where("error IS NULL")
    grey = F.col("y") if "y" in own else F.lit(0.0)
    fill = {c: F.col(c) if c in own else grey for c in "rgb"} | {"a": F.col("a") if "a" in own else F.lit(1.0)}
    others = {f"{c}": F.col(f"`{c}`") for c in own if c not in (*"rgba", "y")}
    keys = [F.lit(0).cast("bigint").alias("image_id"), F.col("py").alias("y"), F.col("px").alias("x")]
    df = px.select(*keys, *[v.alias(plain(c)) for c, v in (fill | others).items()])
    return Img(df, Roi(0, info.width, 0, info.height), tuple(plain(c) for c in fill | others))


def plain(name: str) -> str:
    """A channel's name as a column's: without dots, which SQL takes for fields."""
    return name.replace(".", "__")


def has_alpha(spark: SparkSession, path: str) -> bool:
    info = files.images(spark, path).orderBy("subimage").first()
    return info is not None and "a" in (info.channel_names or [])


def saved(img: Img, path: str, bits: int | None = None, alpha: bool = True) -> None:
    """One file with all channels that its format holds; the folder may be in any store that the executors reach."""
    folder, _, name = path.rpartition("/")
    kind = name.rsplit(".", 1)[-1].lower()
    kept = [c for c in img.channels if codecs.holds(kind, c) and (alpha or c != "a")]
    rows = img.df.select(
        F.lit(name).alias("path"), (F.col("y") - img.roi.y0).alias("py"), (F.col("x") - img.roi.x0).alias("px"), *[F.col(c).alias(c.replace("__", ".")) for c in kept]
    )
    files.save(files.encoded(rows, kind, channels=tuple(c.replace("__", ".") for c in kept), bits=bits), folder or ".")


def shown(df: DataFrame, most: int = 1000) -> None:
    """The first rows, and how many there are if that isn't all."""
    rows = df.limit(most + 1).collect()
    for row in rows[:most]:
        print("  ".join(f"{k}={v}" for k, v in row.asDict().items()))
    if len(rows) > most:
        print(f"... {df.count()} rows in all")


def colours(img: Img) -> Img:
    return img.select({c: F.col(c) for c in "rgba"})


def coloured(img: Img, op: Op) -> Img:
    """A colour operation; channels that are no colours pass unchanged."""
    return layers.color_only(img, op)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenframe")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args, out: bool = True, second: bool = False):
        c = sub.add_parser(name)
        c.add_argument("input")
        if second:
            c.add_argument("second")
        if out:
            c.add_argument("output")
        for flag, kind, default in args:
            c.add_argument(f"--{flag}", type=kind, default=default)

    command("info", out=False)
    command("stats", out=False)
    command("grep", ("text", str, ""), out=False)
    command("diff", ("fail", float, 0.0), ("warn", float, 1e-6), out=False, second=True)
    command("convert", ("bits", int, None))
    command("resize", ("width", int, 0), ("height", int, 0), ("scale", float, 1.0), ("filter", str, "lanczos3"))
    command("crop", ("x", int, 0), ("y", int, 0), ("width", int, 1), ("height", int, 1))
    command("transform", ("op", str, "flip"))
    command("rotate", ("degrees", float, 0.0))
    command("blur", ("sigma", float, 1.0), ("box", int, 0))
    command("sharpen")
    command("composite", ("mode", str, "over"), second=True)
    command("paste", ("x", int, 0), ("y", int, 0), second=True)
    command("grade", *((f"{n}", float, d) for n, d in (("slope", 1.0), ("offset", 0.0), ("power", 1.0), ("saturation", 1.0))))
    command("clamp", ("low", float, 0.0), ("high", float, 1.0))
    command("premult")
    command("unpremult")
    command("color", ("source", str, "sRGB"), ("target", str, "ACEScg"))
    command("lut", ("file", str, ""))
    command("aces", ("op", str, "rrt-odt"))
    command("warp", ("kind", str, "barrel"), ("k1", float, 0.1), ("k2", float, 0.0), ("radius", float, 1.0))
    command("maketx")
    command("fill")
    command("shuffle", ("pattern", str, "RGB"))
    command("batch", ("op", str, "convert"), ("scale", float, 1.0), ("radius", int, 3), ("format", str, None))
    command("layers", out=False)
    command("extract-layer", ("layer", str, ""))
    command("channel-extract", ("channels", str, "r"))
    merge = sub.add_parser("merge-layers")
    merge.add_argument("inputs", nargs="+")
    merge.add_argument("--output", required=True)
    merge.add_argument("--names", default="")
    udim = sub.add_parser("udim")
    udim.add_argument("action", choices=("info", "convert", "atlas", "split"))
    udim.add_argument("input")
    udim.add_argument("output", nargs="?")
    udim.add_argument("--tile-size", type=int, default=1024)
    return p


TRANSFORMS = {
    "flip": geometry.flip, "flop": geometry.flop, "transpose": geometry.transpose, "rot90": geometry.rotate90, "rot180": geometry.rotate180,
    "rot270": geometry.rotate270,
}


def changed(spark: SparkSession, a: argparse.Namespace) -> Img:
    """The image that a command makes."""
    img, c = opened(spark, a.input), a.command
    if c == "convert":
        return img
    if c == "resize":
        w, h = a.width or max(1, round(img.roi.width * a.scale)), a.height or max(1, round(img.roi.height * a.scale))
        return sampling.resize(img, w, h, a.filter) if a.filter in ("nearest", "bicubic") else sampling.resize_filtered(img, w, h, a.filter)
    if c == "crop":
        return img.crop(Roi(a.x, a.x + a.width, a.y, a.y + a.height))
    if c == "transform":
        return TRANSFORMS[a.op](img)
    if c == "rotate":
        return sampling.rotate(img, a.degrees * 3.141592653589793 / 180)
    if c == "blur":
        return filters.box_blur(img, a.box) if a.box else filters.blur(img, a.sigma)
    if c == "sharpen":
        return filters.sharpen(img)
    if c == "composite":
        return composite.composite(a.mode, colours(img), colours(opened(spark, a.second)))
    if c == "paste":
        return composite.paste(colours(img), colours(opened(spark, a.second)), a.x, a.y)
    if c == "grade":
        return coloured(img, color.cdl((a.slope,) * 3, (a.offset,) * 3, (a.power,) * 3, a.saturation))
    if c == "clamp":
        return coloured(img, color.clamped((a.low,), (a.high,)))
    if c in ("premult", "unpremult"):
        return coloured(img, color.premultiplied() if c == "premult" else color.unpremultiplied())
    if c == "shuffle":
        return geometry.shuffle_pattern(img, a.pattern)
    if c == "fill":
        return repair.push_pull(colours(img))
    if c == "warp":
        kinds = {
            "barrel": lambda r: sampling.barrel(r, a.k1, a.k2), "pincushion": lambda r: sampling.pincushion(r, a.k1, a.k2),
            "fisheye": lambda r: sampling.fisheye(r, a.k1), "twist": lambda r: sampling.twist(r, a.k1, a.radius), "wave": lambda r: sampling.wave(r, a.k1, a.k2),
            "spherize": lambda r: sampling.spherize(r, a.k1, a.radius), "ripple": lambda r: sampling.ripple(r, a.k1, a.k2, a.radius),
        }
        return sampling.sampled(img, img.roi, kinds[a.kind](img.roi))
    from .plans import catalog, ir

    if c == "aces":
        conversion = catalog.standard().conversion
        idt, odt = conversion("sRGB", "ACEScg"), conversion("ACEScg", "sRGB")
        if a.op == "idt":
            return through(img, idt)
        toned = coloured(img, color.tone_mapped()) if a.op.startswith("rrt") else img
        return through(toned, odt) if a.op.endswith("odt") else toned
    if c == "color":
        return through(img, catalog.standard().conversion(a.source, a.target))
    if c == "lut":
        text = spark.read.text(a.file, wholetext=True).first().value
        return through(img, catalog.from_file(a.file, text))
    if c == "extract-layer":
        return geometry.renamed(picked(img, [n for n in img.channels if layers.layer_of(n.replace("__", ".")) == a.layer]), lambda n: n.rpartition("__")[2].lower())
    if c == "channel-extract":
        return picked(img, [plain(n.strip()) for n in a.channels.split(",")])
    raise SystemExit(f"unknown command {c}")


def through(img: Img, transforms) -> Img:
    from .plans import ir

    for op in ir.compiled(transforms):
        img = coloured(img, op)
    return img


def picked(img: Img, names: list[str]) -> Img:
    missing = [n for n in names if n not in img.channels]
    if missing or not names:
        raise SystemExit(f"no channel {', '.join(missing) or 'named'} among {', '.join(img.channels)}")
    return img.select({n: F.col(n) for n in names})


def merged(spark: SparkSession, a: argparse.Namespace) -> None:
    """Images of one size as layers of one EXR file: the first without a prefix, the others under their names."""
    names = a.names.split(",") if a.names else [f"layer{i}" for i in range(len(a.inputs))]
    if len(names) != len(a.inputs):
        raise SystemExit("as many names as inputs are needed")
    out = None
    for name, path in zip(names, a.inputs, strict=True):
        img = opened(spark, path)
        if out is not None and img.roi != out.roi:
            raise SystemExit("the images differ in size")
        own = geometry.renamed(img, lambda c, name=name: f"{name}__{c.upper() if len(c) == 1 else c}")
        out = own if out is None else Img(out.df.join(own.df, ["image_id", "y", "x"]), out.roi, (*out.channels, *own.channels))
    saved(out, a.output)


def udim(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tiles of a texture set: info, convert to another pattern, one atlas of all, or an image split into tiles."""
    if a.action == "split":
        img, size = opened(spark, a.input), a.tile_size
        u, v = F.floor(F.col("x") / size), F.lit(-(-img.roi.height // size) - 1) - F.floor(F.col("y") / size)
        kind, kept = a.output.rsplit(".", 1)[-1], [c for c in ("r", "g", "b") if c in img.channels]
        name = F.regexp_replace(F.lit(a.output.rpartition("/")[2]), "<UDIM>", (F.lit(1001) + u + v * 10).cast("string"))
        rows = img.df.select(name.alias("path"), (F.col("y") % size).alias("py"), (F.col("x") % size).alias("px"), *kept)
        files.save(files.encoded(rows, kind, channels=tuple(kept)), a.output.rpartition("/")[0] or ".")
        return
    found = files.images(spark, a.input.replace("<UDIM>", "*"))
    tiles = found.withColumn("tile", sequences.tile_of("path")).where("tile IS NOT NULL")
    u, v = sequences.udim_place(F.col("tile"))
    if a.action == "info":
        shown(tiles.select("tile", u.cast("int").alias("u"), v.cast("int").alias("v"), "width", "height", "path", "error").orderBy("tile"))
        return
    own = files.pixels(spark, a.input.replace("<UDIM>", "*")).where("error IS NULL").withColumn("tile", sequences.tile_of("path")).where("tile IS NOT NULL")
    rgb = [F.coalesce(c, "y", F.lit(0.0)).alias(c) for c in ("r", "g", "b")]
    kind = a.output.rsplit(".", 1)[-1]
    if a.action == "convert":
        name = F.regexp_replace(F.lit(a.output.rpartition("/")[2]), "<UDIM>", F.col("tile").cast("string"))
        files.save(files.encoded(own.select(name.alias("path"), "py", "px", *rgb), kind), a.output.rpartition("/")[0] or ".")
        return
    box = tiles.agg(F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1")).first()
    if box.u0 is None:
        raise SystemExit(f"no tiles in {a.input}")
    # Each pixel of the atlas takes the pixel of its tile that it falls on.
    size = a.tile_size
    scaled = sequences.scaled_tiles(own.select("tile", F.col("py").alias("y"), F.col("px").alias("x"), *rgb), tiles.select("tile", "width", "height"), size)
    u, v = sequences.udim_place(F.col("tile"))
    placed = scaled.select(
        F.lit(a.output.rpartition("/")[2]).alias("path"), (F.col("y") + (F.lit(box.v1) - v) * size).cast("int").alias("py"), (F.col("x") + (u - box.u0) * size).cast("int").alias("px"), "r", "g", "b"
    )
    files.save(files.encoded(placed, kind), a.output.rpartition("/")[0] or ".")


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    if a.command == "info":
        shown(files.images(spark, a.input))
    elif a.command == "stats":
        shown(stats.pixel_stats(opened(spark, a.input)))
    elif a.command == "grep":
        from .operators.sequences import grep

        info = files.images(spark, a.input)
        size = F.concat_ws("x", "width", "height")
        shown(grep(info.withColumn("size", size), a.text, ["path", "format", "size", "attributes"], True).select("path", "format", "size"))
    elif a.command == "diff":
        one, two = opened(spark, a.input), opened(spark, a.second)
        if one.roi != two.roi:
            raise SystemExit("the images differ in size")
        result = stats.compare(colours(one), colours(two), a.fail or 1e30, a.warn).first()
        print("  ".join(f"{k}={v}" for k, v in result.asDict().items()))
        return int(a.fail > 0 and result.max_error > a.fail)
    elif a.command == "batch":
        # The statuses are stored beside the results, so that no file is processed twice.
        status = f"{a.output.rstrip('/')}/_status"
        files.batch(spark, a.input, a.op, a.output, scale=a.scale, radius=a.radius, format=a.format).write.mode("overwrite").parquet(status)
        results = spark.read.parquet(status)
        shown(results)
        return int(results.where("status = 'failed'").count() > 0)
    elif a.command == "layers":
        info = files.images(spark, a.input).select("path", "subimage", F.explode("channel_names").alias("channel"))
        shown(info.groupBy("path", "subimage", layers.layer_expression("channel").alias("layer")).agg(F.sort_array(F.collect_list("channel")).alias("channels")).orderBy("path", "subimage", "layer"))
    elif a.command == "merge-layers":
        merged(spark, a)
    elif a.command == "udim":
        udim(spark, a)
    elif a.command == "maketx":
        img, alpha = opened(spark, a.input), has_alpha(spark, a.input)
        stem, _, extension = a.output.rpartition(".")
        for level in range(sampling.mip_levels(img.roi.width, img.roi.height)):
            saved(img, f"{stem}.mip{level}.{extension}", alpha=alpha)
            img = sampling.halved(img)
    else:
        img = changed(spark, a)
        made = a.command in ("shuffle", "channel-extract", "extract-layer") and "a" in img.channels
        saved(img, a.output, getattr(a, "bits", None), made or has_alpha(spark, a.input) or a.command == "composite")
    return 0


if __name__ == "__main__":
    sys.exit(main())
