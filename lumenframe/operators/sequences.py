"""File sequences, frame sets, UDIM tiles and file metadata as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = r"^(.*?)(\d+)(\D*)$"


def parts(path: Column) -> dict[str, Column]:
    """prefix, frame, suffix and padding of a path: the frame is its last run of digits."""
    digits = F.regexp_extract(path, r"(\d+)\D*$", 1)
    return {
        "prefix": F.regexp_replace(path, r"\d+\D*$", ""),
        "suffix": F.regexp_extract(path, r"\d+(\D*)$", 1),
        "padding": F.length(digits),
        "frame": digits.cast("bigint"),
    }


def scan(paths: DataFrame, path: str = "path") -> DataFrame:
    """(prefix, suffix, padding, first, last, n): the sequences among file names."""
    p = parts(F.col(path))
    rows = paths.where(F.col(path).rlike(r"\d")).select(*[c.alias(k) for k, c in p.items()])
    return rows.groupBy("prefix", "suffix", "padding").agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.countDistinct("frame").alias("n")
    )


def frame_path(prefix: Column, frame: Column, padding: Column, suffix: Column) -> Column:
    return F.concat(prefix, F.lpad(frame.cast("string"), F.greatest(padding, F.length(frame.cast("string"))), F.lit("0")), suffix)


def ranges(frames: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """(keys, first, last, n): runs of consecutive frames."""
    order = Window.partitionBy(*keys).orderBy(frame)
    island = frames.select(*keys, frame).distinct().withColumn("island", F.col(frame) - F.row_number().over(order))
    return island.groupBy(*keys, "island").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("n")).drop("island")


def missing(frames: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """(keys, first, last): gaps between runs; found from neighbours, no full range is generated."""
    order = Window.partitionBy(*keys).orderBy(frame)
    after = frames.select(*keys, frame).distinct().withColumn("next", F.lead(frame).over(order))
    return after.where(F.col("next") - F.col(frame) > 1).select(*keys, (F.col(frame) + 1).alias("first"), (F.col("next") - 1).alias("last"))


def udim(u: Column, v: Column) -> Column:
    """The tile number of texture coordinates."""
    tile = lambda c, most: F.greatest(F.lit(0), F.least(F.floor(c), F.lit(most)))
    return (F.lit(1001) + tile(u, 9) + tile(v, 99) * 10).cast("int")


def udim_place(tile: Column) -> tuple[Column, Column]:
    return (tile - 1001) % 10, F.floor((tile - 1001) / 10)


def grep(files: DataFrame, text: str, columns: list[str], ignore_case: bool = False) -> DataFrame:
    """Rows of which some column contains `text`."""
    hit = F.lit(False)
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        hit = hit | (F.lower(value).contains(text.lower()) if ignore_case else value.contains(text))
    return files.where(hit)


def attribute(document: Column, path: str) -> Column:
    """The value at a path of names joined by colons, in a JSON document; null where there is none."""
    return F.get_json_object(document, "$." + ".".join(path.split(":")))


def flat_attributes(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, name, value) of the top-level attributes of JSON documents."""
    entries = F.from_json(document, "map<string,string>")
    return rows.select(key, F.explode(entries).alias("name", "value"))


def status_counts(results: DataFrame) -> DataFrame:
    """(status, n) of a batch's per-file results."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


def as_xml(columns: list[str]) -> Column:
    """Columns as one XML element."""
    return F.to_xml(F.struct(*columns))


def attribute_count(document: Column) -> Column:
    """How many attributes a JSON document has at its top; 0 for what is no object."""
    return F.coalesce(F.size(F.json_object_keys(document)), F.lit(0)).cast("bigint")


def attributes_hash(document: Column) -> Column:
    """A digest of a JSON document's attributes that doesn't depend on their order."""
    pairs = F.from_json(document, "map<string,string>")
    texts = F.transform(F.array_sort(F.map_keys(pairs)), lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(pairs, k), F.lit(""))))
    return F.sha2(F.concat_ws("\n", texts).cast("binary"), 256)


def as_int(value: Column) -> Column:
    """A text attribute as an integer: whole numbers as they are, others cut off, held in the range of 32 bits; null for what is no number."""
    number = value.try_cast("double")
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(F.isnan(number), None).otherwise(F.greatest(F.lit(-(1 << 31)), F.least(F.lit((1 << 31) - 1), cut))).cast("int")


def with_attribute(document: Column, name: str, value: Column) -> Column:
    """A JSON document of text attributes with one set: a JSON object whose values are texts, in the order of their names."""
    pairs = F.coalesce(F.from_json(document, "map<string,string>"), F.create_map().cast("map<string,string>"))
    others = F.map_filter(pairs, lambda k, _: k != name)
    entries = F.array_sort(F.map_entries(F.map_concat(others, F.create_map(F.lit(name), value.cast("string")))))
    return F.to_json(F.map_from_entries(entries))


def from_xml(document: Column, schema: str) -> Column:
    return F.from_xml(document, schema)


def udim_tiles(paths: DataFrame, path: str = "path") -> DataFrame:
    """(prefix, suffix, tile, u, v) of file names whose four-digit number is a tile from 1001 to 1999."""
    tile = F.regexp_extract(path, r"(?<!\d)(1\d{3})(?!\d)\D*$", 1)
    rows = paths.where(tile != "").withColumn("tile", tile.cast("int")).where("tile BETWEEN 1001 AND 1999")
    u, v = udim_place(F.col("tile"))
    return rows.select(
        F.regexp_replace(path, r"1\d{3}\D*$", "").alias("prefix"), F.regexp_extract(path, r"1\d{3}(\D*)$", 1).alias("suffix"), "tile",
        u.cast("int").alias("u"), v.cast("int").alias("v"),
    )


def tile_of(path: str):
    """The tile number in a file's name; null if there is none from 1001 to 1999."""
    tile = F.regexp_extract(path, r"(?<!\d)(1\d{3})(?!\d)\D*$", 1)
    return F.when(tile.between("1001", "1999"), tile.cast("int"))


def scaled_tiles(pixels: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """Pixels (tile, y, x, ...) of tiles (tile, width, height) as tiles of `size` squared: each place takes the pixel it falls on."""
    places = sizes.select("tile", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("ty")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("tx")
    )
    at = lambda c, n: F.floor((F.col(c) + 0.5) * F.col(n) / size).cast("int")
    wanted = places.select("tile", "ty", "tx", at("ty", "height").alias("y"), at("tx", "width").alias("x"))
    return wanted.join(pixels, ["tile", "y", "x"]).drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})
