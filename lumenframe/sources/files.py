"""Image files as tables, and tables as image files.

Files come through Spark's binaryFile reader, so any store that Spark reads will do,
and are decoded where they are read. A file that can't be decoded becomes a row
with its error in every table; it never stops the others. Files are written by the
executors, through Arrow's file systems, each under a name of its own first.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codecs, exr
from .picture import Picture, Unreadable

#: Channels that have a column of their own wherever no others are asked for; the rest stand in the map `others`.
CHANNELS = ("r", "g", "b", "a", "y", "z")
IMAGES = (
    "path string, subimage int, format string, width int, height int, channel_names array<string>, attributes map<string,string>, bytes bigint, error string"
)
DEEP = "path string, y int, x int, s int, z double, zback double, a double, r double, g double, b double, others map<string,double>, error string"
#: What a decoder raises on a broken file.
BROKEN = (Unreadable, ArithmeticError, LookupError, ValueError, MemoryError, struct.error, zlib.error)


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _files(batches):
    """(path, content) of each row."""
    for batch in batches:
        yield from zip(batch.column("path").to_pylist(), (c.as_buffer().to_pybytes() for c in batch.column("content")), strict=True)


def _said(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def images(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image of each file, from its header: format, size, channels, attributes; or the error."""
    return described(binary(spark, path))


def described(files: DataFrame) -> DataFrame:
    """What the headers of (path, content) rows say."""

    def run(batches):
        for p, content in _files(batches):
            rows, kind = [], codecs.probe(content)
            base = {"path": p, "subimage": 0, "format": kind, "bytes": len(content)}
            try:
                for i in range(codecs.subimages(content)):
                    w, h, names, attributes = codecs.describe(content, i)
                    rows.append(base | {"subimage": i, "width": w, "height": h, "channel_names": names, "attributes": list(attributes.items())})
            except BROKEN as e:
                rows.append(base | {"subimage": len(rows), "error": _said(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=_IMAGES_ARROW)

    return files.select("path", "content").mapInArrow(run, IMAGES)


def estimated(images: DataFrame, memory: int) -> DataFrame:
    """`images` with the bytes that each takes in a worker (four a channel), and how to read it there.

    Under a quarter of `memory` an image is read as a whole; up to all of it in strips; above that in tiles,
    from a format that has blocks.
    """
    size = F.col("width").cast("bigint") * F.col("height") * F.size("channel_names") * 4
    how = F.when(size < memory // 4, "whole").when(size <= memory, "strips").otherwise("tiles")
    return images.withColumn("memory_bytes", size).withColumn("strategy", F.when(F.col("error").isNull(), how))


_MAP = pa.map_(pa.string(), pa.float64())
_IMAGES_ARROW = pa.schema([
    ("path", pa.string()), ("subimage", pa.int32()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
    ("channel_names", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.string())), ("bytes", pa.int64()), ("error", pa.string()),
])


def _maps(others: dict[str, np.ndarray], n: int) -> pa.Array:
    """A map of each row's values by name; null without names."""
    if not others:
        return pa.nulls(n, _MAP)
    names = pa.array(list(others) * n, pa.string())
    values = pa.array(np.stack([v.ravel() for v in others.values()], axis=1).ravel().astype("f8"))
    return pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(others)), names, values).cast(_MAP)


def _pixel_batch(path: str, picture: Picture, y0: int, y1: int, at: tuple[int, int], channels: tuple[str, ...] | None) -> pa.RecordBatch:
    w, n = picture.width, (y1 - y0) * picture.width
    ys, xs = np.mgrid[y0:y1, 0:w].astype(np.int32)
    columns = {"path": pa.array([path] * n), "py": pa.array((ys + at[1]).ravel()), "px": pa.array((xs + at[0]).ravel())}
    for c in channels or CHANNELS:
        v = picture.channels.get(c)
        columns[c] = pa.nulls(n, pa.float64()) if v is None else pa.array(v[y0:y1].ravel().astype("f8"))
    if channels is None:
        columns["others"] = _maps({c: v[y0:y1] for c, v in picture.channels.items() if c not in CHANNELS}, n)
    columns["error"] = pa.nulls(n, pa.string())
    return pa.RecordBatch.from_pydict(columns)


def pixels(spark: SparkSession, path: str, channels: tuple[str, ...] | None = None, subimage: int = 0, box: tuple[int, int, int, int] | None = None, level: int = 0) -> DataFrame:
    """One row for each pixel of each file: path, py, px, channels and error (null but in the one row of a broken file).

    Without `channels` there are columns r, g, b, a, y and z, null where a file has no such
    channel, and a map of all others. `box` (x0, y0, x1, y1) reads a box of each image, from EXR files only the blocks that
    meet it; `level` a level of an EXR pyramid.
    """
    return decoded(binary(spark, path), channels, subimage, box, level)


def decoded(files: DataFrame, channels: tuple[str, ...] | None = None, subimage: int = 0, box: tuple[int, int, int, int] | None = None, level: int = 0) -> DataFrame:
    """The pixels of (path, content) rows, wherever these come from. Files go in strips of rows."""
    names = channels or CHANNELS

    def picture(content: bytes) -> tuple[Picture, tuple[int, int]]:
        if codecs.probe(content) == "exr":
            w, h = exr.levels(exr.header(content, subimage))[level] if level else exr.size_of(content, subimage)
            at = (max(0, box[0]), max(0, box[1])) if box else (0, 0)
            return exr.read(content, subimage, level, box or (0, 0, w, h)), at
        if level:
            raise Unreadable("levels of a file without a pyramid")
        whole = codecs.decode(content, subimage)
        if box is None:
            return whole, (0, 0)
        x0, y0 = max(0, box[0]), max(0, box[1])
        cut = Picture({c: v[y0 : box[3], x0 : box[2]] for c, v in whole.channels.items()}, whole.attributes, whole.format)
        if 0 in next(iter(cut.channels.values())).shape:
            raise Unreadable("a box outside the image")
        return cut, (x0, y0)

    def run(batches):
        for p, content in _files(batches):
            try:
                found, at = picture(content)
            except BROKEN as e:
                columns = {"path": pa.array([p]), "py": pa.nulls(1, pa.int32()), "px": pa.nulls(1, pa.int32()), **{c: pa.nulls(1, pa.float64()) for c in names}}
                yield pa.RecordBatch.from_pydict(columns | ({"others": pa.nulls(1, _MAP)} if channels is None else {}) | {"error": pa.array([_said(e)])})
                continue
            step = max(1, 65536 // max(1, found.width))
            for y in range(0, found.height, step):
                yield _pixel_batch(p, found, y, min(y + step, found.height), at, channels)

    quoted = ", ".join(f"`{c}` double" for c in names)
    return files.select("path", "content").mapInArrow(run, f"path string, py int, px int, {quoted}, {'others map<string,double>, ' if channels is None else ''}error string")


def tiles(spark: SparkSession, path: str, size: int = 64, channel: str = "r", subimage: int = 0, level: int = 0) -> DataFrame:
    """(path, subimage, level, tile_y, tile_x, width, height, data): square tiles of a channel, rows one after another."""

    def run(batches):
        for p, content in _files(batches):
            try:
                found = exr.read(content, subimage, level) if codecs.probe(content) == "exr" else codecs.decode(content, subimage)
                values = found.channels[channel]
            except BROKEN as e:
                yield pa.RecordBatch.from_pylist([{"path": p, "subimage": subimage, "level": level, "error": _said(e)}], schema=_TILES_ARROW)
                continue
            for ty in range(0, found.height, size):
                out = []
                for tx in range(0, found.width, size):
                    part = values[ty : ty + size, tx : tx + size]
                    out.append({
                        "path": p, "subimage": subimage, "level": level, "tile_y": ty // size, "tile_x": tx // size, "width": part.shape[1], "height": part.shape[0],
                        "data": part.ravel().tolist(),
                    })
                yield pa.RecordBatch.from_pylist(out, schema=_TILES_ARROW)

    schema = "path string, subimage int, level int, tile_y int, tile_x int, width int, height int, data array<float>, error string"
    return binary(spark, path).select("path", "content").mapInArrow(run, schema)


_TILES_ARROW = pa.schema([
    ("path", pa.string()), *((c, pa.int32()) for c in ("subimage", "level", "tile_y", "tile_x", "width", "height")), ("data", pa.list_(pa.float32())), ("error", pa.string()),
])


def deep(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sample of each deep file; zback is z where the file has none, and a broken or flat file is a row with its error."""
    return decoded_deep(binary(spark, path))


def decoded_deep(files: DataFrame) -> DataFrame:
    """The deep samples of (path, content) rows."""
    own = {"z": 0.0, "zback": 0.0, "a": 1.0, "r": 0.0, "g": 0.0, "b": 0.0}

    def run(batches):
        for p, content in _files(batches):
            try:
                s = exr.read_deep(content)
            except BROKEN as e:
                columns = {"path": pa.array([p]), **{k: pa.nulls(1, pa.int32()) for k in ("y", "x", "s")}, **{c: pa.nulls(1, pa.float64()) for c in own}}
                yield pa.RecordBatch.from_pydict(columns | {"others": pa.nulls(1, _MAP), "error": pa.array([_said(e)])})
                continue
            n = len(s["y"])
            s["zback"] = s.pop("ZBack", s.get("z", np.zeros(n)))
            for begin in range(0, n, 65536):
                end = min(n, begin + 65536)
                columns = {"path": pa.array([p] * (end - begin)), **{k: pa.array(s[k][begin:end].astype(np.int32)) for k in ("y", "x", "s")}}
                for c, missing in own.items():
                    columns[c] = pa.array(s[c][begin:end].astype("f8") if c in s else np.full(end - begin, missing))
                columns["others"] = _maps({c: v[begin:end] for c, v in s.items() if c not in (*own, "y", "x", "s")}, end - begin)
                yield pa.RecordBatch.from_pydict(columns | {"error": pa.nulls(end - begin, pa.string())})

    return files.select("path", "content").mapInArrow(run, DEEP)


def encoded_deep(df: DataFrame, key: str = "path", compression: int = exr.ZIPS, tile: int = 0) -> DataFrame:
    """(key, content): the samples (y, x, s, z, a, r, g, b) of each key as the bytes of one deep file. An image is the unit of work."""

    def run(table: pa.Table) -> pa.Table:
        s = {c: table.column(c).to_numpy() for c in ("y", "x", "s", "z", "a", "r", "g", "b")}
        content = exr.write_deep(s, int(s["x"].max()) + 1, int(s["y"].max()) + 1, compression, tile)
        return pa.table({key: pa.array([table.column(key)[0].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    return df.select(key, "y", "x", "s", "z", "a", "r", "g", "b").groupBy(key).applyInArrow(run, f"{key} string, content binary")


def encoded(df: DataFrame, format: str, key: str = "path", channels: tuple[str, ...] = ("r", "g", "b"), bits: int | None = None, **how) -> DataFrame:
    """(key, content): the pixels (py, px) of each key as the bytes of one file. An image is the unit of work."""

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in ("py", "px"))
        out = {}
        for i, c in enumerate(channels):
            grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.float32)
            grid[y, x] = table.column(f"c{i}").to_numpy()
            out[c] = grid
        content = exr.write(Picture(out), **how) if format == "exr" else codecs.encode(Picture(out), format, bits)
        return pa.table({key: pa.array([table.column(key)[0].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    return df.select(key, "py", "px", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(channels)]).groupBy(key).applyInArrow(run, f"{key} string, content binary")


def _store(folder: str):
    """The file system and the path of a folder, which is made if need be."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    system.create_dir(base, recursive=True)
    return system, base


def _put(system, base: str, name: str, content: bytes, mark: str) -> None:
    """Write a file under another name and move it to its own, so that readers see whole files only."""
    place = f"{base}/{name}"
    if "/" in name:
        system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{place}.{mark}") as out:
        out.write(content)
    system.move(f"{place}.{mark}", place)


class _Written(WriterCommitMessage):
    pass


class _FilesWriter(DataSourceWriter):
    """Each task writes the files of its rows. Rows that are written again, after a loss, make the same files again."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        import uuid

        system, base = _store(self.folder)
        for name, content in iterator:
            _put(system, base, name, bytes(content), f"part-{uuid.uuid4().hex}")
        return _Written()


class FilesSink(DataSource):
    """df.write.format("imagefiles").mode("append").save(folder): rows (name, content) as files of a folder."""

    @classmethod
    def name(cls):
        return "imagefiles"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return _FilesWriter(self.options["path"])


def save(files: DataFrame, folder: str, key: str = "path", extension: str = "") -> None:
    """Write (key, content) rows as files of a folder, each by the task that has it."""
    spark = files.sparkSession
    spark.dataSource.register(FilesSink)
    rows = files.select(F.concat(F.col(key).cast("string"), F.lit(extension)).alias("name"), "content")
    rows.write.format("imagefiles").mode("append").save(folder)


def batch(spark: SparkSession, path: str, operation: str, output: str, **how) -> DataFrame:
    """(path, status, width, height, target, error) of an operation on every file of a glob.

    convert, flip_h, flip_v, resize (scale), blur (radius); each result is written to the folder `output` as
    soon as it is made, under the file's name and in its format or `format`. A broken file is a row that failed.
    """
    scale, radius, wanted = how.get("scale", 1.0), int(how.get("radius", 3)), how.get("format")

    def one(picture: Picture) -> Picture:
        every = lambda f: Picture({c: np.ascontiguousarray(f(v)) for c, v in picture.channels.items()}, picture.attributes)
        if operation == "convert":
            return picture
        if operation in ("flip_h", "flip_v"):
            return every(lambda v: np.flip(v, axis=1 if operation == "flip_h" else 0))
        if operation == "resize":
            h, w = max(1, int(picture.height * scale)), max(1, int(picture.width * scale))
            return every(lambda v: resized(v, w, h))
        if operation == "blur":
            return every(lambda v: box_blurred(v, radius))
        raise ValueError(f"unknown operation {operation}")

    def run(batches):
        import uuid

        system, base = _store(output)
        for p, content in _files(batches):
            stem, _, extension = p.rpartition("/")[2].rpartition(".")
            row = {"path": p, "status": "failed", "width": None, "height": None, "target": None, "error": None}
            try:
                kind = wanted or extension.lower()
                done = one(codecs.decode(content))
                kept = Picture({c: v for c, v in done.channels.items() if codecs.holds(kind, c)}, done.attributes)
                name = f"{stem or extension}.{kind}"
                _put(system, base, name, codecs.encode(kept, kind), f"part-{uuid.uuid4().hex}")
                row |= {"status": "ok", "width": done.width, "height": done.height, "target": name}
            except (*BROKEN, OSError) as e:
                row["error"] = _said(e)
            yield pa.RecordBatch.from_pylist([row], schema=_BATCH_ARROW)

    return binary(spark, path).select("path", "content").mapInArrow(run, "path string, status string, width int, height int, target string, error string")


_BATCH_ARROW = pa.schema([("path", pa.string()), ("status", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("target", pa.string()), ("error", pa.string())])


def resized(v: np.ndarray, width: int, height: int, kind: str = "lanczos3") -> np.ndarray:
    """One channel at another size: the taps of `sampling.filter_taps`, columns and then rows."""
    from ..operators.sampling import filter_taps

    def along(data: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, data.shape[1]))
        s, t, w = (np.array(x) for x in zip(*filter_taps(data.shape[0], size, kind), strict=True))
        np.add.at(out, t, data[s] * w[:, None])
        return out

    return along(along(v.T.astype(float), width).T, height).astype(np.float32)


def box_blurred(v: np.ndarray, radius: int) -> np.ndarray:
    """The mean of a square around each pixel, borders held."""
    size, data = 2 * radius + 1, v.astype(float)
    for axis in (0, 1):
        padded = np.pad(data, [(radius + 1, radius) if a == axis else (0, 0) for a in (0, 1)], "edge")
        sums = np.cumsum(padded, axis=axis)
        n = data.shape[axis]
        data = (np.take(sums, range(size, size + n), axis) - np.take(sums, range(n), axis)) / size
    return data.astype(np.float32)


class PatternReader(DataSourceReader):
    def __init__(self, options):
        self.width, self.height = int(options.get("width", 64)), int(options.get("height", 64))
        self.strips = int(options.get("partitions", 4))

    def partitions(self):
        step = -(-self.height // self.strips)
        return [InputPartition((y, min(y + step, self.height))) for y in range(0, self.height, step)]

    def read(self, partition):
        import pyarrow

        y0, y1 = partition.value
        ys, xs = np.mgrid[y0:y1, 0 : self.width]
        ramp = (ys * self.width + xs) / max(1, self.width * self.height - 1)
        yield pyarrow.RecordBatch.from_arrays(
            [pyarrow.array(ys.ravel().astype(np.int32)), pyarrow.array(xs.ravel().astype(np.int32)), pyarrow.array(ramp.ravel())], ["y", "x", "v"]
        )


class PatternSource(DataSource):
    """spark.read.format("ramp"): a grey ramp as pixels, made in parallel."""

    @classmethod
    def name(cls):
        return "ramp"

    def schema(self):
        return "y int, x int, v double"

    def reader(self, schema):
        return PatternReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PatternSource)
