"""Tiles as a stream: files that land in a folder are processed once each, in micro-batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expr import Op
from ..sources import files


def pixels_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of pixel rows as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def images_stream(spark: SparkSession, folder: str, pattern: str = "*", channels: tuple[str, ...] | None = None, files_per_batch: int = 16) -> DataFrame:
    """The pixels of image files as they arrive in a folder, decoded where they are read; a broken file is a row with its error."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.decoded(arriving, channels)


def processed(stream: DataFrame, ops: list[Op], keys: list[str]) -> DataFrame:
    """Per-pixel operations on a stream: the same projections as on a table."""
    for op in ops:
        stream = op.frame(stream, keys)
    return stream


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a later call goes on where this one ended."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_frames(events: DataFrame, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Statistics of event values in windows of time; late rows within the watermark still count."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("frame"), "event_type", "n", "lo", "hi", "total")
    )


def folded_tiles(spark: SparkSession, folder: str, schema, keys: list[str], checkpoint: str, target: str, files_per_batch: int = 16) -> StreamingQuery:
    """Per-key sums and ranges of a stream of pixels, added up batch by batch in the folder `target`.

    Each micro-batch writes the partial sums of its own keys under its number, so a batch that runs again
    replaces what it wrote, and nothing is held on the driver; `folded` adds the parts up.
    """
    v = F.col("v")

    def add(rows: DataFrame, batch: int) -> None:
        parts = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        parts.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream = pixels_stream(spark, folder, schema, files_per_batch)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def folded(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The sums and ranges of all batches so far."""
    return spark.read.parquet(target).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
