from pyspark.sql import functions as F

from lumenframe.functions import color
from lumenframe.streaming import tiles


def test_tiles_are_processed_once_each(spark, tmp_path):
    rows = spark.range(100).select(F.lit(0).cast("bigint").alias("image_id"), F.expr("CAST(id div 10 AS INT)").alias("y"), F.expr("CAST(id % 10 AS INT)").alias("x"),
                                   *[(F.col("id") / 100).alias(c) for c in "rgba"])
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows.repartition(3).write.parquet(landing)
    op = color.transfer("srgb", "decode")
    run = lambda: tiles.run_available(tiles.processed(tiles.pixels_stream(spark, landing, rows.schema, 1), [op], ["image_id", "y", "x"]), out, mark)
    run()
    assert spark.read.parquet(out).count() == 100
    run()
    assert spark.read.parquet(out).count() == 100
    rows.limit(10).withColumn("image_id", F.lit(1).cast("bigint")).write.mode("append").parquet(landing)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 110
    want = op.frame(rows, ["image_id", "y", "x"])
    assert got.where("image_id = 0").exceptAll(want).count() == 0


def test_folded_tiles(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 2).alias("image_id"), F.col("id").cast("double").alias("v"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    sums = lambda: {r.image_id: (r.n, r.total, r.lo, r.hi) for r in tiles.folded(spark, str(tmp_path / "sums"), ["image_id"]).collect()}
    for _ in range(2):
        tiles.folded_tiles(spark, str(tmp_path / "in"), rows.schema, ["image_id"], str(tmp_path / "mark"), str(tmp_path / "sums"), 1)
        assert sums() == {0: (25, 600.0, 0.0, 48.0), 1: (25, 625.0, 1.0, 49.0)}
    rows.limit(3).write.mode("append").parquet(str(tmp_path / "in"))
    tiles.folded_tiles(spark, str(tmp_path / "in"), rows.schema, ["image_id"], str(tmp_path / "mark"), str(tmp_path / "sums"), 1)
    assert sum(n for n, *_ in sums().values()) == 53


def test_images_stream(spark, tmp_path):
    """Files that land later are decoded by the next run, and none twice."""
    import numpy as np

    from lumenframe.sources import codecs
    from lumenframe.sources.picture import Picture

    landing, out, mark = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "mark")
    landing.mkdir()
    picture = Picture({c: np.full((3, 4), 0.25, np.float32) for c in "rgb"})
    run = lambda: tiles.run_available(tiles.images_stream(spark, str(landing), channels=("r",), files_per_batch=1), out, mark)
    (landing / "a.exr").write_bytes(codecs.encode(picture, "exr"))
    (landing / "b.png").write_bytes(b"broken")
    run()
    (landing / "c.pfm").write_bytes(codecs.encode(picture, "pfm"))
    run()
    rows = spark.read.parquet(out).groupBy("path").agg(F.count("px").alias("n"), F.count("error").alias("e"), F.max("r").alias("r")).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.n, r.e, r.r) for r in rows} == {"a.exr": (12, 0, 0.25), "b.png": (0, 1, None), "c.pfm": (12, 0, 0.25)}


def test_event_frames(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    frames = tiles.event_frames(events)
    assert frames.agg(F.sum("n")).first()[0] == events.count()
