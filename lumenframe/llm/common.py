"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words.
SPACES = r"[\x20\x09-\x0D]+"
#: Frequent short words of the corpus languages. Fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be by for from he in is it of on or that the this to was were with you "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec ce dans de des du elle en est et la le les ne par pas pour que qui sur un une "
    "al como con del el es la las lo los no o para por que se su un una y".split()
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, stored in the folder that the cluster names in spark.checkpoint.dir.

    A folder of our own is set only where the session has none and is a single process;
    executors on other machines wouldn't see it. What is stored goes with the
    session if spark.cleaner.referenceTracking.cleanCheckpoints is set, else it stays in that folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def digest(*parts: Column | str) -> Column:
    """MD5 of the parts written as text with bars between (null: empty); SQL engines can say the same."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *texts).cast("binary"))


def hashed_unit(*parts: Column | str) -> Column:
    """A number in (0, 1), the same for the same parts: the first 52 bits of their MD5, at the middle of their interval."""
    return (F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hashed_unit_sql(prefix: str, key: str = "doc_id") -> str:
    """`hashed_unit(prefix, key)` in SQL."""
    return f"(('0x' || substr(md5('{prefix}|' || coalesce({key}::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"


def crc32_of(column: str) -> Column:
    """CRC-32 of the column written as text (null: of the empty string), unsigned."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of few rows, so that what a worker makes of texts at one time stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
