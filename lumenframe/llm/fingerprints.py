"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the `k` smallest distinct 64-bit hashes of a
text's shingles. Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and the number of distinct shingles.
Everything here is DataFrame expressions.

Defined cases: a null text counts as empty; an empty text has an empty sketch;
a text of fewer words than a shingle has one shingle, its whole word sequence;
repeated shingles count once. Two empty sketches resemble each other fully
(1.0), an empty and a non-empty one not at all (0.0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES

WORDS, SIZE = 5, 128
#: Rows of a chunk of neighbouring documents, about; chunks at most; and sampled places for each chunk's bound.
CHUNK_ROWS, MOST_CHUNKS, EACH = 512, 1 << 16, 16
#: Chunks of a partition, on average (and partitions of a small table), and partitions at most.
PARTITION_CHUNKS, MOST_PARTITIONS = 8, 1 << 15


def word_hashes(text: Column) -> Column:
    """The hash of each word of `text`, in order."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: Column, out: str, k: int = SIZE, words: int = WORDS) -> DataFrame:
    """`df` with the sketch of `text` in column `out`.

    The word hashes stand in a column of their own first, so that the
    shingle expression reads them and doesn't split the text again.
    """
    held = f"__words_{out}"
    at = F.col(held)
    shingles = F.transform(
        F.slice(at, F.lit(1), F.greatest(F.size(at) - F.lit(words - 1), F.lit(1))),
        lambda h, i: F.xxhash64(h, *(F.get(at, i + F.lit(j)) for j in range(1, words))),
    )
    whole = F.when(F.size(at) == 0, F.array().cast("array<bigint>")).otherwise(shingles)
    return (
        df.withColumn(held, word_hashes(text))
        .withColumn(out, F.slice(F.sort_array(F.array_distinct(whole)), 1, k))
        .drop(held)
    )


def merged(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of what `a` and `b` sketch together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of common shingles among all shingles of both."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact while the sketch isn't full."""
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the shingles of `a` that `b` has too (an empty `a`: 1.0)."""
    share = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def with_comparison(df: DataFrame, a: str, b: str, near: str, share: str | None = None, k: int = SIZE) -> DataFrame:
    """`df` with the resemblance of the sketches `a` and `b` in column `near` and, if asked, the containment of `a` in `b` in `share`.

    The same as `resemblance` and `containment`, but the sketch of both stands in a column of its own, so
    it is made once and the generated code stays small enough to be compiled.
    """
    held = df.withColumn("__both", merged(F.col(a), F.col(b), k))
    size, common = F.size("__both"), F.size(F.array_intersect(F.col("__both"), F.array_intersect(a, b)))
    out = held.withColumn(near, F.when(size == 0, F.lit(1.0)).otherwise(common / size))
    if share:
        part = F.col(near) * distinct_shingles(F.col("__both"), k) / distinct_shingles(F.col(a), k)
        out = out.withColumn(share, F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), part)))
    return out.drop("__both")


def merge_parts(df: DataFrame, keys: list[str], sketch: str, k: int = SIZE) -> DataFrame:
    """One merged sketch for each group of `keys`, however many rows a group has.

    Each task keeps the `k` least distinct hashes of a group before the shuffle
    (a limited rank), so a group never gathers more than `k` hashes from a task.
    A null sketch counts as empty; a group of empty sketches only has an empty one.
    """
    # An empty sketch stands as a null hash, ranked behind all others and left out of the list.
    hashes = df.select(*keys, F.explode_outer(sketch).alias("__h")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col("__h").asc_nulls_last())
    least = hashes.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def _place(text: Column) -> Column:
    """Where a row stands among all: by id (null first), then by a hash of the text, then anywhere.

    Written as text that sorts so. Rows with equal ids and texts are interchangeable, so
    their last part only deals them out: however many there are, chunks can cut them.
    """
    hexed = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")
    at = F.col("doc_id").cast("bigint")
    spread = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")
    return F.concat(F.when(at.isNull(), "0").otherwise(F.concat(F.lit("1"), hexed(at))), hexed(F.xxhash64(F.coalesce(text, F.lit("")))), spread)


def _bounds(docs: DataFrame, chunks: int, n: int) -> list[str]:
    """Where all but the first of about `chunks` chunks of equally many rows begin, from a sample of EACH places a chunk."""
    share = min(1.0, EACH * chunks / max(1, n))
    some = docs.select(_place(F.col("text")).alias("p")).sample(share, seed=1).toPandas()["p"].sort_values().tolist()
    return [some[len(some) * i // chunks] for i in range(1, chunks) if some]


def in_chunks(docs: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, place, doc_id, text), the chunks in the order of their places, each in one partition.

    Chunks hold about equally many rows however ids are spread. Their bounds come from a sample
    that MOST_CHUNKS bounds; beyond that many chunks of `rows` rows chunks grow, and
    the windows over them spill to disk. Partitions grow in number with the table, not in size, up to MOST_PARTITIONS.
    """
    n = docs.count()
    partitions = max(1, min(MOST_PARTITIONS, max(n // (rows * PARTITION_CHUNKS), min(PARTITION_CHUNKS, n // rows))))
    chunks = max(1, min(MOST_CHUNKS, n // rows))
    bounds = sorted(set(_bounds(docs, chunks, n))) if chunks > 1 else []
    wide = max(1, math.isqrt(len(bounds)))
    # Two short searches, among every `wide`-th bound and between two of those. A constant of MOST_CHUNKS places at most.
    listed = lambda found: F.split(F.lit(" ".join(found)), " ") if found else F.array().cast("array<string>")
    below = lambda found: F.size(F.filter(found, lambda b: b <= F.col("place")))
    first = F.col("__first")
    chunk = F.when(first == 0, 0).otherwise((first - 1) * wide + below(F.slice(listed(bounds), (first - 1) * wide + 1, F.lit(wide))))
    placed = docs.select(_place(F.col("text")).alias("place"), "doc_id", "text").withColumn("__first", below(listed(bounds[::wide])))
    # Never null, so that no filter is inferred on it and both readers share one shuffle.
    return placed.select(F.coalesce(chunk.cast("bigint"), F.lit(0)).alias("chunk"), "place", "doc_id", "text").repartition(partitions, "chunk")


def fingerprinted(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """Each document's sketch beside the sketch of its edited text and the next document's.

    The edited text is the document with its last half (in code points, rounded
    down) replaced by the first as many code points, or all, of the next
    document in the order of (doc_id, hash of the text); the last document's next is the
    first. Rows with equal ids and texts are interchangeable.

    One shuffle carries the texts: neighbours meet in chunks of the order,
    and only the first document of each chunk goes to the chunk before it.
    """
    held = in_chunks(docs)
    # Both readers of `held` need the same columns, so they share one shuffle.
    order = Window.partitionBy("chunk").orderBy("place", "doc_id")
    firsts = held.withColumn("r", F.row_number().over(order)).where("r = 1").select("chunk", F.col("text").alias("next_text"))
    # A row for each chunk, of two numbers: bounded by MOST_CHUNKS.
    ids = firsts.select("chunk")
    around = Window.orderBy("chunk")
    before = ids.select(
        F.col("chunk").alias("at"),
        F.coalesce(
            F.lag("chunk").over(around), F.max("chunk").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ).alias("chunk"),
    )
    across = firsts.join(before, firsts["chunk"] == before["at"]).select(before["chunk"], "next_text")
    across = with_sketch(across, F.col("next_text"), "next_sketch", k)
    inside = with_sketch(held, F.col("text"), "sketch", k).select(
        "*",
        F.lead(F.lit(False), 1, True).over(order).alias("last"),
        F.lead("text").over(order).alias("then_text"),
        F.lead("sketch").over(order).alias("then_sketch"),
    )
    last = F.col("last")
    paired = inside.join(across, "chunk", "left").select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        "sketch",
        F.coalesce(F.when(last, F.col("next_text")).otherwise(F.col("then_text")), F.lit("")).alias("next_text"),
        F.when(last, F.col("next_sketch")).otherwise(F.col("then_sketch")).alias("next_sketch"),
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    paired = paired.select("doc_id", "text", "sketch", "next_sketch", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    return with_sketch(paired, F.col("edited"), "edited_sketch", k)


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch.cast("array<string>"), " ")


def op1_query(docs: DataFrame) -> DataFrame:
    out = fingerprinted(docs.select("doc_id", "text"))
    out = with_comparison(with_comparison(out, "edited_sketch", "sketch", "near_edited", "edited_containment"), "sketch", "next_sketch", "near_next")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        "edited_containment",
    )
