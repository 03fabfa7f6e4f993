"""Mixing sources to target weights by Poisson replication.

A source of size n (documents) that should make up a share w of the mixture gets
the mean repetition rate ``w * rows / n``. Each document draws its number of
copies from the Poisson distribution with that mean, by inverting it at a number
hashed from (seed, doc_id): the same document gets the same copies wherever and
whenever it is processed. Copies are then shuffled globally by a hash of (seed,
doc_id, copy).

A mean above MOST_MEAN is drawn as the sum of equal independent parts, which is
the same distribution and keeps the inversion exact.

Defined cases: a null source is a source of its own; a null id draws as the empty
string; repeated rows get equal numbers of copies; a source without a target
weight gets none; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, digest, hashed_unit

#: Means above this are split in equal parts; then the first term exp(-mean) is far from underflow.
MOST_MEAN = 32.0
#: Terms of the inverted distribution; at MOST_MEAN the chance beyond them is under 1e-60.
TERMS = 180
#: A source of over one in HEAVY documents is joined by a broadcast; fewer than HEAVY sources can be.
HEAVY = 1024


def with_rates(sizes: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """(source, n, rate): `sizes` (source, n) with the mean repetition rate of each source.

    Without given weights, a source's target share is its size to `power`, so a
    power under 1 evens the sources out.
    """
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = sizes.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "source string, weight double")
        weighted = sizes.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total, rows = weighted.agg(F.sum("weight"), F.sum("n")).first()
    if not total:
        return weighted.select("source", "n", F.lit(0.0).alias("rate"))
    return weighted.select("source", "n", (F.col("weight") / F.lit(float(total)) * F.lit(rows) / F.col("n")).alias("rate"))


def inverted(mean: Column) -> Column:
    """The cumulative Poisson probabilities P(N <= 0), P(N <= 1), ... for a mean up to MOST_MEAN."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["c"]


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = 7) -> DataFrame:
    """The columns of `docs` in struct `row`, with rate, copies, copy (from 0) and shuffle_key, in shuffled order."""
    sizes = cut_lineage(docs.groupBy("source").agg(F.count("*").alias("n")))
    rates = with_rates(sizes, weights, power)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MOST_MEAN))).cast("int")
    plan = rates.select(F.col("source").alias("__s"), "n", F.col("rate").alias("__rate"), parts.alias("__parts")).withColumn(
        "__cdf", inverted(F.col("__rate") / F.col("__parts"))
    )
    # Large sources, of which there are few, come to their documents; those of the many small sources meet in a shuffle.
    heavy, light = F.broadcast(plan.where(F.col("n") * HEAVY > total)), plan.where(F.col("n") * HEAVY <= total)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    on = F.col("row.source").eqNullSafe(F.col("__s"))
    joined = packed.join(heavy, on)
    if light.limit(1).count():
        joined = joined.unionByName(packed.join(heavy, on, "left_anti").join(light, on))

    def one(part: Column) -> Column:
        u = hashed_unit(str(seed), F.col("row.doc_id"), part)
        return F.size(F.filter(F.col("__cdf"), lambda c: c < u))

    many = F.aggregate(F.sequence(F.lit(0), F.col("__parts") - 1), F.lit(0), lambda a, part: a + one(part))
    copied = (
        joined.withColumn("copies", F.when(F.col("__rate") > 0, many).otherwise(0))
        .where("copies > 0")
        .select("row", F.col("__rate").alias("rate"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
        .withColumn("shuffle_key", digest(str(seed), F.col("row.doc_id"), "at", F.col("copy")))
    )
    return copied.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op7_query(docs: DataFrame) -> DataFrame:
    out = mixed(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return out.select("row.*", F.round("rate", 9).alias("rate"), "copies", "copy", "shuffle_key")


#: The same in SQL. u is drawn as in hashed_unit, the distribution summed term by term in logarithms.
OP7_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(sqrt(n::DOUBLE)) AS weights, sum(n) AS all_rows FROM sizes),
rates AS (SELECT source, sqrt(n::DOUBLE) / weights * all_rows / n AS rate FROM sizes, total),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 32.0))::INT AS parts FROM rates),
terms AS (SELECT source, k, exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1.0)) AS p FROM parts, range(0, 181) AS r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (SELECT d.doc_id, d.source, rate, j,
    (('0x' || substr(md5('7|' || coalesce(d.doc_id::VARCHAR, '') || '|' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d
  JOIN parts ON d.source IS NOT DISTINCT FROM parts.source, range(0, parts.parts) AS r(j)),
counts AS (SELECT doc_id, draws.source, any_value(rate) AS rate, sum(CASE WHEN c < u THEN 1 ELSE 0 END)::INT AS copies
  FROM draws JOIN cdf ON draws.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id, draws.source)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(rate, 9) AS rate, copies, copy::INT AS copy,
  md5('7|' || coalesce(d.doc_id::VARCHAR, '') || '|at|' || copy) AS shuffle_key
FROM documents d JOIN counts ON d.doc_id IS NOT DISTINCT FROM counts.doc_id AND d.source IS NOT DISTINCT FROM counts.source,
  range(0, copies) AS r(copy)
"""
