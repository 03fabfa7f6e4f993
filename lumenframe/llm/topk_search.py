"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds those whose norms differ by a few per
cent at most, and a crowded bucket is split by a hash into parts of bounded
size. A query keeps a lower bound `t` of its k-th best score, from scores it has
really seen; in a bucket of greatest norm `l` a better vector needs a
cosine of at least ``c = t / (|q| l)``:

* c > 1: the whole bucket is skipped;
* c >= COORDINATE_FROM: coordinate pruning. In a query's largest
  coordinates a unit vector of cosine c or more lies in
  ``c q_i +- sqrt((1 - c^2)(1 - q_i^2))``; sorted columns give the vectors of the
  narrowest range, the other coordinates thin them out;
* else length pruning: vectors sorted by norm, those of norm at least ``t / |q|``.

What is left is verified with whole products, in float32 or float64 where these
represent all partial sums of the integers exactly. Where lengths are too large for that, float64
only sorts out what is surely not among the k best, and the rest is multiplied in whole numbers of any size.

Queries come in groups and meet the bucket parts they can't skip; each such tile
returns the k best it holds for each query, above the bound. Bounds come from a few vectors first and then
from searches of growing shares of the table, so tiles return few vectors that aren't among the best.

Defined cases: null vectors and vectors with null or non-finite components take
no part; a shorter vector counts as padded with zeros; every row with a query's id asks for itself, and
every other row, of the same id too, is a candidate; with fewer than k others all
are returned; ties go to the smaller id; a score beyond the range of a long is held at its
end, and ties there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

K, SCALE, EVERY = 20, 64, 20
#: Norms of a bucket differ by this factor at most.
NORM_STEP = 1.05
#: Rows of a bucket part at least; parts above which they grow with the table; bytes of a part's vectors at most; rows of a query group.
PART_ROWS, PARTS, PART_BYTES, QUERY_ROWS = 1024, 256, 1 << 25, 65_536
#: Vectors that seed the lower bounds, and how much larger the share is that is searched next.
SEEDS, STEP = 1024, 8
COORDINATE_FROM, FOCUS = 0.8, 4
SLACK = 1e-6
#: What rounding changes at most, relative to the product of two lengths; and the least and greatest long. Fixed values.
ROUNDED, LEAST, GREATEST = 1e-12, -(1 << 63), (1 << 63) - 1


def integers(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, v, norm): floor(SCALE * x) of every usable vector, as whole doubles, its length, and a number of its own."""

    def run(batches):
        for batch in batches:
            ids, vectors = batch.column("vec_id"), batch.column("embedding")
            fine = np.zeros(len(ids), bool)
            if len(ids):
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE
                usable = np.isfinite(x) & ~np.asarray(vectors.flatten().is_null())
                owners = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0)))
                fine = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid()) & (np.bincount(owners[~usable], minlength=len(ids)) == 0)
            kept = batch.filter(pa.array(fine))
            sizes = np.asarray(pa.compute.list_value_length(kept.column("embedding")), np.int64)
            whole = np.floor(kept.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            ends = np.cumsum(sizes)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(whole))
            width = int(sizes.max(initial=0))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id").cast(pa.int64()), rows, pa.array(lengths_of(_matrix(rows, width)))], ["vec_id", "v", "norm"])

    told = embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, v array<double>, norm double")
    return told.select(F.monotonically_increasing_id().alias("row"), "*")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as float64, padded with zeros to `width`."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.asarray(pa.compute.list_value_length(column))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greatest score, then least id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= edge)[0]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """The lengths of the rows, of components of any size."""
    most = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1.0)
    return np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1)) * most


class Part:
    """A part of a bucket, ready for searches."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        norms = lengths_of(vectors)
        order = np.argsort(-norms, kind="stable")
        self.rows, self.ids, self.vectors, self.norms = rows[order], ids[order], vectors[order], norms[order]
        self.longest = float(self.norms[0]) if len(ids) else 0.0
        self.units = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self._columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._single: np.ndarray | None = None

    def column(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self._columns:
            order = np.argsort(self.units[:, i], kind="stable")
            self._columns[i] = order, self.units[order, i]
        return self._columns[i]

    def by_coordinates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Places of all vectors that may have `cosine` with `unit`, by its largest coordinates."""
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        reach = math.sqrt(max(0.0, 1 - cosine * cosine))
        bounds, least = [], None
        for i in focus.tolist():
            # The coordinate is the cosine of an angle within acos(cosine) of acos(q).
            q = float(unit[i])
            half = reach * math.sqrt(max(0.0, 1 - q * q)) + SLACK
            low, high = cosine * q - half, cosine * q + half
            if cosine < abs(q):  # that angle reaches 0 or pi
                low, high = (low, 1.0 + SLACK) if q > 0 else (-1.0 - SLACK, high)
            bounds.append((i, low, high))
            order, values = self.column(i)
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if least is None or b - a < len(least):
                least = order[a:b]
        for i, low, high in bounds:
            x = self.units[least, i]
            least = least[(x >= low) & (x <= high)]
        return least

    def products(self, queries: np.ndarray, places: np.ndarray | slice, longest_query: float) -> np.ndarray:
        if self.longest * longest_query < 1 << 24:
            if self._single is None:
                self._single = self.vectors.astype(np.float32)
            return (queries.astype(np.float32) @ self._single[places].T).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            return queries @ self.vectors[places].T

    def search(self, rows: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
        """(query place, ids, scores): the k best of this part for each query, no worse than its bound."""
        norms = lengths_of(queries)
        reach = norms * self.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosines = np.where((bounds > 0) & (reach > 0), bounds / reach, -1.0)
        exact = reach < 1 << 53
        scanned: tuple[list[int], list[int]] = ([], [])
        for i in np.nonzero(cosines <= 1 + SLACK)[0].tolist():
            if cosines[i] < COORDINATE_FROM:
                scanned[int(exact[i])].append(i)
                continue
            at = self.by_coordinates(queries[i] / norms[i], float(cosines[i]) - SLACK)
            if len(at):
                yield self._kept(i, rows[i], queries[i], at, self.products(queries[i : i + 1], at, float(norms[i]))[0], bounds[i], k, exact[i])
        for group in scanned:
            for begin in range(0, len(group), 128):
                some = np.array(group[begin : begin + 128])
                need = np.where((bounds[some] > 0) & (norms[some] > 0), bounds[some] / np.maximum(norms[some], 1e-300), 0.0).min()
                far = int(np.searchsorted(-self.norms, -(need * (1 - SLACK) - SLACK), "right")) if need > 0 else len(self.rows)
                scores = self.products(queries[some], slice(0, far), float(norms[some].max()))
                for row, i in enumerate(some.tolist()):
                    yield self._kept(i, rows[i], queries[i], np.arange(far), scores[row], bounds[i], k, exact[i])

    def _kept(self, i, own, query, at, scores, bound, k, exact):
        if exact:
            fine = (scores >= bound) & (self.rows[at] != own)
            at, scores = at[fine], scores[fine]
            best = best_of(scores, self.ids[at], k)
            return i, self.ids[at][best], scores[best].astype(np.int64)
        # Rounded scores may be off by this much, and further if they passed the range of doubles.
        size = float(lengths_of(query[None])[0])
        off = ROUNDED * self.longest * size
        fine = (self.rows[at] != own) & ~(scores < bound - off)
        at, scores = at[fine], scores[fine]
        if len(at) > k and np.isfinite(scores).all():
            edge = np.partition(scores, len(scores) - k)[len(scores) - k] - 2 * off
            # Scores held at an end tie, and the smaller id is better.
            at = at[(scores >= edge) | (scores >= GREATEST - off) | (edge <= LEAST)]
        asked = [int(x) for x in query]
        whole = [min(max(sum(a * int(b) for a, b in zip(asked, self.vectors[j], strict=True)), LEAST), GREATEST) for j in at.tolist()]
        best = sorted(range(len(at)), key=lambda j: (-whole[j], self.ids[at[j]]))[:k]
        return i, self.ids[at][best], np.array([whole[j] for j in best], np.int64)


class _Search:
    """Tiles of bucket parts and query groups. `table`: the rows and the greatest norm of each bucket."""

    def __init__(self, table: list, width: int, total: int, every: int, k: int):
        self.table, self.width, self.k = sorted(table, key=lambda r: -r["longest"]), width, k
        self.size = max(1, min(max(PART_ROWS, total // PARTS), PART_BYTES // (8 * max(1, width))))
        self.groups = max(1, -(-(total // every + 1) // QUERY_ROWS))

    def found(self, binned: DataFrame, asking: DataFrame, rate: float = 1.0) -> DataFrame:
        """(row, vec_id, score): the k best of each tile for each of the queries (row, v, bound), no worse than its bound.

        With a `rate` below 1 that share of the vectors is searched, chosen by a hash.
        """
        width, k = self.width, self.k
        if rate < 1:
            binned = binned.where(F.pmod(F.xxhash64(F.lit("sample"), "row"), F.lit(1 << 30)) < int(rate * (1 << 30)))
        # (bucket, its first part, its parts, its greatest norm), the longest first.
        spans, parts = [], 0
        for r in self.table:
            count = max(1, math.ceil(r["n"] * rate / self.size))
            spans.append((r["bucket"], parts, count, r["longest"]))
            parts += count
        lengths, starts = np.array([s[3] for s in spans]), np.array([s[1] for s in spans] + [parts])
        # As many rows as norms have magnitudes: bounded by the range of doubles.
        spans_df = binned.sparkSession.createDataFrame([s[:3] for s in spans], "bucket int, first int, count int")
        data = binned.join(F.broadcast(spans_df), "bucket").select(
            (F.col("first") + F.pmod(F.xxhash64("row"), F.col("count"))).cast("int").alias("part"), "row", "vec_id", "v"
        )

        def reach(batches):
            for batch in batches:
                least = batch.column("bound").to_numpy()
                norms = lengths_of(_matrix(batch.column("v"), width))
                # Buckets, and so parts, stand in the order of their greatest norms: those a query can't skip come first.
                last = [np.searchsorted(-n * lengths, -(b * (1 - SLACK) - SLACK), "right") if b > 0 else len(lengths) for n, b in zip(norms, least, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts[np.array(last, np.int64)], pa.int32())], ["row", "v", "bound", "parts"])

        group = F.pmod(F.xxhash64("row"), F.lit(self.groups)).cast("int").alias("group")
        reached = asking.select("row", "v", "bound").mapInArrow(reach, "row bigint, v array<double>, bound double, parts int").where("parts > 0")
        query_tiles = reached.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), group, "row", "v", "bound")
        # A part goes to the groups with a query that asks for it.
        asked = reached.groupBy(group).agg(F.max("parts").alias("parts"))
        tiles = cut_lineage(asked.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
        data_tiles = data.join(tiles, "part").select("part", "group", "row", "vec_id", "v")

        def tile(key, left, right):
            ids, scores, owners = [], [], []
            if len(left) and len(right):
                held = Part(left.column("row").to_numpy(), left.column("vec_id").to_numpy(), _matrix(left.column("v").combine_chunks(), width))
                numbers = right.column("row").to_numpy()
                queries, bounds = _matrix(right.column("v").combine_chunks(), width), right.column("bound").to_numpy()
                for i, found, best in held.search(numbers, queries, bounds, k):
                    ids.append(found)
                    scores.append(best)
                    owners.append(np.full(len(found), numbers[i]))
            join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            return pa.table({"row": join(owners), "vec_id": join(ids), "score": join(scores)})

        return (
            data_tiles.groupBy("part", "group")
            .cogroup(query_tiles.groupBy("part", "group"))
            .applyInArrow(tile, "row bigint, vec_id bigint, score bigint")
        )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lowered(score):
    """A bound that no rounding puts above the score."""
    return score * F.when(score > 0, 1 - ROUNDED).otherwise(1 + ROUNDED)


def searched(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`, against all rows.

    The first bounds come from SEEDS vectors; searches of shares of the table that grow by STEP raise them, so
    a query gets some k x STEP vectors back from each search, however large the table.
    """
    rows = cut_lineage(integers(embeddings))
    bucket = F.when(F.col("norm") >= 1, F.floor(F.log("norm") / math.log(NORM_STEP))).otherwise(-1).cast("int")
    binned = rows.withColumn("bucket", bucket)
    table = binned.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.max(F.size("v")).alias("width")).collect()
    width = max((r["width"] for r in table), default=0)
    total = sum(r["n"] for r in table)
    search = _Search(table, width, total, every, k)
    asking = rows.where(F.col("vec_id") % every == 0)
    seeds = rows.orderBy(F.xxhash64(F.lit("seed"), "vec_id"), "vec_id").limit(SEEDS).select("row", "vec_id", "v").toArrow()
    seed_rows, seed_ids = seeds.column("row").to_numpy(), seeds.column("vec_id").to_numpy()
    seed_part = Part(seed_rows, seed_ids, _matrix(seeds.column("v").combine_chunks(), width) if len(seed_ids) else np.zeros((0, width)))

    def bound(batches):
        for batch in batches:
            queries, numbers = _matrix(batch.column("v"), width), batch.column("row").to_numpy()
            least = np.full(len(numbers), -np.inf)
            for i, _, scores in seed_part.search(numbers, queries, np.full(len(numbers), -np.inf), k):
                if len(scores) == k:
                    least[i] = float(scores[-1]) * (1 - ROUNDED if scores[-1] > 0 else 1 + ROUNDED)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], ["row", "v", "bound"])

    bounded = asking.select("row", "v").mapInArrow(bound, "row bigint, v array<double>, bound double")
    rate = SEEDS * STEP / max(1, total)
    while rate * 2 < 1:
        bounded = cut_lineage(bounded)
        kth = _ranked(search.found(binned, bounded, rate), k).where(F.col("rank") == k).select("row", _lowered(F.col("score").cast("double")).alias("raised"))
        bounded = bounded.join(kth, "row", "left").select("row", "v", F.greatest("bound", F.coalesce("raised", "bound")).alias("bound"))
        rate *= STEP
    best = _ranked(search.found(binned, cut_lineage(bounded), 1.0), k)
    names = asking.select("row", F.col("vec_id").alias("query_id"))
    return best.join(names, "row").select("query_id", "rank", "vec_id", "score")


def op6_query(embeddings: DataFrame) -> DataFrame:
    return searched(embeddings)


#: The same in SQL: all products, ranked.
OP6_SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
parts AS (SELECT r, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM numbered),
fine AS (SELECT r FROM parts GROUP BY r HAVING bool_and(x IS NOT NULL AND isfinite(x))),
ints AS (SELECT r, p.vec_id, i, floor({SCALE} * x) AS v FROM parts p JOIN fine USING (r)),
scores AS (SELECT q.r, q.vec_id AS query_id, c.r AS c, c.vec_id, sum(q.v * c.v)::BIGINT AS score FROM ints q JOIN ints c ON q.i = c.i AND q.r <> c.r
  WHERE q.vec_id % {EVERY} = 0 GROUP BY ALL),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
