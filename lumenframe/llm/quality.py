"""Quality classifier: regularised quadratic discriminant on document statistics.

Every whole text gives a vector of transformed statistics. Each class has a mean
and a covariance, shrunk towards the pooled one's diagonal; a score is the
logistic of the difference of the classes' log densities (squared Mahalanobis
distances by cached Cholesky factors, and log determinants) and the log prior
odds. Class moments are sums over all labelled rows, made on the executors; only
one row of sums for each class reaches the driver.

Defined cases: a null text counts as empty, and an empty text gets the score of its
statistics like any other; a document with several labels counts once for each;
null labels are left out. With fewer than two labelled rows of a class, all
scores are the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STOP_WORDS, crc32_of, cut_lineage, slices

SHRINKAGE, RIDGE, THRESHOLD = 0.2, 1e-3, 0.3
FOLDS = 5
_KINDS = np.zeros((256, 6), np.int64)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (
        _b < 128 and _c.isupper(),
        _b < 128 and _c.isdigit(),
        _c in ".,;:'\"?-()",
        _b < 128 and _c in string.punctuation and _c not in ".,;:'\"?-()",
        _c == "\n",
        _b >= 128 and (_b & 0xC0) != 0x80,
    )
NAMES = (
    "length", "upper", "digit", "stops", "symbols", "lines", "word_length", "word_spread",
    "distinct_words", "top_word", "stop_words", "distinct_lines", "odd_words", "short_lines",
)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KINDS
    size = len(data)
    share = lambda n, of: np.sqrt(n / of) if of else 0.0
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    stops = sum(c for w, c in counts.items() if w.lower() in STOP_WORDS)
    odd = sum(c for w, c in counts.items() if not w.replace("-", "").rstrip(".,;:?").isalnum())
    # For texts of n words, distinct words grow as a power of n: compare exponents, not shares.
    richness = np.log(len(counts)) / np.log(n) if n > 1 else 1.0
    short = sum(1 for x in lines if len(x) < 20)
    return [
        float(np.log1p(size)),
        share(kinds[0], size),
        share(kinds[1], size),
        share(kinds[2], size),
        share(kinds[3], size),
        float(np.log1p(kinds[4])),
        float(np.log1p(lengths.mean())) if n else 0.0,
        float(np.log1p(lengths.std())) if n else 0.0,
        float(richness),
        share(max(counts.values(), default=0), n),
        share(stops, n),
        share(len(set(lines)), len(lines)),
        share(odd, n),
        share(short, len(lines)),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, stats) of each row of `docs`."""

    def run(batches):
        for batch in slices(batches):
            stats = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(stats, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "stats"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = (crc32_of("doc_id") % FOLDS == 0).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, stats array<double>")


class Discriminant:
    """Two Gaussian classes, from their counts, sums and sums of products."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        counts = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
        self.prior = counts[1] / sum(counts.values()) if sum(counts.values()) else 0.5
        self.classes = None
        if min(counts.values()) < 2:
            return
        means = {c: moments[c][1] / counts[c] for c in (0, 1)}
        own = {c: moments[c][2] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)}
        pooled = sum(counts[c] * own[c] for c in (0, 1)) / sum(counts.values())
        target = np.diag(np.diag(pooled)) + RIDGE * np.eye(len(pooled))
        self.classes = []
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - shrinkage) * own[c] + shrinkage * target)
            self.classes.append((means[c], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        if self.classes is None or not len(stats):
            return np.full(len(stats), self.prior)
        logs = []
        for mean, whiten, half_log_det in self.classes:
            z = (stats - mean) @ whiten.T
            logs.append(-0.5 * (z * z).sum(axis=1) - half_log_det)
        odds = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def trained(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of the labelled rows of `stats` outside the held-out fold."""
    known = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    rows = stats.where("NOT held_out").join(known, "doc_id")
    d = len(NAMES)
    at = [F.get("stats", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(at)], *[F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in pairs]
    )
    moments = {}
    for row in sums.collect():  # two rows at most
        product = np.zeros((d, d))
        for i, j in pairs:
            product[i, j] = product[j, i] = row[f"p{i}_{j}"]
        moments[row["label"]] = (row["n"], np.array([row[f"s{i}"] for i in range(d)]), product)
    return Discriminant(moments)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`."""
    stats = cut_lineage(with_statistics(docs))
    model = trained(stats, labels)

    def run(batches):
        for batch in batches:
            column = batch.column("stats")
            scores = model.scores(column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that a discriminant trained on them predicts as class 1.

    Texts are read twice, once for the class moments and once for the scores, so
    that no row has to be found again by its id.
    """
    model = trained(with_statistics(docs), labels)

    def run(batches):
        for batch in slices(batches):
            stats = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.scores(stats) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op10_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels)
