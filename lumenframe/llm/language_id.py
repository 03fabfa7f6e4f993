"""Language identification by a convolutional network over bytes.

A window is LENGTH bytes of the lower-cased UTF-8 text. Bytes are embedded, filters of
several widths run over them, each filter's largest response in the window goes
through a rectifier to a softmax over the languages. The network is trained in
numpy on windows of labelled texts; a text's prediction averages the
probabilities of all its windows, weighted by their bytes.

Training takes a bounded sample: about PER_LANGUAGE texts of each language
(TRAIN_TEXTS at most in all), chosen by a hash of the id, and WINDOWS_EACH evenly
spaced windows of each. Prediction reads every byte of every text.

Defined cases: null texts and texts without a letter are `und` with score 0; rows
without a language aren't learnt from; with no labelled row at all everything is
`und`; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, slices

LENGTH, WIDTHS, FILTERS, EMBEDDING = 128, (2, 3, 4), 8, 8
PER_LANGUAGE, TRAIN_TEXTS, WINDOWS_EACH = 600, 20_000, 6
EPOCHS, BATCH, RATE = 12, 64, 4e-3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def windows(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of `texts` one after another: bytes (zero-padded), owners, and how many bytes each has."""
    counts = np.array([-(-len(t) // length) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t.ljust(c * length, b"\0") for t, c in zip(texts, counts.tolist(), strict=True)), np.uint8)
    sizes = np.full(int(counts.sum()), length, np.int64)
    ends = np.cumsum(counts)
    some = counts > 0
    sizes[ends[some] - 1] = np.array([len(t) for t in texts], np.int64)[some] - (counts[some] - 1) * length
    return data.reshape(-1, length), np.repeat(np.arange(len(texts)), counts), sizes


class Network:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        scale = lambda fan, *shape: (rng.standard_normal(shape) * np.sqrt(2 / fan)).astype(np.float32)
        self.widest = max(WIDTHS)
        self.p = {
            "embed": scale(2, 256, EMBEDDING),
            "filters": scale(self.widest * EMBEDDING, self.widest * EMBEDDING, FILTERS * len(WIDTHS)),
            "bias": np.zeros(FILTERS * len(WIDTHS), np.float32),
            "out": scale(FILTERS * len(WIDTHS), FILTERS * len(WIDTHS), classes),
            "out_bias": np.zeros(classes, np.float32),
        }
        self.p["embed"][0] = 0
        #: A filter of a lesser width sees the first places of the widest one.
        self.live = np.zeros((self.widest, EMBEDDING, len(WIDTHS), FILTERS), np.float32)
        for i, w in enumerate(WIDTHS):
            self.live[:w, :, i] = 1
        self.live = self.live.reshape(self.widest * EMBEDDING, -1)
        self.p["filters"] *= self.live

    def patches(self, rows: np.ndarray) -> np.ndarray:
        """(windows, places, widest x EMBEDDING): what the filters see at each place."""
        embedded = self.p["embed"][rows]
        n, length, e = embedded.shape
        s = embedded.strides
        return np.lib.stride_tricks.as_strided(embedded, (n, length - self.widest + 1, self.widest * e), (s[0], s[1], s[2]), writeable=False)

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the filters see, and how each responds at each place."""
        seen = self.patches(rows)
        n, places, k = seen.shape
        return seen, (seen.reshape(n * places, k) @ self.p["filters"]).reshape(n, places, -1)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        return self.responses(rows)[1].max(axis=1) + self.p["bias"]

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, rows: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.empty((len(rows), len(self.p["out_bias"])), np.float32)
        for i in range(0, len(rows), block):
            top = np.maximum(self.pooled(rows[i : i + block]), 0)
            out[i : i + block] = self.softmax(top @ self.p["out"] + self.p["out_bias"])
        return out

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        seen, responses = self.responses(rows)
        n = len(rows)
        at = responses.argmax(axis=1)
        raw = np.take_along_axis(responses, at[:, None], axis=1)[:, 0] + self.p["bias"]
        top = np.maximum(raw, 0)
        d = self.softmax(top @ self.p["out"] + self.p["out_bias"])
        d[np.arange(n), labels] -= 1
        d /= n
        d_top = (d @ self.p["out"].T) * (raw > 0)
        won = seen[np.arange(n)[:, None], at]  # (n, filters, widest x EMBEDDING)
        back = (d_top[:, :, None] * self.p["filters"].T[None]).reshape(n, -1, self.widest, EMBEDDING)
        # The bytes that each winning place saw, and in which dimension: summed up as one histogram.
        bytes_seen = rows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(self.widest)].astype(np.int64)
        cells = bytes_seen[..., None] * EMBEDDING + np.arange(EMBEDDING)
        d_embed = np.bincount(cells.ravel(), back.ravel(), 256 * EMBEDDING).reshape(256, EMBEDDING).astype(self.p["embed"].dtype)
        d_embed[0] = 0
        return {
            "embed": d_embed,
            "filters": np.einsum("nf,nfk->kf", d_top, won) * self.live,
            "bias": d_top.sum(axis=0),
            "out": top.T @ d,
            "out_bias": d.sum(axis=0),
        }

    def train(self, rows: np.ndarray, labels: np.ndarray, seed: int = 1) -> None:
        """Adam with decaying steps over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps, t = max(1, EPOCHS * -(-len(rows) // BATCH)), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), BATCH):
                t += 1
                pick = order[i : i + BATCH]
                for k, g in self.gradients(rows[pick], labels[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    step = RATE * (1 - t / (steps + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                    self.p[k] -= (step * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)


def has_letter(text: str) -> bool:
    """Whether a character of `text` is alphabetic (digits of any script, fractions and numerals aren't)."""
    return any(map(str.isalpha, text))


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def training_windows(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages, and windows of a bounded sample of the labelled texts outside the held-out fold with their labels."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_of("doc_id") % FOLDS != HELD_OUT)
    ).select("doc_id", "lang", "text")
    # A row for each language.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not counts:
        return [], np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64)
    each = max(1, min(PER_LANGUAGE, TRAIN_TEXTS // len(counts)))
    rates = known.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = F.char_length("text")
    begin = lambda i: (n * i / WINDOWS_EACH).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda i: F.substring(F.col("text"), begin(i), F.lit(LENGTH)))
    sample = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("doc_id", "lang", F.array_distinct(pieces).alias("pieces"))
    langs = sorted(counts)
    number = {k: i for i, k in enumerate(langs)}
    texts, labels = [], []
    for row in sorted(sample.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["pieces"])):
        for piece in row["pieces"]:
            if has_letter(piece):
                texts.append(as_bytes(piece)[:LENGTH])
                labels.append(number[row["lang"]])
    rows, owners, _ = windows(texts)
    return langs, rows, np.array(labels, np.int64)[owners]


def trained(docs: DataFrame) -> tuple[list[str], Network | None]:
    langs, rows, labels = training_windows(docs)
    if not len(rows):
        return [], None
    net = Network(len(langs))
    net.train(rows, labels)
    return langs, net


def predictor(langs: list[str], net: Network | None):
    """The function from texts to (languages, scores)."""

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if net is None:
            return names, scores
        begin = 0
        while begin < len(texts):
            end, total, held = begin, 0, []
            while end < len(texts) and total < 1 << 21:
                t = texts[end]
                held.append(as_bytes(t) if t and has_letter(t) else b"")
                total += len(held[-1])
                end += 1
            rows, owners, sizes = windows(held)
            sums = np.zeros((len(held), len(langs)))
            np.add.at(sums, owners, net.probabilities(rows) * sizes[:, None])
            for i in np.unique(owners).tolist():
                k = int(sums[i].argmax())
                names[begin + i], scores[begin + i] = langs[k], float(min(1.0, sums[i][k] / len(held[i])))
            begin = end
        return names, scores

    return predict


def identified(docs: DataFrame, model: tuple[list[str], Network | None] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of `docs`, with `model` or one trained on `docs`."""
    predict = predictor(*(model or trained(docs)))

    def run(batches):
        for batch in slices(batches):
            names, scores = predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = (crc32_of("doc_id") % FOLDS == HELD_OUT).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def filtered(docs: DataFrame, least: float, model: tuple[list[str], Network | None] | None = None) -> DataFrame:
    """The rows of `docs` with a known language of probability `least` or more."""
    predict = predictor(*(model or trained(docs)))

    def run(batches):
        for batch in slices(batches):
            names, scores = predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_query(docs: DataFrame) -> DataFrame:
    return identified(docs)
