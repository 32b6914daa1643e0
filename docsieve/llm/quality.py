"""Quality scores: random Fourier features, ridge regression and isotonic calibration.

Each document gives a few statistics of its whole text. Standardised, they are mapped by ``cos(Wx + b)`` to features
whose products approximate a Gaussian kernel; a ridge regression on them is solved from normal equations that each
partition sums and one aggregation adds up. The raw scores of the labelled rows are then calibrated by isotonic
regression over a fixed grid of score bins. What reaches the driver is bounded by the number of features and bins,
never by the number of documents; every labelled row of the training part counts.

Defined results: null and empty texts have statistics of 0 and a score like any other; null document ids are held out
of training; conflicting or repeated labels of a document all count; without any labelled row, or with labels of one
kind, every score is the mean label (0.5 without labels); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .batches import matrix, parts, table_of

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "spaces", "symbols", "stops", "marks", "pipes",
    "bangs", "same_next", "distinct", "same_lines", "top_word", "long_words", "lines",
]
N_FEATURES, N_BINS = 160, 400
STATS = "doc_id long, stats array<double>"
SCORES = "doc_id long, score double, predicted int"

_CLASS = np.zeros((256, 9))
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r", "#$%&*@^~_+=<>{}[]\\/", ".,;:", "|", "!?")):
    for _c in _chars:
        _CLASS[ord(_c), _i] = 1
_CLASS[128:, 7] = 1
_CLASS[:, 8] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [math.log1p(len(data)), *[0.0] * (len(STATISTICS) - 1)]
    upper, digits, spaces, symbols, stops, pipes, bangs, _, n = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS
    k, lines = len(words), data.count(b"\n") + 1
    counts = Counter(words)
    inked = max(1.0, n - spaces)
    same = sum(map(bytes.__eq__, words, words[1:]))
    rows = data.split(b"\n")
    return [
        math.log1p(n), math.log1p(k), inked / k, upper / inked, digits / inked, spaces / n, symbols / inked, stops / k,
        (symbols + pipes + bangs) / k, pipes / k, bangs / k, same / k, len(counts) / k, 1 - len(set(rows)) / len(rows),
        counts.most_common(1)[0][1] / k, sum(len(w) > 25 for w in counts) / len(counts), math.log1p(lines / k),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics as an array; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield table_of(STATS, (b.column("doc_id"), [statistics(x) for x in b.column("text").to_pylist()]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STATS)


@dataclass
class Model:
    """Standardisation, projection, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        rff = np.cos(z @ self.weights + self.offsets) * math.sqrt(2 / len(self.offsets))
        return np.column_stack([np.ones(len(z)), z, rff])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(stats), self.values[0])
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nondecreasing fit of weighted means: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2]])
    return np.concatenate([np.full(int(n), m) for _, m, n in pools]) if pools else np.zeros(0)


def fit(labelled: DataFrame, *, n_features: int = N_FEATURES, width: float = 4.0, ridge: float = 1e-3, n_bins: int = N_BINS, seed: int = 7) -> Model:
    """Fit on rows ``stats array<double>, label int`` (0 or 1)."""
    d = len(STATISTICS)
    rows = labelled.filter(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("double").alias("label"))
    sums = rows.agg(
        F.count("label").alias("n"),
        F.sum("label").alias("y"),
        *(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(d)),
        *(F.sum(F.col("stats")[k] * F.col("stats")[k]).alias(f"q{k}") for k in range(d)),
    ).first()
    n, y = sums["n"], sums["y"] or 0.0
    rng = np.random.default_rng(seed)
    weights, offsets = rng.normal(size=(d, n_features)) / width, rng.uniform(0, 2 * math.pi, n_features)
    none = np.zeros(0)
    if not n or y in (0, n):
        return Model(np.zeros(d), np.ones(d), weights, offsets, none, none, np.array([y / n if n else 0.5]))
    mean = np.array([sums[f"s{k}"] for k in range(d)]) / n
    var = np.array([sums[f"q{k}"] for k in range(d)]) / n - mean**2
    model = Model(mean, np.sqrt(np.maximum(var, 1e-12)) + 1e-6, weights, offsets, none, none, none)
    size = 1 + d + n_features

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                x = model.features(matrix(b.column("stats"), d))
                total += x.T @ np.column_stack([x, b.column("label").to_numpy()])
        if total.any():
            yield table_of("i int, row array<double>", (np.arange(size), list(total)))

    summed = rows.mapInArrow(partial, "i int, row array<double>")
    # Partitions' sums meet in one row for each feature: entry by entry, folded on the map side.
    cells = summed.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    system = np.zeros((size, size + 1))
    for i, j, v in cells.collect():  # size * (size + 1) numbers, whatever the corpus
        system[i, j] = v
    model.ridge = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(size), system[:, -1])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw(matrix(b.column("stats"), d)) if b.num_rows else np.zeros(0)
            at = np.clip(np.rint((raw + 0.5) * n_bins / 2), 0, n_bins).astype(np.int32)
            yield table_of("bin int, label double", (at, b.column("label")))

    curve = rows.mapInArrow(bins, "bin int, label double").groupBy("bin").agg(F.count("label").alias("n"), F.avg("label").alias("m"))
    curve = np.array(sorted(tuple(r) for r in curve.collect()), float)  # at most n_bins + 1 rows
    model.knots = curve[:, 0] * 2 / n_bins - 0.5
    model.values = isotonic(curve[:, 1], curve[:, 2])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(matrix(b.column("stats"), len(STATISTICS))) if b.num_rows else np.zeros(0)
            yield table_of(SCORES, (b.column("doc_id"), s, (s >= 0.5).astype(np.int32)))

    return stats.mapInArrow(run, SCORES)


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels (doc_id, quality) of the other fold train."""
    shared_folder(docs.sparkSession)
    stats = document_statistics(docs).checkpoint()
    train = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").alias("label")
    )
    model = fit(stats.join(train, "doc_id").select("stats", "label").checkpoint())
    return score(stats, model).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "score", "predicted"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns) that the classifier does not reject; they are scored where they are read."""
    shared_folder(docs.sparkSession)
    train = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id"), F.col("quality").alias("label")
    )
    stats = document_statistics(docs).checkpoint()
    model = fit(stats.join(train, "doc_id").select("stats", "label").checkpoint())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            good = model.score(np.array([statistics(x) for x in b.column("text").to_pylist()])) >= 0.5
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
