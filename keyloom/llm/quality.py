"""Quality scores: statistics of a document, random Fourier features, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics.  Ridge regression needs only the normal
equations, which are summed over partitions, one system per fold, so that the penalty is chosen by cross-validation
and the calibration sees out-of-fold scores alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, scratch, staged
from .sums import float_rows, partition_sums

#: Random features, folds, penalties per row that cross-validation chooses from, and bins of the calibration.
FEATURES, FOLDS, PENALTIES, BINS, SEED = 192, 4, (1e-4, 1e-3, 1e-2, 1e-1), 4096, 20240607
#: ASCII characters by class.
_CLASSES = {"digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "stop": b".,;:!?'\"", "mark": b"#$%&*+-/<=>@\\^_`|~()[]{}", "space": b" ", "line": b"\n", "high": bytes(range(128, 256))}
_CLASS_OF = np.stack([np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in _CLASSES.values()]).astype(np.float64)
N_STATISTICS = len(_CLASSES) + 15


def statistics(text: str) -> list[float]:
    """What a whole text looks like; an empty one is all zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * N_STATISTICS
    n = len(raw)
    bytes_ = np.frombuffer(raw, np.uint8)
    counts = np.bincount(bytes_, minlength=256).astype(np.float64)
    share = counts[counts > 0] / n
    words = text.split()
    many = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if many > 1 else 0  # noqa: B905
    lines = [x for x in text.split("\n") if x]
    line_n = max(1, len(lines))
    marked = sum(not w[-1].isalnum() for w in words)
    shortest = float((lengths <= 3).mean())
    return [
        *(_CLASS_OF @ counts / n).tolist(),
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float(lengths.max()) ** 0.5, shortest,
        kinds / many ** 0.9, pairs / many, marked / many, len(set(lines)) / line_n, np.log1p(n / line_n), float(-(share * np.log2(share)).sum()),
        len(zlib.compress(raw, 1)) / n, float((bytes_[1:] == bytes_[:-1]).mean()) if n > 1 else 0.0, sum(map(str.istitle, words)) / many,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) -> (doc_id, x array<float>)."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch({"doc_id": rows.column("doc_id"), "x": [statistics(t.as_py() or "") for t in rows.column("text")]}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Model:
    """Everything that a score needs."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, *self.knots)


def isotonic(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators on points sorted by `at`; the blocks' centres and means, to interpolate between."""
    blocks: list[list[float]] = []
    for a, b, w in zip(at, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    # one observation of each kind keeps a short pure block from claiming certainty
    overall = sum(b[1] for b in blocks) / sum(b[2] for b in blocks)
    values = np.maximum.accumulate([(b[1] + overall) / (b[2] + 1) for b in blocks])
    return np.array([b[0] / b[2] for b in blocks]), values


def fit(train: DataFrame) -> Model | float:
    """train: rows (x, y, fold), written already -> the model; where one label is missing, the label's share (0.5 of nothing)."""
    d = N_STATISTICS

    def moments(total: np.ndarray, rows: pa.RecordBatch) -> None:
        x, y = float_rows(rows, "x"), rows.column("y").to_numpy()
        total += np.concatenate([x.sum(0), (x * x).sum(0), [len(y), y.sum()]])

    sums = partition_sums(train, 2 * d + 2, moments)
    n, positive = sums[-2:]
    if n == 0 or positive in (0, n):
        return float(positive / n) if n else 0.5
    mean = sums[:d] / n
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / n - mean * mean, 1e-8))
    random = np.random.default_rng(SEED)
    model = Model(mean, scale, random.normal(0, 1 / np.sqrt(2 * d), (d, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1)))
    m = FEATURES + 1
    size = m * m + m + 2

    def normal(total: np.ndarray, rows: pa.RecordBatch) -> None:
        z, y, fold = model.features(float_rows(rows, "x")), rows.column("y").to_numpy().astype(np.float64), rows.column("fold").to_numpy()
        for k in np.unique(fold):
            own = fold == k
            total[k * size : (k + 1) * size] += np.concatenate([(z[own].T @ z[own]).ravel(), z[own].T @ y[own], [y[own] @ y[own], own.sum()]])

    systems = partition_sums(train, FOLDS * size, normal).reshape(FOLDS, size)
    whole = systems.sum(0)
    unpenalised = np.eye(m)
    unpenalised[-1, -1] = 0

    def solve(s: np.ndarray, penalty: float) -> np.ndarray:
        return np.linalg.solve(s[: m * m].reshape(m, m) + (penalty * s[-1] * unpenalised + 1e-9 * np.eye(m)), s[m * m : m * m + m])

    def error(s: np.ndarray, w: np.ndarray) -> float:
        return float(s[-2] - 2 * w @ s[m * m : m * m + m] + w @ s[: m * m].reshape(m, m) @ w)

    penalty = min(PENALTIES, key=lambda p: sum(error(systems[k], solve(whole - systems[k], p)) for k in range(FOLDS) if systems[k][-1] < n))
    fold_weights = np.stack([solve(whole - systems[k], penalty) if systems[k][-1] < n else solve(whole, penalty) for k in range(FOLDS)])
    model.weights = solve(whole, penalty)

    def calibration(total: np.ndarray, rows: pa.RecordBatch) -> None:
        z, y, fold = model.features(float_rows(rows, "x")), rows.column("y").to_numpy(), rows.column("fold").to_numpy()
        raw = np.clip((z * fold_weights[fold]).sum(1), -0.5, 1.5)
        at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        total += np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS), np.bincount(at, raw, minlength=BINS)])

    counts, ones, raw = partition_sums(train, 3 * BINS, calibration).reshape(3, BINS)
    used = counts > 0
    model.knots = isotonic(raw[used] / counts[used], ones[used] / counts[used], counts[used])
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 marks the rows held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(1))


def learn(known: DataFrame, labels: DataFrame) -> Model | float:
    """Statistics (doc_id, x) and labels (doc_id, quality) -> the model, from the rows that are not held out."""
    marked = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("of"), (F.col("quality") > 0).cast("double").alias("y"))
    train = known.where(remainder(F.col("doc_id")) != 1).join(marked, F.col("doc_id") == F.col("of"))
    return fit(staged(train.select("x", "y", (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 3) % FOLDS).cast("int").alias("fold")), "training"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score 0.5 or more, with all their columns; texts are scored where they are."""
    with scratch(docs.sparkSession):
        model = learn(staged(document_statistics(docs), "statistics"), labels)

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        if isinstance(model, float) or not len(texts):
            return pd.Series([model >= 0.5 if isinstance(model, float) else True] * len(texts), dtype=bool)
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts])) >= 0.5)

    return docs.where(good("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (doc_id, text) and labels (doc_id, quality) -> doc_id, held_out, score, predicted, one row per document.

    Only texts enter a score.  Labels count where crc32(doc_id as text) mod 3 is not 1; every such row does, no sample is
    drawn.  Defined cases: a null text is empty and is scored; a null doc_id is held out; a null label does not count,
    one over 0 counts as 1; a document with several labels is learned from once for each; rows that share a doc_id are
    scored each; other columns are ignored; with no labels all scores are 0.5; an empty table gives no rows.
    """
    known = staged(document_statistics(docs), "statistics")
    model = learn(known, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                scores = np.full(rows.num_rows, model) if isinstance(model, float) else model.score(float_rows(rows, "x"))
                yield batch({"doc_id": rows.column("doc_id"), "score": np.clip(scores, 0, 1)}, schema)

    scored = known.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
