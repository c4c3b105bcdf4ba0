"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

A document becomes some twenty statistics of its whole text. Cosines of random projections of these approximate a
Gaussian kernel; each partition sums its share of the normal equations and the sums are added up pairwise, so what
reaches the driver has the size of the model, not of the data. Scores of labelled rows that the fit has not seen are
summed by narrow score bins, made monotone, and interpolated to the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

FEATURES = 256
RIDGE = 1e-3
SEED = 7
THRESHOLD = 0.3
#: Score bins of the calibration, over scores from LOW to HIGH; scores outside count in the first or last bin.
BINS, LOW, HIGH = 600, -0.5, 1.5
#: Shares of the labels (crc32 of the doc_id mod FOLDS): 0 is held out, 1 calibrates, the others fit.
FOLDS = 5
#: Tasks that add up what partitions have summed, before the driver adds theirs.
STEP_TASKS = 8

_CLASS = np.zeros(256, np.int64)  # 0: other
for _c, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()?", b"!", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)), 1):
    _CLASS[list(_bytes)] = _c
_CLASSES = 10
STATISTICS = 22


def _of_text(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if not n:
        return [0.0] * 11
    distinct = len(set(words))
    ends = sum(x.rstrip()[-1] in ".!?\"'" for x in lines)
    alone = sum(1 for x in words if len(x) == 1)
    # Words that follow themselves at the usual periods of repeated blocks show in pairs that recur.
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    return [
        np.log1p(n),
        distinct / n,
        pairs / max(1, n - 1),
        sum(map(len, words)) / n / 10,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        ends / len(lines),
        alone / n,
        sum(1 for x in words if x.isupper()) / n,
        sum(1 for x in words if not x[-1].isalnum()) / n,
        max(map(len, words)) / 40 if n else 0.0,
    ]


def statistics(column) -> np.ndarray:
    """The statistics of each text of an Arrow string column, a row each; null is the empty text."""
    out = np.zeros((len(column), STATISTICS))
    for i, text in enumerate(column.to_pylist()):
        if text:
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            share = np.bincount(_CLASS[data], minlength=_CLASSES)[:_CLASSES] / len(data)
            out[i, :_CLASSES] = np.sqrt(share)
            out[i, _CLASSES] = np.log1p(len(data))
            out[i, _CLASSES + 1 :] = _of_text(text)
    return out


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of doubles), one row a document."""

    def measured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            x = statistics(batch.column(1))
            offsets = pa.array(np.arange(0, x.size + 1, STATISTICS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(measured, "doc_id long, stats array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod FOLDS; a null doc_id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return design((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def design(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    z = np.clip(z, -6, 6)
    width = np.sqrt(z.shape[1])
    directions = rng.standard_normal((z.shape[1], FEATURES)) / width
    shifts = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + shifts), np.ones((len(z), 1))])


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, STATISTICS)


def _summed(rows: DataFrame, size: int, make) -> np.ndarray:
    """Sum over all partitions of make(batch), arrays of so many doubles: by partition, by STEP_TASKS tasks, on the driver."""

    def own(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def again(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.mapInArrow(own, "total binary").repartition(STEP_TASKS)
    return sum((np.frombuffer(r.total) for r in parts.mapInArrow(again, "total binary").collect()), np.zeros(size))


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """The model of labels (doc_id, column 0/1) over stats (doc_id, stats), from rows of folds other than 0 alone.

    All labelled rows count, a label that is given twice twice; null labels and labels of absent documents don't. With one
    class only every score is the mean label (0.5 without labels); without labels in fold 1 raw scores stay uncalibrated.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).filter("y is not null and doc_id is not null")
    known = known.withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0")
    rows = stored(stats.join(known, "doc_id").select("stats", "y", "fold"), "labelled")
    d, m = STATISTICS, FEATURES + 1

    def moments(batch) -> np.ndarray:
        x, y = _matrix(batch.column("stats")), batch.column("y").to_numpy()
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)])

    sums = _summed(rows, 2 + 2 * d, moments)
    n, positive = sums[0], sums[1]
    mean = sums[2 : 2 + d] / max(n, 1)
    scale = np.sqrt(np.maximum(sums[2 + d :] / max(n, 1) - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    if positive in (0, n):
        level = positive / n if n else 0.5
        return Model(mean, scale, np.zeros(m), np.array([0.0, 1.0]), np.array([level, level]))

    def equations(batch) -> np.ndarray:
        x, y, own = _matrix(batch.column("stats")), batch.column("y").to_numpy(), batch.column("fold").to_numpy() >= 2
        a = design((x[own] - mean) / scale)
        return np.concatenate([(a.T @ a).ravel(), a.T @ y[own], [own.sum()]])

    total = _summed(rows, m * m + m + 1, equations)
    penalty = np.eye(m) * RIDGE * max(total[-1], 1) / FEATURES
    penalty[-1, -1] = 1e-9
    model = Model(mean, scale, np.linalg.solve(total[: m * m].reshape(m, m) + penalty, total[m * m : -1]), np.zeros(0), np.zeros(0))

    def binned(batch) -> np.ndarray:
        x, y, own = _matrix(batch.column("stats")), batch.column("y").to_numpy(), batch.column("fold").to_numpy() == 1
        at = np.clip(((model.raw(x[own]) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y[own], BINS)])

    bins = _summed(rows, 2 * BINS, binned)
    count, ones = bins[:BINS], bins[BINS:]
    full = count > 0
    centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    if full.sum() < 2:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    level = monotone(ones[full] / count[full], count[full])
    model.knots, model.values = centres[full], np.clip(level, 0.001, 0.999)
    # Within a flat block the score still rises a little with the raw score, so that ranks are kept.
    model.values = 0.98 * model.values + 0.02 * (model.knots - LOW) / (HIGH - LOW)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of stats."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(apply, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; null and empty texts are scored by their statistics, all 0.

    Repeated rows get equal scores. Columns other than doc_id and text are never read.
    """
    stats = stored(text_statistics(docs), "statistics")
    model = fit(stats, labels)
    return scored(stats, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    model = fit(text_statistics(docs), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pyarrow as pa

        for texts in batches:
            yield pd.Series(np.concatenate([shared.value.score(statistics(pa.array(texts.iloc[i : i + 512], pa.string(), from_pandas=True))) for i in range(0, len(texts), 512)] or [np.zeros(0)]))

    return docs.filter(F.pandas_udf(score, "double")(F.col("text").cast("string")) >= threshold)
