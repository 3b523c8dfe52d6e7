"""Quality scores by regularised quadratic discriminants.

Each text becomes ``FEATURES`` statistics of its characters, words and lines, as
logarithms of smoothed shares and counts, so that classes are nearer to normal.
For each class the mean and the covariance come from exact sums over all labelled
training rows (one row of sums for each class and entry comes to the driver). A
covariance is shrunk to the pooled one and then to a multiple of the unit matrix;
its Cholesky factor is kept, and a text's log density is taken from the squared
length of the solved difference and the factor's diagonal. The score is the
logistic function of the difference of the two densities and the log odds of the
classes, tempered by the number of features.

The statistics are whole multiples of 2^-12 and their sums whole numbers, so the
model and the scores are the same whatever the order in which tasks end. They
are computed once and kept in the shared folder; texts are not exchanged. Labels are learnt only from rows that are not held out.

Defined results: a null text counts as empty; an empty text has finite
statistics and a score; texts of any length are whole; a null doc_id is not held
out and has no label; null labels are not learnt from; repeated rows repeat their
score, and count as often in learning; if a class has no training row every
score is the share of label 1 (0.5 without any row); an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import binary_texts, slices
from millrace.llm.common import stored

#: Weight of the pooled covariance, and of the unit matrix.
POOLED, UNIT = 0.2, 0.02
#: Steps of a statistic to one.
STEPS = 1 << 12
FEATURES = ["words", "bytes", "word_length", "symbols", "capitals", "digits", "shouts", "bars", "stops", "not_ascii", "distinct_words", "repeated_windows", "repeated_lines", "lines", "line_length", "symbol_words", "longest_word"]

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
_HAS_SYMBOL = bytes(0 if b in b"#*$%&|<>" else 1 for b in range(256))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text."""
    words = text.split()
    n, size = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda k, of: math.log((k + 0.5) / (of + 1))
    windows = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    in_words = sum(map(len, words))
    symbols = int(counts[_SYMBOLS].sum())
    marked = sum(0 in w.translate(_HAS_SYMBOL) for w in words) if symbols else 0
    return [
        math.log1p(n),
        math.log1p(size),
        math.log((in_words + 1) / (n + 1)),
        share(symbols, size),
        share(int(counts[65:91].sum()), size),
        share(int(counts[48:58].sum()), size),
        share(int(counts[33]), size),
        share(int(counts[124]), size),
        share(int(counts[_STOPS].sum()), size),
        share(int(counts[128:].sum()), size),
        share(len(set(words)), n),
        share(len(windows) - len(set(windows)), n),
        share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(lines)),
        math.log((size + 1) / (len(lines) + 1)),
        share(marked, n),
        math.log1p(max(map(len, words), default=0)),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1024):
            rows = np.array([statistics(t) for t in binary_texts(batch.column(1))]).reshape(-1, len(FEATURES))
            steps = np.rint(rows * STEPS).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(steps) + 1, dtype=np.int32) * len(FEATURES), pa.array(steps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x (the statistics in steps) of each row, kept in the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(texts.mapInArrow(_measured, "doc_id long, x array<int>"), "statistics")


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d), np.int64)
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    at = np.arange(total.shape[1])
    for c in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at, pa.int32()), pa.array(total[c])], ["y", "at", "v"])


class Discriminant:
    """Two normal densities with cached Cholesky factors."""

    def __init__(self, sums: np.ndarray, pooled: float = POOLED, unit: float = UNIT):
        d = len(FEATURES)
        n = sums[:, 0]
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.known = bool((n > 0).all())
        if not self.known:
            return
        self.means = sums[:, 1 : 1 + d] / n[:, None]
        scatter = [sums[c, 1 + d :].reshape(d, d) - n[c] * np.outer(self.means[c], self.means[c]) for c in (0, 1)]
        common = sum(scatter) / max(n.sum() - 2, 1)
        scale = np.sqrt(np.maximum(np.diag(common), 1e-6))  # covariances in units of the pooled deviations
        self.scale = scale
        common = common / np.outer(scale, scale)
        self.factors = []
        for c in (0, 1):
            own = scatter[c] / max(n[c] - 1, 1) / np.outer(scale, scale)
            s = (1 - pooled) * own + pooled * common
            s = (1 - unit) * s + unit * max(np.trace(s) / d, 1e-3) * np.eye(d)
            self.factors.append(np.linalg.cholesky((s + s.T) / 2 + 1e-9 * np.eye(d)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        if not self.known:
            return np.full(len(x), self.share)
        density = []
        for c in (0, 1):
            z = np.linalg.solve(self.factors[c], ((x - self.means[c]) / self.scale).T)
            density.append(-0.5 * (z * z).sum(0) - np.log(np.diag(self.factors[c])).sum())
        odds = density[1] - density[0] + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds / math.sqrt(len(FEATURES)), -500, 500)))


def fit(x: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from the labelled rows that are not held out; ``labels`` has doc_id and quality."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    own = own.where(remainder(F.col("doc_id")) != 1).where("y IN (0, 1)")
    sums = x.join(own, "doc_id").select("y", "x").mapInArrow(_sums, "y int, at int, v long")
    d = len(FEATURES)
    unit = np.concatenate([[1], np.full(d, STEPS), np.full(d * d, STEPS**2)])
    total = np.zeros((2, len(unit)))
    for r in sums.groupBy("y", "at").agg(F.sum(F.col("v").cast("decimal(38, 0)")).alias("v")).collect():
        total[r.y, r.at] = int(r.v) / int(unit[r.at])
    return Discriminant(total)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    x = measured(docs)
    model = fit(x, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(rows / STEPS))], ["doc_id", "score"])

    out = x.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
