"""Quality grades by ordinal regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, utf8

#: Runs of ASCII characters that are neither white space nor letters nor digits.
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")


def features(data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, runs of marks and repetition of a text: numbers and weights.

    Words and marks have weights of norm 1 together. The tenths of words that
    repeat the one before, and of words that are distinct, are one number each.
    """
    words = data.lower().split()
    hashes = [zlib.crc32(w) for w in words] + [zlib.crc32(m, 1) for m in _MARKS.findall(data)]
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, n = np.unique(np.array(hashes, np.int64) % dims, return_counts=True)
    weight = 1 + np.log(n)
    again = 10 * sum(map(eq, words, words[1:])) // len(words)
    fresh = 10 * len(set(words)) // len(words)
    levels = [zlib.crc32(b"again%d" % again, 2) % dims, zlib.crc32(b"fresh%d" % fresh, 2) % dims]
    return np.concatenate([at, levels]).astype(np.int32), np.concatenate([weight / np.sqrt((weight**2).sum()), [1.0, 1.0]]).astype(np.float32)


@dataclass
class OrdinalModel:
    """P(grade <= grades[k]) is the logistic function of thresholds[k] - weights . features."""

    grades: np.ndarray
    thresholds: np.ndarray
    weights: np.ndarray

    def tails(self, x: float) -> np.ndarray:
        """P(grade >= g) for each grade but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - x, -60, 60)))

    def expected(self, tails: np.ndarray) -> float:
        return float(self.grades[0] + (np.diff(self.grades) * tails).sum())


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray, float]], dims: int, rounds: int = 200, rate: float = 0.2, decay: float = 1e-5) -> OrdinalModel:
    """Cumulative-link fit by gradient steps with moments, over (numbers, weights, grade) of each example.

    The first threshold and the logarithms of the steps to the next ones are
    free, so thresholds are ordered.
    """
    grades = np.array(sorted({g for _, _, g in rows}), float)
    if len(grades) < 2:
        return OrdinalModel(grades if len(grades) else np.zeros(1), np.zeros(0), np.zeros(dims))
    y = np.searchsorted(grades, [g for _, _, g in rows])
    k, n = len(grades), len(rows)
    flat, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    owner = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    shares = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / n, 1e-3, 1 - 1e-3)
    first = np.log(shares / (1 - shares))
    free = np.concatenate([[first[0]], np.log(np.maximum(np.diff(first), 1e-2)), np.zeros(dims)])
    m, v = np.zeros_like(free), np.zeros_like(free)
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, rounds + 1):
        steps = np.exp(free[1 : k - 1])
        theta = np.concatenate([[-np.inf], free[0] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        x = np.bincount(owner, value * free[k - 1 :][flat], n)
        high, low = s(theta[y + 1] - x), s(theta[y] - x)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        by_theta = np.bincount(y, dh, k)[: k - 1] - np.bincount(y, dl, k)[1:]
        later = np.cumsum(by_theta[::-1])[::-1]
        up = np.concatenate([[later[0]], later[1:] * steps, np.bincount(flat, value * (dl - dh)[owner], dims)]) / n
        up[k - 1 :] -= decay * free[k - 1 :]
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
        free += rate * (1 - 0.9 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    thresholds = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1 : k - 1]))])
    return OrdinalModel(grades, thresholds, free[k - 1 :])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, examples: int = 8192, dims: int = 1 << 15) -> OrdinalModel:
    """A model from a bounded sample of rated rows.

    Candidates are rated rows whose CRC-32 of the id as text is not divisible by
    ``folds``; the ``examples`` of least hash of the id are taken. The driver gets
    at most ``examples`` times ``dims`` numbers. Null ids and ratings teach
    nothing; of repeated ratings the highest counts, and of repeated rows of an id
    the least text, so that an id is one example.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null and not isnan(y)")
    chosen = known.where(crc32_of_id(F.col("id")) % folds != 0).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(examples)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), utf8(F.col("text")).alias("data")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("data").alias("data"), F.max("y").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x, dims) for x in batch.column(1).to_pylist()]
            packed = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *packed], ["id", "y", "at", "weight"])

    rows = texts.select("id", "data", "y").mapInArrow(run, "id long, y double, at binary, weight binary").collect()
    rows.sort(key=lambda r: r.id)
    return fit_ordinal([(np.frombuffer(r.at, np.int32), np.frombuffer(r.weight, np.float32), r.y) for r in rows], dims)


def graded(docs: DataFrame, model: OrdinalModel, at_least: float) -> DataFrame:
    """Expected grade of each text, and the probability of a grade of ``at_least``.

    Returns, per row of ``docs``: doc_id, expected_grade, tail_probability.

    Null and empty texts have no features and get what the thresholds alone say.
    Null ids and repeated rows stay; other columns are left out. A model of one
    grade gives that grade. No shuffle; the model's size is fixed by its dims.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    level = int(np.searchsorted(model.grades, at_least))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            expected, tail = [], []
            for data in batch.column(1).to_pylist():
                at, weight = features(data, len(own.weights))
                tails = own.tails(float(own.weights[at] @ weight))
                expected.append(own.expected(tails))
                tail.append(1.0 if level == 0 else float(tails[level - 1]) if level <= len(tails) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("data"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
