"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic.

A Gaussian kernel over document statistics is approximated by cosines of random projections. Each
partition sums its part of the normal equations over the labelled rows, as whole numbers of a fixed
step so that the order of summing can't matter; the small sums are added up and solved. Left-one-out
predictions of the labelled rows, which the same equations give, fit the isotonic calibration.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import deleted, in_task, written

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "pipes", "exclamations", "commas_stops",
    "short_words", "distinct_words", "most_common_word", "lines", "repeated_lines", "long_words", "capital_words",
)
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL = b"#$%&*@^~<>{}[]\\/=+_`"
#: Normal equations are summed in steps of this size.
STEP = 2.0**-14


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text; all 0 for null and empty texts."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(STATISTICS) - 1)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    n, size, lengths = len(words), len(raw), [*map(len, words)]
    letters = max(1, size - count(_DIGIT + _SYMBOL + b" \n\t.,;:!?|-'\""))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(size)), float(np.log1p(n)), sum(lengths) / n, count(_UPPER) / letters, count(_DIGIT) / size,
        count(_SYMBOL) / n, count(b"|") / n, count(b"!") / n, count(b".,") / n, sum(x <= 3 for x in lengths) / n,
        len(seen) / n, max(seen.values()) / n, len(lines) / n, 1 - len({*lines}) / max(1, len(lines)),
        sum(x >= 14 for x in lengths) / n, sum(w[:1].isupper() for w in words) / n,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.projection + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.knots, self.values), 0, 1)


def _table(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, len(STATISTICS))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` (array of double, in order of STATISTICS) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([*_table(batch)], pa.list_(pa.float64())) if batch.num_rows else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], names=["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, stats array<double>")


def _pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y on increasing x by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([b, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, u, s = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[2] = (p[0] * p[1] + v * u) / (p[1] + u), p[1] + u, p[2] + s
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def fit(
    docs: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, bins: int = 2048, seed: int = 7
) -> Model:
    """Fit on all documents that ``labels`` (doc_id, quality 0/1) marks; null labels and ids don't count.

    Only the labelled rows' statistics are kept, as a small scratch table. What comes to the driver
    is bounded by parameters: ``features`` squared sums and ``bins`` calibration counts. With no
    usable label every score is 0.5; with labels of one kind, that kind.
    """
    spark, d = docs.sparkSession, len(STATISTICS)
    rng = np.random.default_rng(seed)
    projection, phase = rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features)
    marked = labels.filter("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")
    )
    rows, place = written(document_statistics(docs).join(marked, "doc_id").select("stats", "y"), "quality-rows")
    sums = rows.select(
        F.count("*"), F.sum("y"), *[f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    ).first()
    n, ones, moments = sums[0], sums[1], np.array(sums[2:], float).reshape(d, 2) if sums[0] else np.zeros((d, 2))
    mean, scale = (np.array([float(f"{v:.6g}") for v in moments[:, k]]) for k in (0, 1))
    scale[scale < 1e-9] = 1.0
    blank = Model(mean, scale, projection, phase, np.zeros(features + 1), np.zeros(1), np.full(1, 0.5 if not n else ones / n))
    if not n or ones in (0, n):
        deleted(spark, place)
        return blank

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((features + 2, features + 1), np.int64)
        for batch in batches:
            z = np.rint(blank.features(np.array(batch.column("stats").to_pylist()).reshape(-1, d)) / STEP)
            y = np.array(batch.column("y"))
            a[:-1] += np.rint(z.T @ z).astype(np.int64)  # whole numbers below 2**53: exact
            a[-1] += np.rint(z.T @ y).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(features + 2), pa.int32()), pa.array([r.tobytes() for r in a], pa.binary())], names=["i", "sums"]
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in group["sums"])
        return pd.DataFrame({"i": group["i"].iloc[:1], "sums": [total.tobytes()]})

    added = rows.mapInArrow(normal, "i int, sums binary").groupBy("i").applyInPandas(add, "i int, sums binary").collect()
    table = np.array([np.frombuffer(r.sums, np.int64) for r in sorted(added, key=lambda r: r.i)], float)
    gram = table[:-1] * STEP**2 + np.eye(features + 1) * ridge * n / features
    right = table[-1] * STEP
    inverse, weights = in_task(spark, lambda g, r: (np.linalg.inv(g), np.linalg.solve(g, r)), gram, right)
    linear = Model(mean, scale, projection, phase, weights, np.zeros(1), np.zeros(1))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, y = linear.features(np.array(batch.column("stats").to_pylist()).reshape(-1, d)), np.array(batch.column("y"))
            raw = y - (y - z @ weights) / np.maximum(1e-3, 1 - np.einsum("ij,jk,ik->i", z, inverse, z))
            at = np.rint((np.clip(raw, -0.5, 1.5) + 0.5) * bins / 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y)], names=["bin", "y"])

    per_bin = rows.mapInArrow(left_out, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    counts = np.array([(r.bin, r.n, r.y) for r in per_bin.orderBy("bin").collect()], float)
    deleted(spark, place)
    knots, values = _pooled(counts[:, 0] * 2 / bins - 0.5, counts[:, 2] / counts[:, 1], counts[:, 1])
    return Model(mean, scale, projection, phase, weights, knots, values)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the quality score (0 to 1) of each whole text; a column of that name is replaced.

    Needs only a ``text`` column; null and empty texts are scored by their (zero) statistics. One
    narrow pass: no shuffle, and every row stays a row.
    """
    docs = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_table(batch)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose labels training must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


__all__ = ["STATISTICS", "Model", "document_statistics", "fit", "held_out", "score", "statistics"]
