"""Operator 9: quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector over hashed text for all grades, and ordered
thresholds. The expected grade and the tail probability P(grade >= g) select documents.

Hashed text: byte trigrams, word shapes and repeats of the word before, each kind hashed into its own part of
`DIM` buckets and scaled so that its square roots of shares have length one. Whole texts count.

The fit uses at most `max_labelled` rated documents, the ones of least id hash (a documented bound: that many rows
of DIM floats reach the driver). Scoring covers every document in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import text_chunks, word_hashes, words

TRIGRAMS, SHAPES, DIM = 1536, 508, 2048  #: the last four buckets: new word, repeat, has words, has none
MAX_LABELLED = 4000
_KIND = np.full(256, 3, np.uint32)  # other
_KIND[list(range(97, 123))] = 1
_KIND[list(range(65, 91))] = 2
_KIND[list(range(48, 58))] = 4
_KIND[list(range(128, 256))] = 1
_KIND[list(b".,;:'\"-?")] = 5


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A float32 row of DIM features for each text of a chunk."""
    n = len(offs) - 1
    out = np.zeros((n, DIM), np.float32)
    size = np.diff(offs)
    text = np.repeat(np.arange(n), size)
    if len(data) > 2:
        x = data.astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(8)
        ok = text[:-2] == text[2:]
        out[:, :TRIGRAMS] = np.bincount((text[:-2] * TRIGRAMS + h % np.uint32(TRIGRAMS))[ok], minlength=n * TRIGRAMS).reshape(n, -1)
    starts, ends, first = words(data, offs)
    if len(starts):
        kind = _KIND[data].astype(np.uint64)
        seen = [np.add.reduceat(np.append((kind == k).astype(np.int32), 0), np.stack([starts, ends], 1).ravel())[::2] for k in range(1, 6)]
        shape = sum(np.minimum(c, 3) * 4**k for k, c in enumerate(seen)) * 4 + np.minimum((ends - starts) >> 3, 3)
        shape = (shape.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(9)) % np.uint32(SHAPES)
        of = text[starts]
        out[:, TRIGRAMS : TRIGRAMS + SHAPES] = np.bincount(of * SHAPES + shape, minlength=n * SHAPES).reshape(n, -1)
        w = word_hashes(data, starts, ends)
        same = np.zeros(len(w), np.int64)
        same[1:] = (w[1:] == w[:-1]) & (of[1:] == of[:-1])
        out[:, DIM - 4 : DIM - 2] = np.bincount(of * 2 + same, minlength=n * 2).reshape(n, 2)
    has = np.diff(first) > 0
    for a, b in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + SHAPES), (DIM - 4, DIM - 2)):
        part = out[:, a:b]
        np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1), out=part)
    out[has, DIM - 2] = 1
    out[~has, DIM - 1] = 1
    return out


def feature_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, features) of at most 128 texts at a time."""
    for k in range(0, len(column), 128):
        for i, j, data, offs in text_chunks(column.slice(k, 128), 1 << 20):
            yield k + i, k + j, features(data, offs)


class CumulativeLink:
    """Weights and ordered thresholds for grades 0..len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        z = np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -40, 40)
        return 1 / (1 + np.exp(z))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, grades: int, steps: int = 400, rate: float = 0.1, ridge: float = 2e-5) -> CumulativeLink:
        """Maximum likelihood with a small ridge, by full-batch Adam; thresholds stay ordered through log gaps."""
        cuts = grades - 1
        share = np.clip([(y < k).mean() for k in range(1, grades)], 1e-3, 1 - 1e-3)
        base = np.log(share / (1 - share))
        p = np.concatenate([np.zeros(x.shape[1]), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        rows = np.arange(len(y))
        for step in range(1, steps + 1):
            w, gaps = p[: -cuts], np.exp(p[len(p) - cuts + 1 :])
            t = p[len(p) - cuts] + np.concatenate([[0], np.cumsum(gaps)])
            s = 1 / (1 + np.exp(-np.clip(t[None, :] - (x @ w.astype(np.float32))[:, None], -40, 40)))
            s = np.concatenate([np.zeros((len(y), 1)), s, np.ones((len(y), 1))], 1)
            d = s * (1 - s)
            hi, lo = s[rows, y + 1], s[rows, y]
            like = np.maximum(hi - lo, 1e-9)
            up, down = d[rows, y + 1] / like, d[rows, y] / like  # of log-likelihood by the upper and lower threshold
            g_eta = -(up - down)
            gt = np.zeros((cuts + 2,))
            np.add.at(gt, y + 1, up)
            np.add.at(gt, y, -down)
            gt = gt[1:-1]
            grad = np.concatenate([x.T @ g_eta.astype(np.float32) / len(y) - ridge * w, [gt.sum() / len(y)], np.array([gt[k:].sum() for k in range(1, cuts)]) * gaps / len(y)])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        gaps = np.exp(p[len(p) - cuts + 1 :])
        return cls(p[: -cuts].astype(np.float32), p[len(p) - cuts] + np.concatenate([[0], np.cumsum(gaps)]))


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_labelled: int = MAX_LABELLED) -> CumulativeLink | None:
    """A model of ratings(id, grade), grades 0, 1, ...; None if there is no rated document or one grade only.

    Null ids and grades are left out; of several ratings of an id the lowest counts; of a repeated id each text.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(grade_col).cast("int")).alias("grade"))
    few = rated.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id").select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in feature_rows(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["grade", "x"])

    got = texts.mapInArrow(run, "grade int, x binary").orderBy(F.xxhash64("x"), "grade").limit(max_labelled).collect()
    y = np.array([r["grade"] for r in got], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return CumulativeLink.fit(x, y, int(y.max()) + 1)


def grade_documents(docs: DataFrame, model: CumulativeLink | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tails array<double>) for each row: tails[k - 1] is P(grade >= k). A null or empty text is
    scored by its emptiness. Without a model both are null."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return texts.select(F.col("id").alias(id_col), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tails"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in feature_rows(batch.column(1)):
                t = model.tails(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(t.sum(1)), pa.array(list(t), pa.list_(pa.float64()))], names=["id", "expected_grade", "tails"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, expected_grade double, tails array<double>").withColumnRenamed("id", id_col)


def select_documents(docs: DataFrame, model: CumulativeLink | None, text_col: str = "text", grade: int = 1, least: float = 0.4) -> DataFrame:
    """The rows of docs, all columns, with P(grade >= `grade`) of `least` or more; all rows without a model."""
    if model is None:
        return docs
    at = min(grade, len(model.thresholds)) - 1

    @F.pandas_udf("double")
    def tail(text):
        import pandas as pd

        rows = [model.tails(x)[:, at] for _, _, x in feature_rows(pa.array(text, pa.string(), from_pandas=True))]
        return pd.Series(np.concatenate(rows) if rows else np.zeros(0))

    return docs.where(tail(F.col(text_col).cast("string")) >= least)


def ratings_of_labels(labels: DataFrame) -> DataFrame:
    """Grades from labels(doc_id, quality, toxic): 0 poor, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", (F.col("quality") + F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("grade"))
