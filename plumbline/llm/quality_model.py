"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of the whole text (lengths, shares of symbols, capitals, repeated
words and lines) are transformed so that each class is roughly normal.  Each
class has a mean and a covariance, shrunk towards the covariance of both
classes and towards its diagonal.  The score is the logistic of the difference
of the two log densities and log shares; each density is a Mahalanobis
distance through a Cholesky factor that is made once, at fitting.

Fitting needs sums and sums of products for each class alone, so all labelled
rows are used: partial sums are made in each task and added up, and what
reaches the driver is a few hundred numbers, whatever the input.

Defined cases: a null text is the empty one and is scored like any other;
labels other than 0 and 1, and labels or documents without a doc_id, are not
learnt from; a document with several labels counts once for each; if a class
has no labelled row, every score is the share of class 1 (0.5 without labels);
repeated rows are scored one by one; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shared
from plumbline.llm import words as W
from plumbline.llm.quality_rules import HEADS, Texts

#: Weight of the pooled covariance, and of its diagonal, in each class's covariance.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.2, 0.1, 1e-3
END_MARKS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
DIGITS = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
STATISTICS = (
    "log_words", "word_length", "log_symbols", "log_upper", "log_repeated", "log_dup_lines", "log_same_as_last", "distinct", "log_end_marks", "log_digits", "log_line_words",
)


def statistics(texts: Texts) -> np.ndarray:
    """A row of transformed statistics for each text."""
    n = texts.get("n_words").astype(float)
    some = np.maximum(n, 1)
    bytes_ = texts.get("bytes")
    chars = np.maximum(texts.per_row(HEADS[bytes_]), 1)
    letters = texts.get("n_upper") + texts.get("n_lower")
    words = texts.get("words")
    h, row = words.hashes(), words.rows()
    again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=len(n))
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(n))
    share = lambda x, of: np.log(x / of + 0.01)
    lines = np.maximum(texts.get("n_lines"), 1)
    return np.stack([
        np.log1p(n), np.sqrt(texts.get("word_chars") / some), share(texts.get("n_symbols"), some), share(texts.get("n_upper"), np.maximum(letters, 1)),
        share(texts.get("n_repeat_words"), some), share(texts.get("n_dup_lines"), lines), share(again, some),
        np.log(distinct + 1) - 0.85 * np.log1p(n), share(texts.per_row(END_MARKS[bytes_]), some), share(texts.per_row(DIGITS[bytes_]), chars), np.log(some / lines),
    ], axis=1)


def featured(docs: DataFrame) -> DataFrame:
    """``doc_id, x array<double>`` for each row of ``docs``."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, first, last = W.buffers(batch.column(1))
            x = np.concatenate([np.empty((0, len(STATISTICS))), *(statistics(Texts(data, first[i:j], last[i:j])) for i, j in W.blocks(first, last))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Model:
    """``classes``: for each class its mean, the inverse of its Cholesky factor and its log determinant; empty if one class is missing."""

    share: float
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        density = [-0.5 * (np.square((x - mean) @ inverse.T).sum(1) + log_det) for mean, inverse, log_det in self.classes]
        z = density[1] - density[0] + np.log(self.share) - np.log1p(-self.share)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """From each class's count, sum and sum of products."""
    n = {k: sums[k][0] if k in sums else 0.0 for k in (0, 1)}
    share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
    if not (n[0] and n[1]):
        return Model(share, ())
    means = {k: sums[k][1] / n[k] for k in n}
    own = {k: sums[k][2] / n[k] - np.outer(means[k], means[k]) for k in n}
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    out = []
    for k in (0, 1):
        c = (1 - to_pooled) * own[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        out.append((means[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Model(share, tuple(out))


def fit(features: DataFrame, labels: DataFrame) -> Model:
    """From ``features`` (doc_id, x) and ``labels`` (doc_id, label)."""
    width = len(STATISTICS)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    own = x[y == k]
                    total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array((at // total.shape[1]).astype(np.int32)), pa.array((at % total.shape[1]).astype(np.int32)), pa.array(total.ravel())], ["k", "i", "v"])

    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    parts = features.join(known, "doc_id").select("x", "label").mapInArrow(sums, "k int, i int, v double")
    rows = parts.groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    total = np.zeros((2, 1 + width + width * width))
    for r in rows:
        total[r["k"], r["i"]] = r["v"]
    return fit_sums({k: (total[k, 0], total[k, 1 : 1 + width], total[k, 1 + width :].reshape(width, width)) for k in (0, 1)})


def score(features: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``features``."""

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.scores(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "score"])

    return features.select("doc_id", "x").mapInArrow(scored, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; labels are learnt from rows that are not held out."""
    features = shared.written(featured(docs), "features")
    model = fit(features, labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")))
    return score(features, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
