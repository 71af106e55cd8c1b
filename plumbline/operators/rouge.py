"""ROUGE-L: the longest common subsequence of an answer's tokens and a gold's.

Tokens are made by the answer normaliser in the JVM.  A batch numbers them as
one Arrow dictionary, and each pair of sequences is compared by rows of bits:
one whole number holds, for all tokens of the one sequence, whether the
subsequence grows there, and each token of the other one is a handful of
operations on it.  Memory is linear in the tokens: the bits of the most
frequent tokens are kept, those of others are made when they are met.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from plumbline.functions import text as T

#: Tokens of a sequence whose bits are kept.
KEPT = 64


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two arrays of numbers."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    if not n:
        return head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return head + tail
    values, at, count = np.unique(a, return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    ends = np.cumsum(count)

    def bits(k: int) -> int:
        own = np.zeros(len(a), np.uint8)
        own[order[ends[k] - count[k] : ends[k]]] = 1
        return int.from_bytes(np.packbits(own, bitorder="little").tobytes(), "little")

    kept = {int(k): bits(k) for k in np.argsort(-count, kind="stable")[:KEPT]}
    whole = (1 << len(a)) - 1
    row = whole
    for k in np.searchsorted(values, b).tolist():
        met = row & (kept[k] if k in kept else bits(k))
        row = (row + met | row - met) & whole
    return head + tail + len(a) - row.bit_count()


def f_measure(common: int, n: int, m: int) -> float:
    """Harmonic mean of the shares that the common subsequence has of both; two empty sequences are the same."""
    if not n or not m:
        return float(n == m)
    return 2.0 * common / (n + m)


def with_rouge_l(rows: DataFrame, text: Column | str = "text", golds: Column | str = "gold_answers", name: str = "rouge_l") -> DataFrame:
    """``rows`` with the best ROUGE-L over the golds; null without golds.  A null text is the empty one."""
    text, golds = (F.col(c) if isinstance(c, str) else c for c in (text, golds))
    names = [*rows.columns, name]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            each = theirs.flatten()
            codes = pa.concat_arrays([mine.flatten(), each.flatten()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            n = mine.value_lengths().to_numpy()
            m = each.value_lengths().to_numpy()
            own_end, gold_end = np.cumsum(n), len(mine.flatten()) + np.cumsum(m)
            out, at = [], 0
            for i, many in enumerate(theirs.value_lengths().fill_null(0).to_pylist()):
                a = codes[own_end[i] - n[i] : own_end[i]]
                out.append(max((f_measure(lcs(a, codes[gold_end[g] - m[g] : gold_end[g]]), n[i], m[g]) for g in range(at, at + many)), default=None))
                at += many
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.float64())], names)

    cut = F.transform(F.filter(golds, lambda g: g.isNotNull()), T.answer_tokens)
    made = rows.select("*", T.answer_tokens(F.coalesce(text, F.lit(""))).alias("__mine"), cut.alias("__golds"))
    return made.mapInArrow(run, ST.StructType([*rows.schema.fields, ST.StructField(name, ST.DoubleType())]))
