"""An inverted index of shards, and BM25 over it that skips what cannot matter.

A shard is a row: up to ``RUN`` chunks that lie together, with the postings of
their terms as arrays in order of the terms.  So an index is made where the
chunks lie, without a shuffle, a term that stands everywhere is spread over all
shards, and a lost task costs its own shards.  With each term a shard has the
largest count of it in a chunk and the fewest words of a chunk with it, which
bound what the term can add to any score there.

Queries are a stated set and are taken in blocks.  From the terms of the shards
alone a first scan counts chunks by term.  The second goes through the shards
of a task in order of their bounds, with the k best scores of each query so
far: a query for which a shard's bound, at six decimals, lies below its k-th
score is left out of that shard, and a shard without queries is left out
whole.  What ties with the k-th score stays, so that ties are ranked as without
any skipping.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import terms
from plumbline.operators.retrieval import _asked, arrow_type, top_k

#: Chunks of a shard.
RUN = 16
_ARRAYS = {"terms": "array<string>", "ends": "array<int>", "most": "array<int>", "least": "array<int>", "slots": "array<int>", "tf": "array<int>", "words": "array<int>"}


def _lists(values, ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


@dataclass(frozen=True)
class Index:
    """``rows``: a row a shard, with arrays of the ``columns`` of its chunks."""

    rows: DataFrame
    columns: tuple[str, ...]

    def save(self, path: str) -> "Index":
        """Write the index; it serves any number of searches."""
        self.rows.write.parquet(path)
        return Index.load(self.rows.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Index":
        rows = spark.read.parquet(path)
        return cls(rows, tuple(c for c in rows.columns if c not in _ARRAYS))


def _shard(batch: pa.RecordBatch, lo: int, hi: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The terms of some rows, and as arrays where each one's postings end, its largest count and fewest words, slots and counts of postings, and words of chunks."""
    words = batch.column(0).slice(lo, hi - lo)
    size = words.value_lengths().to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.repeat(np.arange(hi - lo), size)
    key, tf = np.unique(place[coded.indices.to_numpy(zero_copy_only=False)] * (hi - lo) + row, return_counts=True) if len(row) else (row, row)
    term, slot = key // (hi - lo), key % (hi - lo)
    head = np.searchsorted(term, np.arange(len(order)))
    ends = np.append(head[1:], len(term))[: len(head)]
    most = np.maximum.reduceat(tf, head) if len(head) else head
    least = np.minimum.reduceat(size[slot], head) if len(head) else head
    return coded.dictionary.take(pa.array(order)), [ends, most, least, slot, tf, size]


def build(chunks: DataFrame, keep: Sequence[str] = ()) -> Index:
    """The index of chunks (chunk_id, text, and ``keep``).  A null text has no terms; its chunk counts all the same."""
    columns = tuple(dict.fromkeys(["chunk_id", *keep]))
    if clash := set(columns) & set(_ARRAYS):
        raise ValueError(f"columns of an index cannot be called {sorted(clash)}")
    fields = [T.StructField(c, T.ArrayType(chunks.schema[c].dataType)) for c in columns]
    schema = T.StructType([*fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in _ARRAYS.items())).fields])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, RUN):
                j = min(i + RUN, batch.num_rows)
                own, arrays = _shard(batch, i, j)
                names = [_lists(batch.column(c + 1).slice(i, j - i), [j - i]) for c in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*names, _lists(own.cast(pa.string()), [len(own)]), *(_lists(a.astype(np.int32), [len(a)]) for a in arrays)], schema.names)

    rows = chunks.select(terms(F.coalesce(F.col("text"), F.lit(""))).alias("_terms"), *columns).mapInArrow(make, schema)
    return Index(rows, columns)


def _spans(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and where each row's begin (one more at the end)."""
    return lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))


def term_counts(index: Index, vocabulary: list[str]) -> tuple[dict[str, int], int, float]:
    """Chunks that hold each term of ``vocabulary``, chunks, and terms a chunk; each task sends a row a term that it has."""
    wanted = pa.array(vocabulary, pa.string())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(wanted) + 1, np.int64), 0, 0
        for batch in batches:
            own, at = _spans(batch.column(0))
            ends = batch.column(1).flatten().to_numpy()
            first = np.append(0, ends[:-1]) if len(ends) else ends
            first[at[:-1][at[:-1] < at[1:]]] = 0
            df += np.bincount(pc.index_in(own, wanted).fill_null(len(wanted)).to_numpy(), ends - first, len(wanted) + 1).astype(np.int64)
            words = batch.column(2).flatten()
            n, total = n + len(words), total + (pc.sum(words).as_py() or 0)
        met = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([wanted.take(pa.array(met)), pa.array(["", " "])]), pa.array(np.append(df[met], [n, total]))], ["term", "n"])

    rows = index.rows.select("terms", "ends", "words").mapInArrow(count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a query term
    sums = {r["term"]: r["n"] for r in rows}
    n, total = sums.pop("", 0) or 0, sums.pop(" ", 0) or 0
    return sums, n, (total / n if n else 0.0)


class Scorer:
    """The k best chunks of each query of a block, shard by shard."""

    def __init__(self, matrix: np.ndarray, words: list[str], avgdl: float, k: int, k1: float, b: float):
        self.matrix, self.words, self.avgdl, self.k, self.k1, self.b = matrix, pa.array(words, pa.string()), avgdl, k, k1, b
        #: scores of the k best so far, at six decimals, and counts of pairs of query and block, and of query and shard: all, and those looked into
        self.best = np.full((len(matrix), k), -np.inf)
        self.work = np.zeros(4, np.int64)

    def _part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        norm = 1 - self.b + self.b * np.maximum(dl, 1) / self.avgdl if self.avgdl > 0 else 1.0
        return tf * (self.k1 + 1) / (tf + self.k1 * norm)

    def run(self, arrays: dict[str, pa.ListArray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Shard (a row), queries, slots and scores that may be among the best."""
        own, at = _spans(arrays["terms"])
        ends, most, least = (arrays[c].flatten().to_numpy() for c in ("ends", "most", "least"))
        postings = np.append(0, np.cumsum(arrays["slots"].value_lengths().to_numpy().astype(np.int64)))
        chunks = np.append(0, np.cumsum(arrays["words"].value_lengths().to_numpy().astype(np.int64)))
        slots, tf, words = (arrays[c].flatten().to_numpy() for c in ("slots", "tf", "words"))
        number = pc.index_in(own, self.words).fill_null(-1).to_numpy().astype(np.int64)
        known = np.flatnonzero(number >= 0)
        shard = np.searchsorted(at, known, "right") - 1
        bound = np.zeros((len(self.words), len(at) - 1))
        bound[number[known], shard] = self._part(most[known], least[known])
        bounds = np.round(self.matrix @ bound, 6)
        has = (self.matrix > 0).astype(np.float64) @ (bound > 0)
        self.work += [int(has.sum()), 0, int((has > 0).sum()), 0]
        for s in np.argsort(-bounds.max(axis=0, initial=0), kind="stable").tolist():
            q = np.flatnonzero((has[:, s] > 0) & (bounds[:, s] >= self.best[:, -1] - 1e-6))
            if not len(q):
                continue
            self.work += [0, int(has[q, s].sum()), 0, len(q)]
            mine = known[np.searchsorted(shard, s) : np.searchsorted(shard, s, "right")]
            first = np.where(mine > at[s], ends[np.maximum(mine - 1, 0)], 0)
            n = ends[mine] - first
            total = np.cumsum(n)
            p = postings[s] + np.arange(int(total[-1])) + np.repeat(first - (total - n), n)
            size = words[chunks[s] : chunks[s + 1]]
            weights = np.zeros((len(mine), len(size)))
            weights[np.repeat(np.arange(len(mine)), n), slots[p]] = self._part(tf[p], size[slots[p]])
            scores = self.matrix[np.ix_(q, number[mine])] @ weights
            rounded = np.where(scores > 0, np.round(scores, 6), -np.inf)
            both = np.concatenate([self.best[q], rounded], axis=1)
            self.best[q] = -np.sort(np.partition(-both, self.k - 1, axis=1)[:, : self.k], axis=1)
            i, j = np.nonzero((scores > 0) & (rounded >= self.best[q, -1][:, None]))
            yield s, q[i], j, scores[i, j]


@dataclass(frozen=True)
class Search:
    """``hits``: query_id, the columns of the index, score and rank; ``counts``: a row a task with what it looked into."""

    hits: DataFrame
    counts: DataFrame

    def work(self) -> DataFrame:
        """One row ``n_blocks, n_read, n_shards, n_shards_read``: over all queries, the blocks of their terms and the shards that have any, and those of them that were scored."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
        return self.counts.agg(*map(total, ("n_blocks", "n_read", "n_shards", "n_shards_read")))


def search(index: Index, queries: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, tie: Sequence[str] = ("chunk_id",), block: int = 512) -> Search:
    """BM25 over an index for queries (query_id, text), a stated set; ties of the score at six decimals are ranked by ``tie`` columns of the index."""
    if missing := set(tie) - set(index.columns):
        raise ValueError(f"the index does not keep {sorted(missing)}")
    id_type, columns = arrow_type(queries, "query_id"), index.columns
    kinds = [T.StructField(c, index.rows.schema[c].dataType.elementType) for c in columns]
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *kinds, T.StructField("score", T.DoubleType())])
    hits = counts = None
    for asked in _asked(queries, block):
        df, n, avgdl = term_counts(index, sorted({t for own in asked.values() for t in own}))
        number = {t: i for i, t in enumerate(df)}
        ids, matrix = list(asked), np.zeros((len(asked), len(df)))
        for q, own in enumerate(asked.values()):
            for t, c in own.items():
                if t in number:
                    matrix[q, number[t]] = c * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))

        def score(batches: Iterable[pa.RecordBatch], ids=ids, words=list(df), matrix=matrix, avgdl=avgdl, counted=False) -> Iterator[pa.RecordBatch]:
            own = Scorer(matrix, words, avgdl, k, k1, b)
            for batch in batches:
                arrays = {name: batch.column(batch.schema.get_field_index(name)) for name in _ARRAYS}
                names = [_spans(batch.column(c)) for c in range(len(columns))] if not counted else []
                for s, q, slot, scores in own.run(arrays):
                    if not counted:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(q)), *(x.take(pa.array(at[s] + slot)) for x, at in names), pa.array(scores)], schema.names)
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in own.work.tolist()], ["n_blocks", "n_read", "n_shards", "n_shards_read"])

        def count(batches: Iterable[pa.RecordBatch], score=score) -> Iterator[pa.RecordBatch]:
            return score(batches, counted=True)

        found, work = index.rows.mapInArrow(score, schema), index.rows.mapInArrow(count, "n_blocks bigint, n_read bigint, n_shards bigint, n_shards_read bigint")
        hits, counts = (found, work) if hits is None else (hits.unionByName(found), counts.unionByName(work))
    return Search(top_k(hits, k, *tie).select("query_id", *columns, "score", "rank"), counts)
