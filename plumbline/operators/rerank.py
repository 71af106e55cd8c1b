"""Rerankers: hits (query_id, chunk_id, score, rank) to fewer hits with new ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import jaccard, overlap_terms


def identity(hits: DataFrame, k: int = 10) -> DataFrame:
    """The first k hits, with ranks that have no gaps."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1
    return hits.withColumn("rank", rank).where(F.col("rank") < k)


def by_score(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Ranked anew by ``score``, which replaces the old one; ties keep the order of retrieval."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("_old"))) - 1
    return hits.withColumn("_old", F.col("rank")).withColumn("score", score).withColumn("rank", rank).drop("_old").where(F.col("rank") < k)


def lexical_overlap(hits: DataFrame, k: int = 10, query: str = "query_text", text: str = "text") -> DataFrame:
    """By the Jaccard similarity of the words of query and chunk; hits carry both texts."""
    return by_score(hits, jaccard(overlap_terms(F.col(query)), overlap_terms(F.col(text))), k)


def cross_encoder(hits: DataFrame, model: Callable[[list[tuple[str, str]]], Iterable[float]], k: int = 10, query: str = "query_text", text: str = "text", batch: int = 32) -> DataFrame:
    """By a model's score of (query, chunk) pairs, in Arrow batches; the model is loaded once a worker."""
    from pyspark.sql import types as T

    fields = [f for f in hits.schema.fields if f.name != "score"]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(*(b.column(n).to_pylist() for n in ("__q", "__t")), strict=True))
            scores = [float(s) for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(scores, pa.float64())], [*names, "score"])

    scored = hits.select(*names, F.col(query).alias("__q"), F.col(text).alias("__t")).mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    return by_score(scored, F.col("score"), k)
