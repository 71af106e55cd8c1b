"""Pipelines: chunker, retriever, reranker and generator composed into one plan for all queries at once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import chunkers, generate, metrics, repro, rerank, retrieval, rouge, stats
from plumbline.plans.registry import fingerprint, make, register
from plumbline.sources.tasks import Task, metric_names


# The names of components and of their fields, and the defaults of these, are those that YAML files rely on


@register("chunker", "recursive")
@dataclass(frozen=True)
class Recursive:
    chunk_size: int = 1000
    overlap: int = 200
    separators: tuple[str, ...] = chunkers.SEPARATORS

    def __post_init__(self) -> None:
        chunkers.check_overlap(self.chunk_size, self.overlap)

    def run(self, documents: DataFrame) -> DataFrame:
        return chunkers.chunk_recursive(documents, self.chunk_size, self.overlap, self.separators)


@register("chunker", "fixed")
@dataclass(frozen=True)
class Fixed:
    chunk_size: int = 200
    overlap: int = 40

    def __post_init__(self) -> None:
        chunkers.check_overlap(self.chunk_size, self.overlap)

    def run(self, documents: DataFrame) -> DataFrame:
        return chunkers.chunk_fixed(documents, self.chunk_size, self.overlap)


@register("chunker", "sentence")
@dataclass(frozen=True)
class Sentence:
    chunk_size: int = 800
    overlap_sentences: int = 1

    def run(self, documents: DataFrame) -> DataFrame:
        return chunkers.chunk_sentence(documents, self.chunk_size, self.overlap_sentences)


#: The column that tells corpora apart where several are indexed at once.
SCOPE = "task_id"


#: Hits that score the same are ranked by the place of their document and chunk, where documents have an ordinal.
def _tie(chunks: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    order = ("ordinal", "position") if "ordinal" in chunks.columns else ("chunk_id",)
    return order, tuple(c for c in order if c != "chunk_id")


@register("retriever", "bm25")
@dataclass(frozen=True)
class BM25:
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 50

    def run(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        tie, keep = _tie(chunks)
        if SCOPE in chunks.columns:
            return retrieval.bm25_by_scope(chunks, queries, k, self.k1, self.b, SCOPE, tie, keep)
        return retrieval.bm25(chunks, queries, k, self.k1, self.b, tie, keep)


#: Encoders by model name: a function of lists of texts that gives a matrix.
ENCODERS: dict[str, Callable[[str], Callable[[list[str]], Any]]] = {}


def sentence_encoder(model: str) -> Callable[[list[str]], Any]:
    """An encoder of the ``sentence_transformers`` package, loaded when it is first called."""
    loaded: list[Any] = []

    def encode(texts: list[str]) -> Any:
        if not loaded:
            from sentence_transformers import SentenceTransformer

            loaded.append(SentenceTransformer(model))
        return loaded[0].encode(texts, convert_to_numpy=True)

    return encode


@register("retriever", "dense")
@dataclass(frozen=True)
class Dense:
    model: str = "BAAI/bge-small-en-v1.5"
    normalize: bool = True
    batch_size: int = 32
    top_k: int = 50

    def run(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        encoder = ENCODERS.get(self.model, sentence_encoder)(self.model)
        scope = [SCOPE] if SCOPE in chunks.columns else []
        vectors = retrieval.embed(chunks.select("chunk_id", "text", *scope), encoder, "text", self.normalize, self.batch_size)
        asked = retrieval.embed(queries.select("query_id", "text", *scope), encoder, "text", self.normalize, self.batch_size)
        return retrieval.dense(vectors, asked, k, scope=SCOPE if scope else None)


@register("retriever", "hybrid")
@dataclass(frozen=True)
class Hybrid:
    sparse: dict = field(default_factory=lambda: {"type": "bm25"})
    dense: dict = field(default_factory=lambda: {"type": "dense"})
    fusion: str = "rrf"
    rrf_k: int = 60
    top_k: int = 50

    def __post_init__(self) -> None:
        if self.fusion != "rrf" or self.sparse.get("type") != "bm25" or self.dense.get("type") != "dense":
            raise ValueError("hybrid retrieval fuses bm25 and dense by rrf")

    def run(self, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        n = retrieval.oversample(k, self.top_k)
        both = [make("retriever", c).run(chunks, queries, n) for c in (self.sparse, self.dense)]
        return retrieval.rrf(both, k, self.rrf_k)


@register("reranker", "identity")
@dataclass(frozen=True)
class Identity:
    top_k: int = 10

    def run(self, hits: DataFrame, k: int) -> DataFrame:
        return rerank.identity(hits, k)


@register("reranker", "lexical-overlap")
@dataclass(frozen=True)
class LexicalOverlap:
    top_k: int = 10

    def run(self, hits: DataFrame, k: int) -> DataFrame:
        return rerank.lexical_overlap(hits, k)


def cross_encoder(model: str) -> Callable[[list[tuple[str, str]]], Iterable[float]]:
    """Scores of pairs by the ``sentence_transformers`` package, loaded when first called."""
    loaded: list[Any] = []

    def score(pairs: list[tuple[str, str]]) -> Iterable[float]:
        if not loaded:
            from sentence_transformers import CrossEncoder

            loaded.append(CrossEncoder(model))
        return loaded[0].predict(pairs)

    return score


@register("reranker", "cross-encoder")
@dataclass(frozen=True)
class CrossEncoderReranker:
    model: str = "BAAI/bge-reranker-base"
    batch_size: int = 32
    top_k: int = 10

    def run(self, hits: DataFrame, k: int) -> DataFrame:
        return rerank.cross_encoder(hits, ENCODERS.get(self.model, cross_encoder)(self.model), k, batch=self.batch_size)


@register("generator", "echo")
@dataclass(frozen=True)
class Echo:
    fallback: str = generate.SENTINEL

    def run(self, items: DataFrame, hits: DataFrame) -> DataFrame:
        return generate.echo(items, hits, self.fallback)


@register("generator", "extractive")
@dataclass(frozen=True)
class Extractive:
    fallback: str = generate.SENTINEL

    def run(self, items: DataFrame, hits: DataFrame) -> DataFrame:
        return generate.extractive(items, hits, self.fallback)


#: Makers of clients of language models by family; tests put stubs here.
CLIENTS: dict[str, Callable[[], generate.Client]] = {"anthropic": generate.anthropic_client, "openai": generate.openai_client}


@dataclass(frozen=True)
class _Model:
    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 512
    prompt_template: str = "default"

    def run(self, items: DataFrame, hits: DataFrame) -> DataFrame:
        options = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens}
        return generate.by_model(generate.prompts(items, hits, self.prompt_template), CLIENTS[self.type], options, self.type)


@register("generator", "anthropic")
@dataclass(frozen=True)
class Anthropic(_Model):
    model: str = "claude-haiku-4-5"


@register("generator", "openai")
@dataclass(frozen=True)
class OpenAI(_Model):
    model: str = "gpt-4o-mini"


@dataclass(frozen=True)
class Result:
    """What a pipeline makes of all queries: hits before and after reranking, and answers."""

    retrieved: DataFrame
    reranked: DataFrame
    answers: DataFrame


@dataclass
class Pipeline:
    name: str
    chunker: Any
    retriever: Any
    reranker: Any
    generator: Any
    retriever_top_k: int = 50
    reranker_top_k: int = 10
    chunks: DataFrame | None = None

    def index(self, documents: DataFrame) -> "Pipeline":
        """Chunk a corpus, or several with a task_id; chunks are kept (in memory, or on disk where they don't fit) for all queries."""
        if self.chunks is not None:
            self.chunks.unpersist()
        self.chunks = self.chunker.run(documents).persist()
        return self

    def answer(self, items: DataFrame, seeds: Sequence[int] = (0,)) -> Result:
        """Answers to all items (query_id or item_id, question).

        Retrieval does not depend on the seed, so it is done once for all seeds.
        """
        if self.chunks is None:
            raise RuntimeError("index a corpus before asking")
        if "query_id" not in items.columns:
            items = items.withColumn("query_id", F.col("item_id"))
        scope = [SCOPE] if SCOPE in self.chunks.columns else []
        queries = items.select("query_id", F.col("question").alias("text"), *scope)
        found = self.retriever.run(self.chunks, queries, self.retriever_top_k)
        texts = self.chunks.select("chunk_id", "doc_id", "text", *scope)
        asked = queries.select("query_id", F.col("text").alias("query_text"), *scope)
        hits = found.select("query_id", "chunk_id", "score", "rank").join(asked, "query_id").join(texts, ["chunk_id", *scope]).drop(*scope)
        reranked = self.reranker.run(hits, self.reranker_top_k)
        seeded = items.select("query_id", "question").crossJoin(F.broadcast(items.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")))  # the seeds are a stated list
        answers = self.generator.run(seeded, reranked)
        for c, v in (("prompt_tokens", F.lit(0)), ("completion_tokens", F.lit(0)), ("cost_usd", F.lit(0.0)), ("latency_ms", F.lit(0.0)), ("family", F.lit(self.generator.type))):
            if c not in answers.columns:
                answers = answers.withColumn(c, v)
        return Result(hits, reranked, answers.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")))

    def fingerprint(self) -> dict[str, Any]:
        parts = {p.stage: fingerprint(p) for p in (self.chunker, self.retriever, self.reranker, self.generator)}
        return {"name": self.name, **parts, "retriever_top_k": self.retriever_top_k, "reranker_top_k": self.reranker_top_k}


_FIELDS = {"name", "chunker", "retriever", "reranker", "generator", "retriever_top_k", "reranker_top_k"}


def compose(config: dict[str, Any]) -> Pipeline:
    """A pipeline from its configuration, with or without the outer key ``pipeline``."""
    config = config.get("pipeline", config)
    if unknown := sorted(set(config) - _FIELDS):
        raise ValueError(f"a pipeline has no fields {unknown}; it has {sorted(_FIELDS)}")
    if missing := sorted({"name", "chunker", "retriever", "generator"} - set(config)):
        raise ValueError(f"the pipeline lacks {missing}")
    tops = {k: config.get(k, d) for k, d in (("retriever_top_k", 50), ("reranker_top_k", 10))}
    for k, v in tops.items():
        if not isinstance(v, int) or v < 1:
            raise ValueError(f"{k} must be a whole number from 1, not {v!r}")
    parts = {s: make(s, config.get(s, {"type": "identity"})) for s in ("chunker", "retriever", "reranker", "generator")}
    return Pipeline(config["name"], **parts, **tops)


def compose_yaml(text: str) -> Pipeline:
    import yaml

    config = yaml.safe_load(text)
    if config is None:
        raise ValueError("the pipeline's YAML is empty")
    return compose(config)


def compose_path(path: str) -> Pipeline:
    with open(path, encoding="utf-8") as f:
        return compose_yaml(f.read())


def scores(result: Result, items: DataFrame, names: Sequence[str]) -> DataFrame:
    """``query_id, seed, metric, score`` of the named metrics; null where a metric does not apply."""
    by_text = [n for n in names if n in metrics.TEXT_METRICS]
    rows = result.answers.select("query_id", "seed", "text").join(items.drop("text"), "query_id")
    if "rouge_l" in names:
        rows = rouge.with_rouge_l(rows)
    out = rows.select("query_id", "seed", *[metrics.TEXT_METRICS[n]().alias(n) for n in by_text], *(["rouge_l"] if "rouge_l" in names else []))
    ranked = [n for n in names if n not in metrics.TEXT_METRICS and n != "rouge_l"]
    for k, suffix in sorted({(int(n.split("@")[1].removesuffix("_reranked")), "_reranked" if n.endswith("_reranked") else "") for n in ranked}):
        hits = result.reranked if suffix else result.retrieved
        out = out.join(metrics.retrieval_scores(items, hits, k, suffix), "query_id", "left")
    listed = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("double").alias("score")) for n in names])
    return out.select("query_id", "seed", F.explode(listed).alias("m")).select("query_id", "seed", "m.metric", "m.score")


@dataclass
class Runner:
    """Runs a pipeline over tasks: answers, scores, means with intervals, costs and latencies."""

    pipeline: Pipeline
    seeds: tuple[int, ...] = (0,)
    split: str = "public"
    resamples: int = stats.RESAMPLES
    #: Who judges whether answers follow from their contexts; without judges ``faithfulness`` is not reported.
    judges: tuple[metrics.Judge, ...] = ()

    def run_task(self, spark: SparkSession, task: Task, names: Sequence[str] | None = None) -> dict[str, Any]:
        return self.run(spark, [task], names)[task.spec.id]

    def run(self, spark: SparkSession, tasks: Iterable[Task], names: Sequence[str] | None = None) -> dict[str, dict[str, Any]]:
        """All tasks and seeds in one plan and one action: the task is part of every key.

        ``wall_time_s`` is that of all tasks together.
        """
        began = time.perf_counter()
        listed = list(tasks)
        if not listed:
            return {}
        wanted = {t.spec.id: [*(names or metric_names(t.spec)), *(["faithfulness"] if self.judges else [])] for t in listed}
        corpus = _together(t.corpus(spark).withColumn(SCOPE, F.lit(t.spec.id)) for t in listed)
        items = _together(t.items(spark, self.split).withColumn(SCOPE, F.lit(t.spec.id)) for t in listed)
        items = items.withColumn("query_id", F.concat_ws("/", SCOPE, "item_id"))
        result = self.pipeline.index(corpus).answer(items, self.seeds)
        # what several parts of the plan read is kept until its rows are there
        held = Result(result.retrieved.persist(), result.reranked.persist(), result.answers.persist())
        scored = scores(held, items, list(dict.fromkeys(n for own in wanted.values() for n in own if n != "faithfulness")))
        if self.judges:
            judged = metrics.faithfulness(held.answers, generate.context(held.reranked), list(self.judges))
            scored = scored.unionByName(judged.select("query_id", "seed", F.lit("faithfulness").alias("metric"), F.col("faithfulness").alias("score")))
        of = items.select("query_id", SCOPE, "item_id", "ordinal")
        reported = spark.createDataFrame([(t, n) for t, own in wanted.items() for n in own], f"{SCOPE} string, metric string")
        scored = scored.join(of, "query_id").join(F.broadcast(reported), [SCOPE, "metric"])  # a row a task and metric
        # intervals are drawn by place, so items stand in the task's own order
        means = scored.where("score is not null").groupBy(SCOPE, "metric", "item_id", "ordinal").agg(F.avg("score").alias("score"))
        parts = [_rows("metric", stats.with_intervals(means, [SCOPE, "metric"], self.resamples, order=("ordinal", "item_id")), "metric", "mean", "ci_lo", "ci_hi", "n")]
        flat = held.answers.join(of.select("query_id", SCOPE), "query_id").select(SCOPE, F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in ("cost_usd", "latency_ms")])).alias("x")).select(SCOPE, "x.*")
        # a task's answers are thousands, as its scores are
        at = F.bround(F.lit(0.95) * (F.size("x") - 1), 0).cast("int")
        ranked = flat.groupBy(SCOPE, "what").agg(F.avg("v").alias("mean"), F.sort_array(F.collect_list("v")).alias("x")).withColumn("p95", F.get("x", at))
        parts.append(_rows("cost", ranked, "what", "mean", "p95"))
        every = _together(t.items(spark, "all").withColumn(SCOPE, F.lit(t.spec.id)) for t in listed)
        parts.append(_rows("hash", repro.task_data_hashes(every, corpus), "task_data_hash"))
        parts.append(_rows("items", items.groupBy(SCOPE).agg(F.count(F.lit(1)).alias("n")), None, n="n"))
        found: dict[tuple[str, str], dict[str, Any]] = {}
        for r in _together(parts).collect():  # a row a task and metric, and four a task
            found.setdefault((r[SCOPE], r["kind"]), {})[r["name"]] = r
        for part in (held.retrieved, held.reranked, held.answers):
            part.unpersist()
        took, zero, out = time.perf_counter() - began, {"mean": 0.0, "p95": 0.0}, {}
        for t in wanted:
            rows, ops = found.get((t, "metric"), {}), {n: {"mean": r["a"], "p95": r["b"]} for n, r in found.get((t, "cost"), {}).items()}
            digest = next(iter(found.get((t, "hash"), {})), None)
            out[t] = {
                "task_data_hash": digest, "n_items": next((r["n"] for r in found.get((t, "items"), {}).values()), 0), "seeds": list(self.seeds),
                "metrics": {n: {"mean": rows[n]["a"], "ci_95": [rows[n]["b"], rows[n]["c"]], "n": rows[n]["n"]} for n in wanted[t] if n in rows},
                "cost_per_query_usd": ops.get("cost_usd", zero), "latency_ms": ops.get("latency_ms", zero), "wall_time_s": took,
            }
        return out


def _together(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def _rows(kind: str, rows: DataFrame, name: str | None, a: str | None = None, b: str | None = None, c: str | None = None, n: str | None = None) -> DataFrame:
    """Rows of any part of a result in one shape."""
    column = lambda x, t: (F.col(x) if x else F.lit(None)).cast(t)
    return rows.select(SCOPE, F.lit(kind).alias("kind"), column(name, "string").alias("name"), *[column(x, "double").alias(y) for x, y in ((a, "a"), (b, "b"), (c, "c"))], column(n, "bigint").alias("n"))
