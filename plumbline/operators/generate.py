"""Generators: items (query_id, question) and hits (query_id, rank, text) to answers, one row a query."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import SENTINEL, first_sentence
from plumbline.operators import store

#: Fixed value: the prompt.
PROMPT = """\
You are answering a question using only the provided context.

Rules:
- If the answer is in the context, give it concisely.
- If the context does not contain the answer, respond with: INSUFFICIENT_CONTEXT
- Do not use information outside the provided context.

Context:
{context}

Question: {question}

Answer:"""

#: USD for a million tokens of input and of output.
RATES_VERSION = "2026-05"
RATES = (
    ("claude-haiku-4-5", 1.00, 5.00),
    ("claude-sonnet-4-6", 3.00, 15.00),
    ("claude-opus-4-7", 15.00, 75.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-5-mini", 0.25, 1.00),
    ("gpt-5", 5.00, 20.00),
    ("gemini-1.5-flash", 0.075, 0.30),
    ("gemini-1.5-pro", 1.25, 5.00),
    ("gemini-3.1", 2.50, 10.00),
    ("Qwen/Qwen3.5-7B-Instruct", 0.0, 0.0),
    ("Qwen/Qwen3.5-72B-Instruct", 0.0, 0.0),
)
CONTEXT_CHARS = 8000


def _top(items: DataFrame, hits: DataFrame, text: Column, fallback: str) -> DataFrame:
    first = hits.where("rank = 0").select("query_id", text.alias("_answer"))
    kept = [c for c in items.columns if c != "text"]
    return items.join(first, "query_id", "left").select(*kept, F.coalesce("_answer", F.lit(fallback)).alias("text"))


def echo(items: DataFrame, hits: DataFrame, fallback: str = SENTINEL) -> DataFrame:
    """The text of the first hit; queries without hits get ``fallback``."""
    return _top(items, hits, F.col("text"), fallback)


def extractive(items: DataFrame, hits: DataFrame, fallback: str = SENTINEL) -> DataFrame:
    """The first sentence of the first hit."""
    return _top(items, hits, first_sentence(F.col("text")), fallback)


def context(hits: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``query_id, context``: numbered hits in order, as many as fit before the first one that does not."""
    block = F.concat(F.lit("["), F.col("rank") + 1, F.lit("] "), F.col("text"))
    order = Window.partitionBy("query_id").orderBy("rank")
    before = F.coalesce(F.sum(F.length("block") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = hits.select("query_id", "rank", block.alias("block")).withColumn("ok", (before + F.length("block") <= max_chars).cast("int"))
    prefix = fits.withColumn("ok", F.min("ok").over(order))
    # hits of a query are at most the k of the ranking
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("ok") == 1, F.struct("rank", "block")))), lambda x: x["block"])
    return prefix.groupBy("query_id").agg(F.array_join(listed, "\n\n").alias("context"))


def prompts(items: DataFrame, hits: DataFrame, template: str = "default", question: str = "question", max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``items`` with the prompt; a query without hits has an empty context."""
    template = PROMPT if template == "default" else template
    before, _, after = template.partition("{context}")

    def filled(part: str) -> Column:
        return F.replace(F.lit(part), F.lit("{question}"), F.col(question))

    joined = items.join(context(hits, max_chars), "query_id", "left")
    text = F.concat(filled(before), F.coalesce("context", F.lit("")), filled(after)) if "{context}" in template else filled(template)
    return joined.withColumn("prompt", text).drop("context")


def with_cost(answers: DataFrame, rates: Sequence[tuple[str, float, float]] = RATES, model: str = "model") -> DataFrame:
    """``answers`` (model, prompt_tokens, completion_tokens) with cost_usd and unknown_model_rate.

    Tokens below 0 count as 0; a model without a rate costs 0 and is flagged.
    The rates are a literal table of a few rows.
    """
    table = answers.sparkSession.createDataFrame(list(rates), "_model string, _in double, _out double")
    joined = answers.join(F.broadcast(table), F.col(model) == F.col("_model"), "left")
    tokens = [F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for c in ("prompt_tokens", "completion_tokens")]
    cost = (tokens[0] * F.coalesce("_in", F.lit(0.0)) + tokens[1] * F.coalesce("_out", F.lit(0.0))) / F.lit(1e6)
    return joined.withColumn("cost_usd", cost).withColumn("unknown_model_rate", F.col("_model").isNull()).drop("_model", "_in", "_out")


#: A client takes prompt and options and gives text, prompt tokens and completion tokens.
Client = Callable[[str, dict[str, Any]], tuple[str, int, int]]


def by_model(prompted: DataFrame, connect: Callable[[], Client], options: dict[str, Any], family: str, answers: str = "") -> DataFrame:
    """Answers of a language model to ``prompt``; ``connect`` is called once for each task.

    ``answers``, or the session's setting, names a folder of answers that were
    given before, by prompt, seed, family and options: they are not asked for again.
    """
    if path := answers or store.folder(prompted, "generated"):
        seed = F.col("seed") if "seed" in prompted.columns else F.lit(0)
        key = store.key_of(F.lit(family), F.lit(json.dumps(options, sort_keys=True)), seed, F.col("prompt"))
        rows = store.through(prompted.drop("text"), key, path, lambda todo: _asked(todo, connect, options).select(*todo.columns[:-1], "_key", "text", "prompt_tokens", "completion_tokens", "latency_ms"))
    else:
        rows = _asked(prompted, connect, options)
    return with_cost(rows.drop("prompt").withColumn("model", F.lit(options["model"])).withColumn("family", F.lit(family)))


def _asked(prompted: DataFrame, connect: Callable[[], Client], options: dict[str, Any]) -> DataFrame:
    """``prompted`` with text, tokens and latency of each answer."""
    from pyspark.sql import types as T

    names = [c for c in prompted.columns if c != "text"]
    at = names.index("prompt")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = connect()
        for b in batches:
            seeds = b.column(names.index("seed")).to_pylist() if "seed" in names else [0] * b.num_rows
            got = []
            for prompt, seed in zip(b.column(at).to_pylist(), seeds, strict=True):
                began = time.perf_counter()
                text, used, made = client(prompt or "", options | {"seed": seed})
                got.append((text.strip(), int(used or 0), int(made or 0), (time.perf_counter() - began) * 1000))
            text, used, made, ms = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(text, pa.string()), pa.array(used, pa.int32()), pa.array(made, pa.int32()), pa.array(ms, pa.float64())],
                [*names, "text", "prompt_tokens", "completion_tokens", "latency_ms"])

    added = [T.StructField("text", T.StringType()), T.StructField("prompt_tokens", T.IntegerType()), T.StructField("completion_tokens", T.IntegerType()), T.StructField("latency_ms", T.DoubleType())]
    schema = T.StructType([*(prompted.schema[n] for n in names), *added])
    return prompted.select(*names).mapInArrow(run, schema)


def anthropic_client() -> Client:
    """A client of the Messages API; needs the ``anthropic`` package on the executors."""
    import anthropic

    api = anthropic.Anthropic()

    def call(prompt: str, o: dict[str, Any]) -> tuple[str, int, int]:
        r = api.messages.create(model=o["model"], max_tokens=o["max_tokens"], temperature=o["temperature"], messages=[{"role": "user", "content": prompt}])
        return "".join(b.text for b in r.content if getattr(b, "type", "") == "text"), r.usage.input_tokens, r.usage.output_tokens

    return call


def openai_client() -> Client:
    """A client of the Chat Completions API, or of a local server through its base URL; needs the ``openai`` package."""
    import openai

    api = openai.OpenAI()

    def call(prompt: str, o: dict[str, Any]) -> tuple[str, int, int]:
        r = api.chat.completions.create(model=o["model"], max_tokens=o["max_tokens"], temperature=o["temperature"], seed=o["seed"], messages=[{"role": "user", "content": prompt}])
        return r.choices[0].message.content or "", r.usage.prompt_tokens, r.usage.completion_tokens

    return call
