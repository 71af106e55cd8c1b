"""Reproducibility: hashes of tasks, pipelines and judges, and checks of submissions.

Hashes of a pipeline, of judges and of configurations are over a few values
and are made by the driver; those of a task are over its tables and are made
in Spark.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    """Keys in order, no spaces, ASCII escapes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def canonical_yaml(text: str) -> str:
    """The document with keys in order and without comments."""
    import yaml

    return yaml.safe_dump(yaml.safe_load(text), sort_keys=True, default_flow_style=False, allow_unicode=True)


def _sha256(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def judge_fingerprint(judges: Iterable[Mapping[str, str]] | None) -> str:
    """Of name, model and prompt hash of the judges, by name; ``none`` without judges."""
    listed = sorted(({k: j[k] for k in ("name", "model", "prompt_hash")} for j in judges or ()), key=lambda j: j["name"])
    return _sha256(canonical_json(listed)) if listed else "none"


def pipeline_hash(yaml_text: str, task_data_hashes: Mapping[str, str], judges: str = "none", seeds: Iterable[int] = (0,), version: str = "") -> str:
    """Of everything that a run's results depend on."""
    parts = {"yaml": canonical_yaml(yaml_text), "task_data_hashes": dict(task_data_hashes), "judge_fingerprint": judges, "version": version, "seeds": sorted(map(int, seeds))}
    return _sha256(canonical_json(parts))


def component_fingerprint(stage: str, name: str, config: Mapping[str, Any]) -> dict[str, Any]:
    return {"stage": stage, "name": name, **config}


def canonical_task_json(spec: Mapping[str, Any]) -> str:
    return canonical_json(dict(spec))


def item_lines(items: DataFrame, *keys: str) -> DataFrame:
    """``keys, id, line`` of each item of (item_id, question, gold_answers, gold_passages)."""

    def listed(c: str):
        return F.coalesce(F.concat(F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(","))), "")), F.lit(""))

    line = F.concat(F.col("item_id"), F.lit("|"), F.col("question"), F.lit("|"), listed("gold_answers"), F.lit(";"), listed("gold_passages"), F.lit("\n"))
    return items.select(*keys, F.col("item_id").alias("id"), line.alias("line"))


def corpus_lines(documents: DataFrame, *keys: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("string")
    return documents.select(*keys, doc_id.alias("id"), F.concat(doc_id, F.lit("|"), F.sha2(F.col("text").cast("binary"), 256), F.lit("\n")).alias("line"))


def task_data_hash(task_id: str, items: DataFrame, documents: DataFrame) -> DataFrame:
    """One row ``task_id, task_data_hash``, over the items and documents of one task in order of their ids.

    Texts are hashed where they lie, and lines are sorted by ranges.  One
    digest needs all lines in order, so one task reads the sorted ranges one
    after the other and holds no more than a batch.
    """
    spark = items.sparkSession
    heads = spark.createDataFrame([(0, "", f"task_id:{task_id}\nitems:\n"), (2, "", "corpus:\n")], "part int, id string, line string")
    lines = [heads, item_lines(items).select(F.lit(1).alias("part"), "id", "line"), corpus_lines(documents).select(F.lit(3).alias("part"), "id", "line")]

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = hashlib.sha256()
        for batch in batches:
            # a line with a null part is null, and stands for nothing
            whole.update("".join(x for x in batch.column(0).to_pylist() if x is not None).encode())
        yield pa.RecordBatch.from_arrays([pa.array([task_id]), pa.array([whole.hexdigest()])], ["task_id", "task_data_hash"])

    every = lines[0].unionByName(lines[1]).unionByName(lines[2])
    return every.orderBy("part", "id", "line").select("line").coalesce(1).mapInArrow(digest, "task_id string, task_data_hash string")


def task_data_hashes(items: DataFrame, documents: DataFrame) -> DataFrame:
    """``task_id, task_data_hash`` of each task that has items, in one plan; items and documents have a task_id.

    A task's lines are sorted where they meet, spilled as they need be, and
    its digest is made from a stream of them.
    """
    named = [items.select("task_id").distinct().select("task_id", *x) for x in ((F.lit(0).alias("part"), F.lit("").alias("id"), F.concat(F.lit("task_id:"), "task_id", F.lit("\nitems:\n")).alias("line")), (F.lit(2).alias("part"), F.lit("").alias("id"), F.lit("corpus:\n").alias("line")))]
    own = item_lines(items, "task_id").select("task_id", F.lit(1).alias("part"), "id", "line")
    texts = corpus_lines(documents, "task_id").select("task_id", F.lit(3).alias("part"), "id", "line")
    every = named[0].unionByName(named[1]).unionByName(own).unionByName(texts)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for task, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if task != now:
                    if whole:
                        done.append((now, whole.hexdigest()))
                    now, whole = task, hashlib.sha256()
                whole.update((line or "").encode())
        if whole:
            done.append((now, whole.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["task_id", "task_data_hash"])

    return every.repartition("task_id").sortWithinPartitions("task_id", "part", "id", "line").select("task_id", "line").mapInArrow(digest, "task_id string, task_data_hash string")


def verify_run(submitted: DataFrame, rerun: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``task_id, metric, reason`` of what a rerun does not bear out; no rows: verified.

    ``submitted``: task_id, metric, ci_lo, ci_hi; ``rerun``: task_id, metric, mean.
    A task that is missing is one reason, with a null metric.
    """
    tasks = rerun.select("task_id").distinct().withColumn("_task", F.lit(True))
    got = rerun.select("task_id", "metric", F.col("mean").alias("_mean"))
    joined = submitted.join(tasks, "task_id", "left").join(got, ["task_id", "metric"], "left")
    outside = (F.col("_mean") < F.col("ci_lo") - tolerance) | (F.col("_mean") > F.col("ci_hi") + tolerance)
    where = F.concat(F.col("task_id"), F.lit("/"), F.col("metric"))
    reason = (
        F.when(F.col("_task").isNull(), F.concat(F.col("task_id"), F.lit(": re-run missing")))
        .when(F.col("_mean").isNull(), F.concat(where, F.lit(": re-run metric missing")))
        .when(outside, F.concat(where, F.format_string(": re-run mean %.4f outside submitted CI [%.4f, %.4f]", "_mean", "ci_lo", "ci_hi")))
    )
    return joined.select("task_id", F.when(F.col("_task").isNotNull(), F.col("metric")).alias("metric"), reason.alias("reason")).where("reason is not null").distinct()


#: Fixed value: tasks that a full submission has.
REQUIRED = ("nq-1k", "hotpotqa-1k", "noisy-qa", "unanswerable-qa")


def validate(submissions: DataFrame, require_suite: bool = True) -> DataFrame:
    """``pipeline_hash, severity, message`` of what is wrong with submissions; no errors: valid."""
    s = submissions

    def found(rows: DataFrame, condition, severity: str, message) -> DataFrame:
        return rows.where(condition).select("pipeline_hash", F.lit(severity).alias("severity"), message.alias("message"))

    tasks = s.select("pipeline_hash", F.explode("tasks").alias("task_id", "task"))
    metrics = tasks.select("pipeline_hash", "task_id", F.explode("task.metrics").alias("metric", "m"))
    of = F.concat(F.lit("Task "), F.col("task_id"))
    # The sentences by which a submission is told what is wrong with it
    out = [
        found(s, ~F.startswith("pipeline_hash", F.lit("sha256:")), "error", F.concat(F.lit("Bad pipeline_hash format: "), F.col("pipeline_hash"))),
        found(s, F.trim(F.coalesce("pipeline_yaml", F.lit(""))) == "", "error", F.lit("pipeline_yaml is empty")),
        found(s, F.size("seeds") < 5, "warning", F.concat(F.lit("<5 seeds ("), F.size("seeds"), F.lit("); submission discouraged for leaderboard"))),
        found(tasks, F.coalesce(F.size(F.map_keys("task.metrics")), F.lit(0)) <= 0, "error", F.concat(of, F.lit(": no metrics reported"))),
        found(tasks, F.coalesce(F.col("task.task_data_hash"), F.lit("")) == "", "error", F.concat(of, F.lit(": missing task_data_hash"))),
        found(metrics, F.col("m.mean").isNull() | F.col("m.ci_95").isNull(), "error", F.concat(of, F.lit("/"), F.col("metric"), F.lit(": missing mean or ci_95"))),
    ]
    if require_suite:
        missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys("tasks"))
        out.append(found(s, F.size(missing) > 0, "error", F.concat(F.lit("Missing required tasks: "), F.array_join(missing, ", "))))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
