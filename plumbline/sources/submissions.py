"""Submissions, calibration data and leaderboard files: schemas, readers and writers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import repro

_METRIC = "struct<mean: double, ci_95: array<double>, n: bigint>"
_TASK = f"struct<task_data_hash: string, n_items: bigint, seeds: array<int>, metrics: map<string, {_METRIC}>, cost_per_query_usd: struct<mean: double, p95: double>, latency_ms: struct<mean: double, p95: double>, wall_time_s: double>"
_JUDGES = "struct<judges: array<struct<name: string, family: string, model: string, prompt_hash: string>>, fingerprint: string>"


def schema(version_key: str = "version") -> str:
    """Of a submission file; ``version_key`` is the name under which it has the engine's version."""
    return (
        f"`{version_key}` string, pipeline_hash string, pipeline_yaml string, pipeline_name string, submitter struct<name: string, contact: string>, seeds array<int>, "
        f"judge_ensemble {_JUDGES}, tasks map<string, {_TASK}>, total_wall_time_s double, submitted_at string, _corrupt_record string"
    )


def read_submissions(spark: SparkSession, path: str, version_key: str = "version") -> DataFrame:
    """Submission files of a folder, or one file, by name; malformed ones are left out.

    ``submitted_at`` falls back to the file's time of change.
    """
    raw = spark.read.schema(schema(version_key)).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    changed = F.date_format(F.col("_metadata.file_modification_time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    good = raw.where("_corrupt_record is null and pipeline_hash is not null and pipeline_name is not null and tasks is not null")
    return good.select(
        F.col("_metadata.file_name").alias("file_name"), F.col(version_key).alias("version"), "pipeline_hash", "pipeline_yaml", "pipeline_name", "submitter", "seeds", "judge_ensemble", "tasks",
        F.coalesce("total_wall_time_s", F.lit(0.0)).alias("total_wall_time_s"), F.coalesce("submitted_at", changed).alias("submitted_at"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, task_family, claim, context, gold_verdict, rationale``, one JSON object a line."""
    return spark.read.schema("item_id string, task_family string, claim string, context string, gold_verdict string, rationale string").json(path)


@dataclass
class Submission:
    """The result of a run as it is published: a few kilobytes, kept by the driver."""

    version: str
    pipeline_hash: str
    pipeline_yaml: str
    pipeline_name: str
    seeds: list[int]
    tasks: dict[str, Any]
    submitter: dict[str, str] = field(default_factory=lambda: {"name": "anonymous", "contact": ""})
    judge_ensemble: dict[str, Any] | None = None
    total_wall_time_s: float = 0.0
    submitted_at: str | None = None

    def as_json(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("version", "pipeline_hash", "pipeline_yaml", "pipeline_name", "submitter", "seeds", "judge_ensemble", "tasks", "total_wall_time_s", "submitted_at")}

    def save(self, path: str) -> str:
        _write(path, json.dumps(self.as_json(), indent=2))
        return path

    @classmethod
    def load(cls, path: str) -> "Submission":
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        known = {k: data[k] for k in ("version", "pipeline_hash", "pipeline_yaml", "pipeline_name", "seeds", "tasks")}
        return cls(**known, **{k: data[k] for k in ("submitter", "judge_ensemble", "total_wall_time_s", "submitted_at") if data.get(k) is not None})


def _write(path: str, text: str) -> None:
    import os

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def build(pipeline_yaml: str, pipeline_name: str, tasks: dict[str, dict[str, Any]], seeds: list[int], version: str, wall_time_s: float = 0.0, judges: list[dict[str, str]] | None = None) -> Submission:
    """A submission of a run; each task's entry has task_data_hash, n_items, metrics, costs and latencies."""
    fingerprint = repro.judge_fingerprint(judges)
    digest = repro.pipeline_hash(pipeline_yaml, {t: v["task_data_hash"] for t, v in tasks.items()}, fingerprint, seeds, version)
    ensemble = {"judges": [{"name": j["name"], "family": j.get("family", ""), "model": j["model"], "prompt_hash": j["prompt_hash"]} for j in judges], "fingerprint": fingerprint} if judges else None
    return Submission(version, digest, repro.canonical_yaml(pipeline_yaml), pipeline_name, list(seeds), tasks, judge_ensemble=ensemble, total_wall_time_s=wall_time_s)


def submit(submission: Submission, folder: str, name: str, contact: str = "") -> str:
    """Stamp submitter and time once, and write the file named by its hash."""
    submission.submitter = {"name": name, "contact": contact}
    submission.submitted_at = submission.submitted_at or datetime.now(UTC).isoformat()
    return submission.save(f"{folder}/{submission.pipeline_hash.removeprefix('sha256:')}.json")


def write_leaderboard(entries: DataFrame, path: str, version: str) -> str:
    """One JSON document of all entries, as the site reads it.

    Entries are published submissions, a row each; they are streamed to the
    driver one by one into the file.
    """
    rows = entries.withColumn("metrics", F.to_json("metrics")).drop("quality").orderBy("pipeline_hash")
    listed, tasks = [], set()
    for r in rows.toLocalIterator():
        e = r.asDict(recursive=True)
        by_task = {}
        for t in json.loads(e.pop("metrics") or "{}").items():
            by_task[t[0]] = {k: v for m in t[1] for k, v in ((m["key"], m["value"]["mean"]), (f"{m['key']}_ci", [m["value"].get("ci_lo"), m["value"].get("ci_hi")]))}
        tasks |= set(by_task)
        listed.append(e | {"metrics": by_task})
    _write(path, json.dumps({"generated_at": datetime.now(UTC).isoformat(), "version": version, "tasks": sorted(tasks), "entries": listed}, indent=2))
    return path


def summary(submission: Submission) -> list[tuple[str, str, str, str, int]]:
    """Task, metric, mean, interval and n, as the console shows them."""
    out = []
    for task, payload in submission.tasks.items():
        for name, m in payload.get("metrics", {}).items():
            out.append((task, name, f"{m['mean']:.4f}", f"[{m['ci_95'][0]:.4f}, {m['ci_95'][1]:.4f}]", m["n"]))
    return out


def as_rows(spark: SparkSession, submissions: list[Submission]) -> DataFrame:
    """Submissions in memory as a table with the columns of ``read_submissions``."""
    lines = [(json.dumps(s.as_json()),) for s in submissions]
    parsed = spark.createDataFrame(lines, "line string").select(F.from_json("line", schema()).alias("s")).select("s.*")
    return parsed.drop("_corrupt_record").withColumn("file_name", F.lit(None).cast("string"))
