"""Command line: eval, calibrate, show, submit, verify, tasks, components, leaderboard."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from plumbline import __version__
from plumbline.operators import leaderboard, metrics, repro
from plumbline.plans import pipeline as plans
from plumbline.plans.registry import components
from plumbline.sources import submissions, tasks


def _session() -> SparkSession:
    return SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _table(rows) -> str:
    rows = [[str(c) for c in r] for r in rows]
    widths = [max(map(len, c)) for c in zip(*rows, strict=True)] if rows else []
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def run_eval(a: argparse.Namespace) -> int:
    seeds = tuple(range(min(a.seeds, 1) if a.smoke else a.seeds))
    most = (a.max_items or 50) if a.smoke else a.max_items
    text = open(a.pipeline, encoding="utf-8").read()
    pipe, began, spark = plans.compose_yaml(text), time.perf_counter(), _session()
    found = []
    for name in tasks.expand(a.tasks):
        options = {"max_items": most} if most and name in ("nq-1k", "hotpotqa-1k", "msmarco-1k") else {}
        if a.data and name in ("nq-1k", "hotpotqa-1k", "msmarco-1k"):
            options["raw_path"] = f"{a.data}/{name}.parquet"
        found.append(tasks.get_task(name, **options))
    judges = metrics.named_judges(a.judges)
    record = plans.Runner(pipe, seeds, a.split, judges=tuple(judges)).run(spark, found)
    named = [{"name": j.name, "family": j.family, "model": j.model, "prompt_hash": j.prompt_hash} for j in judges]
    done = submissions.build(text, pipe.name, record, list(seeds), __version__, time.perf_counter() - began, named or None)
    done.save(a.out)
    print(f"wrote {a.out}\n{_table(submissions.summary(done))}")
    return 0


def run_calibrate(a: argparse.Namespace) -> int:
    """Agreement of judges with given verdicts: a few rows for each judge and family."""
    items = submissions.read_calibration(_session(), a.items)
    found = metrics.calibrate(items, metrics.named_judges(a.judges))
    out = {name: [r.asDict() for r in rows.orderBy(*[c for c in rows.columns if c not in ("alpha", "n")]).collect()] for name, rows in zip(("overall", "by_family", "verdicts"), found, strict=True)}
    with open(a.out, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2)
    print(_table([(r["judge"], "-" if r["alpha"] is None else f"{r['alpha']:.4f}", r["n"]) for r in out["overall"]]))
    return 0


def run_show(a: argparse.Namespace) -> int:
    print(_table(submissions.summary(submissions.Submission.load(a.result))))
    return 0


def _violations(s: submissions.Submission, suite: bool) -> list[tuple[str, str]]:
    rows = repro.validate(submissions.as_rows(_session(), [s]), suite)
    return [(r["severity"], r["message"]) for r in rows.collect()]  # a few messages


def run_submit(a: argparse.Namespace) -> int:
    s = submissions.Submission.load(a.result)
    found = _violations(s, not a.partial)
    for severity, message in found:
        print(f"{severity}: {message}", file=sys.stderr)
    if any(severity == "error" for severity, _ in found):
        return 1
    print(submissions.submit(s, a.folder, a.name, a.contact))
    return 0


def run_verify(a: argparse.Namespace) -> int:
    s = submissions.Submission.load(a.result)
    wrong = [] if s.version == __version__ else [f"made by version {s.version}, not {__version__}"]
    fingerprint = s.judge_ensemble["fingerprint"] if s.judge_ensemble else "none"
    digest = repro.pipeline_hash(s.pipeline_yaml, {t: v.get("task_data_hash", "") for t, v in s.tasks.items()}, fingerprint, s.seeds, s.version)
    wrong += [] if digest == s.pipeline_hash else [f"pipeline_hash is {digest}"]
    wrong += [m for severity, m in _violations(s, not a.partial) if severity == "error"]
    print("\n".join(wrong) or "verified")
    return int(bool(wrong))


def run_tasks(a: argparse.Namespace) -> int:
    print("\n".join(tasks.list_tasks()) if a.task is None else json.dumps(tasks.get_task(a.task).spec.as_json(), indent=2))
    return 0


def run_components(a: argparse.Namespace) -> int:
    for stage, names in components(a.stage).items():
        print(f"{stage}: {', '.join(names)}")
    return 0


def run_leaderboard(a: argparse.Namespace) -> int:
    spark = _session()
    entries = leaderboard.leaderboard(submissions.read_submissions(spark, a.folder))
    print(submissions.write_leaderboard(entries, a.out, __version__))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        c = sub.add_parser(name)
        for names, options in arguments:
            c.add_argument(*names, **options)
        c.set_defaults(run=run)

    partial = (("--partial",), {"action": "store_true"})
    command(
        "eval", run_eval, (("pipeline",), {}), (("--tasks",), {"required": True}), (("--seeds",), {"type": int, "default": 5}), (("--split",), {"choices": tasks.SPLITS, "default": "public"}),
        (("--out",), {"default": "result.json"}), (("--max-items",), {"type": int}), (("--smoke",), {"action": "store_true"}), (("--data",), {"default": ""}), (("--judges",), {"default": ""}))
    command("calibrate", run_calibrate, (("items",), {}), (("--judges",), {"default": "dummy"}), (("--out",), {"default": "calibration.json"}))
    command("show", run_show, (("result",), {}))
    command("submit", run_submit, (("result",), {}), (("--folder",), {"default": "submissions"}), (("--name",), {"required": True}), (("--contact",), {"default": ""}), partial)
    command("verify", run_verify, (("result",), {}), partial)
    command("tasks", run_tasks, (("task",), {"nargs": "?"}))
    command("components", run_components, (("stage",), {"nargs": "?"}))
    command("leaderboard", run_leaderboard, (("folder",), {}), (("--out",), {"default": "leaderboard.json"}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
