import json

import numpy as np
import pytest

from plumbline import __version__
from plumbline.operators import repro
from plumbline.plans import cli, pipeline, registry
from plumbline.sources import submissions, tasks

YAML = """
pipeline:
  name: small
  chunker: {type: sentence, chunk_size: 400}
  retriever: {type: bm25}
  generator: {type: echo}
  retriever_top_k: 10
  reranker_top_k: 3
"""


def test_compose_rejects_what_it_does_not_know():
    assert pipeline.compose_yaml(YAML).reranker.type == "identity"
    for bad, error in ((YAML.replace("bm25", "nope"), KeyError), (YAML.replace("chunk_size", "sizes"), ValueError), (YAML.replace("name: small", "nam: small"), ValueError), ("", ValueError), (YAML.replace("400", "x"), ValueError)):
        with pytest.raises(error):
            pipeline.compose_yaml(bad)


def test_registry():
    with pytest.raises(ValueError):
        registry.register("chunker", "fixed")(type("Other", (), {}))
    assert registry.components("reranker")["reranker"] == ["cross-encoder", "identity", "lexical-overlap"]
    with pytest.raises(ValueError):
        registry.make("retriever", {"type": "hybrid", "fusion": "sum"})


def test_index_before_answer(spark):
    with pytest.raises(RuntimeError):
        pipeline.compose_yaml(YAML).answer(tasks.get_task("synthetic-10").items(spark, "all"))


def test_synthetic_run(spark):
    got = pipeline.Runner(pipeline.compose_yaml(YAML), (0, 1)).run_task(spark, tasks.get_task("synthetic-10"))
    m = got["metrics"]
    assert m["recall@10"]["mean"] >= 0.9 and m["mrr@10"]["mean"] >= 0.5 and m["token_f1"]["mean"] > 0.05 and m["recall@10"]["n"] == 10
    assert got["n_items"] == 10 and got["cost_per_query_usd"] == {"mean": 0.0, "p95": 0.0}


def test_adversarial_runs(spark):
    run = pipeline.Runner(pipeline.compose_yaml(YAML), (0,))
    assert run.run_task(spark, tasks.get_task("unanswerable-qa"))["metrics"]["nrr_f1"]["n"] == 20
    assert set(run.run_task(spark, tasks.get_task("counterfactual-qa"))["metrics"]) >= {"plausible_compliance", "implausible_resistance"}


def test_hybrid_and_model(spark):
    pipeline.ENCODERS["test"] = lambda name: lambda ts: np.array([[len(t), 1.0 + t.count("e")] for t in ts], float)
    pipeline.CLIENTS["openai"] = lambda: lambda prompt, o: ("Titan", 10, 1)
    config = {
        "name": "h", "chunker": {"type": "fixed", "chunk_size": 30, "overlap": 5}, "retriever": {"type": "hybrid", "dense": {"type": "dense", "model": "test"}},
        "reranker": {"type": "lexical-overlap"}, "generator": {"type": "openai"}, "retriever_top_k": 4, "reranker_top_k": 2}
    task = tasks.get_task("synthetic-10")
    pipe = pipeline.compose(config).index(task.corpus(spark))
    result = pipe.answer(task.items(spark, "all"), (0, 1))
    assert result.answers.count() == 20 and result.answers.where("total_tokens = 11 and cost_usd > 0").count() == 20
    assert result.reranked.groupBy("query_id").count().where("count > 2").count() == 0
    assert pipe.fingerprint()["generator"]["type"] == "openai"


def test_hashes():
    a = repro.pipeline_hash("b: 1\na: 2\n", {"t": "x"}, seeds=(1, 0), version="1")
    assert a == repro.pipeline_hash("a: 2 # note\nb: 1\n", {"t": "x"}, seeds=(0, 1), version="1") and a.startswith("sha256:")
    j = [{"name": "b", "model": "m", "prompt_hash": "p", "family": "f"}, {"name": "a", "model": "m", "prompt_hash": "p"}]
    assert repro.judge_fingerprint(j) == repro.judge_fingerprint(j[::-1]) and repro.judge_fingerprint([]) == "none"


def test_suites():
    assert tasks.expand("smoke, adversarial,noisy-qa,,other") == ["synthetic-10", "noisy-qa", "unanswerable-qa", "counterfactual-qa", "other"]


def test_command_line(spark, tmp_path, capsys):
    config, out = tmp_path / "p.yaml", tmp_path / "result.json"
    config.write_text(YAML)
    assert cli.main(["eval", str(config), "--tasks", "smoke", "--smoke", "--out", str(out)]) == 0
    assert cli.main(["show", str(out)]) == 0 and "token_f1" in capsys.readouterr().out
    assert cli.main(["verify", str(out), "--partial"]) == 0
    assert cli.main(["submit", str(out), "--name", "me", "--folder", str(tmp_path / "subs"), "--partial"]) == 0
    assert cli.main(["submit", str(out), "--name", "me", "--folder", str(tmp_path / "subs")]) == 1
    assert cli.main(["leaderboard", str(tmp_path / "subs"), "--out", str(tmp_path / "board.json")]) == 0
    assert len(json.loads((tmp_path / "board.json").read_text())["entries"]) == 1
    forged = submissions.Submission.load(str(out))
    forged.version = "9"
    forged.save(str(out))
    assert cli.main(["verify", str(out), "--partial"]) == 1 and __version__ != "9"
    assert cli.main(["tasks"]) == 0 and cli.main(["tasks", "noisy-qa"]) == 0 and cli.main(["components"]) == 0


def test_seed_tasks_have_their_numbers_of_items(spark):
    for name, n, docs in (("synthetic-10", 10, 10), ("noisy-qa", 25, 100), ("unanswerable-qa", 20, 40), ("counterfactual-qa", 16, 16)):
        task = tasks.get_task(name)
        items = task.items(spark, "all")
        assert (items.count(), items.select("item_id").distinct().count(), task.corpus(spark).count()) == (n, n, docs)
    flags = {r["answerable"]: r["count"] for r in tasks.get_task("unanswerable-qa").items(spark, "all").groupBy("answerable").count().collect()}
    assert flags == {False: 12, True: 8}
    kinds = {r["counter_kind"]: r["count"] for r in tasks.get_task("counterfactual-qa").items(spark, "all").groupBy("counter_kind").count().collect()}
    assert kinds == {"plausible": 8, "implausible": 8}
    told = {r["doc_id"]: r["text"] for r in tasks.get_task("counterfactual-qa").corpus(spark).collect()}
    for r in tasks.get_task("counterfactual-qa").items(spark, "all").collect():
        assert r["counter_answer"] in told[f"cf-{r['item_id']}"]


def test_records_as_they_are_published(spark, tmp_path):
    nq = [{"id": "7", "question": {"text": "who"}, "document": {"title": "T", "tokens": {"token": ["<p>", "a", "b", "c"], "is_html": [True, False, False, False]}}, "annotations": {"short_answers": [{"start_token": [1], "end_token": [3], "text": ["x y"]}, {"start_token": [], "end_token": [], "text": []}]}}]
    flat = [{"id": "8", "question": "who", "document_text": "a b c", "document_title": "T", "short_answers": [{"text": None, "start_token": 0, "end_token": 2}]}]
    hotpot = [{"id": "h", "question": "q", "answer": "a", "supporting_facts": {"title": ["B"], "sent_id": [0]}, "context": {"title": ["A", "B"], "sentences": [[" one ", "two"], ["three"]]}}]
    marco = [{"query_id": 3, "query": "q", "answers": ["a", ""], "passages": {"is_selected": [0, 1], "passage_text": ["t0", "t1"], "url": ["u0", "u1"]}}]

    def read(rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(map(json.dumps, rows)))
        return spark.read.json(str(path))

    got = tasks.map_nq(read(nq)).first()
    assert (got["id"], got["question"], got["answers"], got["document_text"], got["document_title"]) == ("7", "who", ["x y", "b c"], "a b c", "T")
    assert tasks.map_nq(read(flat)).first()["answers"] == ["a b"]
    got = tasks.map_hotpot(read(hotpot)).first()
    assert [(p["title"], p["text"], p["is_gold"]) for p in got["paragraphs"]] == [("A", "one two", False), ("B", "three", True)]
    got = tasks.map_msmarco(read(marco)).first()
    assert got["answers"] == ["a"] and [(p["id"], p["is_gold"]) for p in got["paragraphs"]] == [("msm-3-0", False), ("msm-3-1", True)]


def test_judges_in_a_run_and_their_calibration(spark, tmp_path, capsys):
    config, out = tmp_path / "p.yaml", tmp_path / "result.json"
    config.write_text(YAML)
    assert cli.main(["eval", str(config), "--tasks", "smoke", "--smoke", "--judges", "dummy", "--out", str(out)]) == 0
    done = submissions.Submission.load(str(out))
    score = done.tasks["synthetic-10"]["metrics"]["faithfulness"]
    # the echo says what stands in its context
    assert score["n"] == 10 and score["mean"] > 0.5 and done.judge_ensemble["judges"][0]["name"] == "dummy"
    assert cli.main(["verify", str(out), "--partial"]) == 0
    items = tmp_path / "items.jsonl"
    rows = [("1", "f", "Titan circles Saturn", "Titan circles Saturn in two weeks", "supported"), ("2", "f", "NOT-true", "anything", "refuted"), ("3", "g", "Venus has rings", "Saturn has rings", "supported")]
    items.write_text("\n".join(json.dumps(dict(zip(("item_id", "task_family", "claim", "context", "gold_verdict"), r, strict=True))) for r in rows))
    assert cli.main(["calibrate", str(items), "--out", str(tmp_path / "c.json")]) == 0
    got = json.loads((tmp_path / "c.json").read_text())
    assert [(r["judge"], r["n"]) for r in got["overall"]] == [("dummy", 3)] and {(r["task_family"], r["n"]) for r in got["by_family"]} == {("f", 2), ("g", 1)}
    assert sum(r["n"] for r in got["verdicts"]) == 3
    with pytest.raises(ValueError):
        cli.main(["calibrate", str(items), "--judges", "nobody"])
