import os
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.operators import generate, leaderboard, metrics, store


def counting(folder, broken=()):
    """A client that leaves a file for each call."""

    def connect():
        def call(prompt, options):
            if prompt in broken:
                raise RuntimeError("no answer")
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return f"{prompt}-{options['seed']}", 3, 1

        return call

    return connect


def test_no_question_is_asked_twice(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    options = {"model": "gpt-4o", "temperature": 0.0, "max_tokens": 5}
    rows = spark.createDataFrame([(i, i % 2, f"q{i % 6}") for i in range(12)], "query_id int, seed int, prompt string")
    first = generate.by_model(rows, counting(calls), options, "openai", answers)
    want = sorted((i, f"q{i % 6}-{i % 2}") for i in range(12))
    assert sorted((r["query_id"], r["text"]) for r in first.collect()) == want and len(list(calls.iterdir())) == 6  # as many as prompts and seeds
    plain = generate.by_model(rows, counting(calls), options, "openai")
    assert set(plain.columns) == set(first.columns) and plain.count() == 12
    n = len(list(calls.iterdir()))
    more = rows.unionByName(spark.createDataFrame([(99, 0, "new")], rows.schema))
    spark.conf.set(store.SETTING, str(tmp_path / "set"))
    try:
        assert generate.by_model(more, counting(calls), options, "openai").count() == 13 and len(list(calls.iterdir())) == n + 7
        assert generate.by_model(more, counting(calls, ["new", "q1"]), options, "openai").count() == 13
    finally:
        spark.conf.unset(store.SETTING)
    # another model is another question
    assert generate.by_model(rows, counting(calls), options | {"model": "gpt-5"}, "openai", answers).count() == 12
    assert len(list(calls.iterdir())) == n + 7 + 6
    assert generate.by_model(rows.limit(0), counting(calls), options, "openai", str(tmp_path / "none")).count() == 0


def test_a_failed_task_costs_its_own_answers_alone(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    rows = spark.createDataFrame([(i, f"q{i}") for i in range(40)], "query_id int, prompt string")
    ask = lambda broken: store.through(rows, store.key_of(F.col("prompt")), answers, lambda todo: generate._asked(todo, counting(calls, broken), {"model": "m"}), per_task=1)
    with pytest.raises(Exception, match="no answer"):
        ask(["q39"])
    before = len(list(calls.iterdir()))
    assert ask([]).count() == 40
    kept = spark.read.parquet(answers).count()
    assert kept == 40 and before > 0 and len(list(calls.iterdir())) <= 40 + 8  # tasks that were stopped on their way ask again


def test_judges_are_not_asked_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def judge(name):
        return metrics.model_judge(name, name, "m", lambda: lambda prompt, options: (open(os.path.join(calls, uuid.uuid4().hex), "w").close() or "supported", 1, 1))

    pairs = spark.createDataFrame([(j, f"c{i}", "x") for i in range(5) for j in ("a", "b")], "judge string, claim string, context string")
    for _ in range(2):
        said = metrics.judged_by_model(pairs, [judge("a"), judge("b")], str(tmp_path / "said"))
        assert said.where("said = 'supported'").count() == 10
    assert len(list(calls.iterdir())) == 10


def test_a_frontier_of_all_entries(spark, tmp_path):
    """Every point is on the frontier, so that none is beaten in its part."""
    n = 100_000
    points = spark.range(n).selectExpr("id", "CAST(id AS DOUBLE) AS cost", "CAST(id AS DOUBLE) / 7 AS quality")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    got = leaderboard.pareto(points, path=str(tmp_path / "front"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("pareto").count() == n
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "front")).groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.9 * n
    odd = points.withColumn("quality", F.when(F.col("id") % 2 == 0, F.col("quality")).otherwise(F.col("quality") - 1))
    got = leaderboard.pareto(odd.unionByName(odd.where("id % 1000 = 0")))
    assert got.where("pareto").count() == n // 2 + n // 1000 and got.where("pareto AND id % 2 = 1").isEmpty()


def test_a_frontier_with_ties_and_nulls(spark):
    rows = [(1, 1.0, 5.0), (2, 1.0, 5.0), (3, 2.0, 5.0), (4, 2.0, 6.0), (5, 0.5, 1.0), (6, 9.0, 6.0), (7, None, 0.5), (8, 3.0, None)]
    frame = spark.createDataFrame(rows, "id int, cost double, quality double")
    assert {r["id"] for r in leaderboard.pareto(frame).where("pareto").collect()} == {1, 2, 4, 5, 7}
    assert leaderboard.pareto(frame.limit(0)).count() == 0
