import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import rouge, stats


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=90), st.lists(st.integers(0, 9), max_size=90))
def test_common_subsequences(a, b):
    assert rouge.lcs(np.array(a, np.int64), np.array(b, np.int64)) == plain_lcs(a, b)


def test_common_subsequences_of_long_texts(monkeypatch):
    r = random.Random(3)
    a = [r.randrange(500) for _ in range(1500)]
    b = [x for x in a if r.random() < 0.8] + [r.randrange(900) for _ in range(200)]
    assert rouge.lcs(np.array(a), np.array(b)) == plain_lcs(a, b)
    monkeypatch.setattr(rouge, "KEPT", 0)
    assert rouge.lcs(np.array(a), np.array(b)) == plain_lcs(a, b)


def test_rouge_l(spark):
    rows = [
        (1, "The cat sat on the mat.", ["a cat on mat", "dogs"]), (2, "x", []), (3, "x", None), (4, None, ["a", "b c"]), (5, "", ["the"]),
        (6, "one two three", ["three two one", None]), (7, "words " * 3000, ["words " * 2000]),
    ]
    got = {r["k"]: r["rouge_l"] for r in rouge.with_rouge_l(spark.createDataFrame(rows, "k int, text string, gold_answers array<string>").repartition(2)).collect()}
    assert got[1] == pytest.approx(6 / 7) and got[2] is None and got[3] is None and got[6] == pytest.approx(1 / 3) and got[7] == pytest.approx(0.8)
    assert got[4] == 1.0 and got[5] == 1.0  # nothing is left of "a" and "the"
    assert rouge.with_rouge_l(spark.createDataFrame([], "text string, gold_answers array<string>")).count() == 0


def place(values, q):
    values = sorted(values)
    return values[round(q * (len(values) - 1))]


def test_nearest_rank_of_groups_of_all_sizes(spark):
    r = random.Random(4)
    groups = {k: [float(r.choice((r.random(), 0.5, 1.0, r.randint(0, 9)))) for _ in range(n)] for k, n in enumerate([1, 2, 3, 7, 10, 11, 12, 13, 20, 21, 41, 60, 99, 500])}
    groups[None] = [3.0, 1.0, 2.0]
    rows = [(k, v) for k, own in groups.items() for v in [*own, None]]
    frame = spark.createDataFrame(rows, "k int, v double").repartition(5)
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {x["k"]: x for x in stats.nearest_rank(frame, ["k"], "v", q).collect()}
        assert {k: x["p95"] for k, x in got.items()} == {k: place(own, q) for k, own in groups.items()}
        assert all(got[k]["mean"] == pytest.approx(sum(own) / len(own)) for k, own in groups.items())


def test_nearest_rank_by_a_sketch_sorts_no_rows(spark, monkeypatch):
    n = 60_000
    frame = spark.range(n).selectExpr("id % 2 AS k", "CAST(pmod(xxhash64(id), 1000000) AS DOUBLE) AS v")
    values = frame.toPandas()
    monkeypatch.setattr(stats, "SKETCHED", 1000)
    for keys in (["k"], []):
        found = stats.nearest_rank(frame, keys, "v")
        got = {x["k"] if keys else 0: x["p95"] for x in found.collect()}
        want = {k: place(own["v"].tolist(), 0.95) for k, own in values.groupby("k")} if keys else {0: place(values["v"].tolist(), 0.95)}
        assert got == want
        plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        at = next(i for i, x in enumerate(plan) if "Window [" in x)
        below = next(x for x in plan[at + 1 :] if not re.search(r"Project|Filter", x))
        assert "Aggregate [" in below and sum("Window [" in x for x in plan) == 1
