import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import metrics as M


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("The   Eiffel Tower!", "eiffel tower"), ("an A the", ""), ("", ""), ("x-y z", "x y z")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_answer(F.lit(text))) == want


@pytest.mark.parametrize(
    ("p", "g", "want"), [("Mount Everest", "Mount Everest is the highest mountain", 4 / 7), ("a", "the", 1.0), ("a", "x", 0.0), ("x x y", "x y y", 2 / 3), ("q", "z", 0.0)])
def test_token_f1(spark, p, g, want):
    assert one(spark, M.token_f1(F.lit(p), F.array(F.lit(g)))) == pytest.approx(want)


def test_metrics_without_golds_are_null(spark):
    none = F.array().cast("array<string>")
    for metric in (M.exact_match, M.token_f1, M.length_ratio):
        assert one(spark, metric(F.lit("x"), none)) is None


def test_length_ratio(spark):
    assert one(spark, M.length_ratio(F.lit(" ".join(["w"] * 40)), F.array(F.lit("x")))) == 40


def hits(spark, *rows):
    return spark.createDataFrame([("q", i, c, c.split("#")[0], "text of " + c) for i, c in enumerate(rows)], "query_id string, rank int, chunk_id string, doc_id string, text string")


def test_retrieval_scores(spark):
    items = spark.createDataFrame([("q", ["a", "b"]), ("none", None), ("missed", ["a"])], "query_id string, gold_passages array<string>")
    got = {r["query_id"]: r for r in M.retrieval_scores(items, hits(spark, "x#0", "a#0", "y#0"), 3).collect()}
    assert got["q"]["recall@3"] == 0.5
    assert got["q"]["mrr@3"] == 0.5
    assert got["q"]["ndcg@3"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got["none"]["recall@3"] is None and got["missed"]["mrr@3"] == 0


def test_ndcg_may_exceed_one(spark):
    items = spark.createDataFrame([("q", ["a"])], "query_id string, gold_passages array<string>")
    assert M.retrieval_scores(items, hits(spark, "a#0", "a#1"), 5).first()["ndcg@5"] > 1


def test_gold_by_substring(spark):
    items = spark.createDataFrame([("q", ["TEXT OF z"]), ("q2", ["of z"])], "query_id string, gold_passages array<string>")
    got = {r["query_id"]: r["recall@1"] for r in M.retrieval_scores(items, hits(spark, "z#0"), 1).collect()}
    assert got == {"q": 1.0, "q2": 0.0}


@pytest.mark.parametrize(
    ("text", "ok", "recall", "precision", "right"),
    [("INSUFFICIENT_CONTEXT", False, 1.0, 1.0, 1.0), ("Paris", False, 0.0, None, 0.0), ("insufficient context.", True, None, 0.0, 0.0), ("Paris", True, None, None, 1.0), ("Insufficient context", None, None, 0.0, None)])
def test_abstention(spark, text, ok, recall, precision, right):
    answerable = F.lit(ok).cast("boolean")
    assert one(spark, M.abstention_recall(F.lit(text), answerable)) == recall
    assert one(spark, M.abstention_precision(F.lit(text), answerable)) == precision
    assert one(spark, M.right_decision(F.lit(text), answerable)) == right


def test_counterfactual(spark):
    golds = F.array(F.lit("1989"))
    assert one(spark, M.plausible_compliance(F.lit("It was 1991."), F.lit("plausible"), F.lit("1991"))) == 1
    assert one(spark, M.plausible_compliance(F.lit("x"), F.lit("implausible"), F.lit("1991"))) is None
    assert one(spark, M.implausible_resistance(F.lit("1989"), F.lit("implausible"), F.lit("1991"), golds)) == 1
    assert one(spark, M.implausible_resistance(F.lit("1989 or 1991"), F.lit("implausible"), F.lit("1991"), golds)) == 0


def test_composite(spark):
    d = lambda x: F.lit(x).cast("double")
    assert one(spark, M.adversarial_composite(d(None), d(None), d(None), d(None))) == 0
    assert one(spark, M.adversarial_composite(d(-0.5), d(1.0), d(None), d(None))) == 1.25
    assert one(spark, M.noise_vulnerability(d(0.8), d(0.4))) == 0.5 and one(spark, M.noise_vulnerability(d(0.0), d(0.4))) == 0


def test_claims_and_verdicts(spark):
    assert one(spark, T.atomic_claims(F.lit("..."))) == []
    assert one(spark, T.atomic_claims(F.lit("Paris is big. It is old."))) == ["Paris is big", "It is old"]
    for claim, want in (("NOT-x", "refuted"), ("Paris is, big", "supported"), ("is it", "neutral"), ("London", "neutral")):
        assert one(spark, M.dummy_verdict(F.lit(claim), F.lit("paris IS big"))) == want
    for said, want in (("Supported.", "supported"), (" refutes it", "refuted"), ("", "neutral"), ("no", "neutral")):
        assert one(spark, M.parse_verdict(F.lit(said))) == want
    lit = lambda *n: (F.lit(x) for x in n)
    assert [one(spark, M.majority(*lit(*n))) for n in ((2, 1, 3), (1, 1, 3), (1, 2, 3), (0, 0, 0))] == ["supported", "neutral", "refuted", "neutral"]


def test_faithfulness_leaves_out_the_own_family(spark):
    judges = [M.Judge("a", "f1"), M.Judge("b", "f2", connect=lambda: lambda claim, context: "refuted")]
    answers = spark.createDataFrame([(1, "Paris is big.", "f1"), (2, "Paris is big.", "f2"), (3, "", "f1"), (4, "Paris is big.", None)], "query_id int, text string, family string")
    contexts = spark.createDataFrame([(i, "Paris is big") for i in (1, 2, 3, 4)], "query_id int, context string")
    got = {r["query_id"]: r["faithfulness"] for r in M.faithfulness(answers, contexts, judges).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: None, 4: 0.0}
    alone = {r["query_id"]: r["faithfulness"] for r in M.faithfulness(answers, contexts, judges[:1]).collect()}
    assert alone[1] == 1.0  # no other judge is left, so the own family judges


def test_calibration(spark):
    rows = [("f", "Paris is big", "paris is big", "supported"), ("f", "NOT-x", "y", "refuted"), ("g", "London", "paris", "neutral")]
    items = spark.createDataFrame(rows, "task_family string, claim string, context string, gold_verdict string")
    stub = M.model_judge("b", "openai", "m", lambda: lambda prompt, o: ("Supported." if "Paris is big" in prompt else "neutral", 1, 1))
    overall, family, counts = M.calibrate(items, [M.Judge("a"), stub])
    assert {r["judge"]: r["alpha"] for r in overall.collect()}["a"] == 1.0
    assert {(r["task_family"], r["judge"]): r["alpha"] for r in family.collect()}["g", "a"] is None
    assert {(r["judge"], r["verdict"]): r["n"] for r in counts.collect()}["b", "neutral"] == 2
    with pytest.raises(ValueError):
        M.calibrate(items, [])
