import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import chunkers, generate, leaderboard, repro, rerank, retrieval, stats
from plumbline.sources import submissions, tasks


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def texts(frame):
    return [r["text"] for r in frame.orderBy("doc_id", "position").collect()]


def test_fixed_chunks_overlap_and_tail(spark):
    got = texts(chunkers.chunk_fixed(docs(spark, " ".join(map(str, range(10))), "", None), 5, 2))
    assert got == ["0 1 2 3 4", "3 4 5 6 7", "6 7 8 9", "9"]


def test_recursive_chunks(spark):
    text = "aaaa. bbbb\n\ncccc dddd eeee"
    got = texts(chunkers.chunk_recursive(docs(spark, text, ""), 10, 3))
    assert all(len(c) <= 13 for c in got) and got[0].startswith("aaaa")
    long = texts(chunkers.chunk_recursive(docs(spark, "x" * 25), 10, 0))
    assert long == ["x" * 10, "x" * 10, "x" * 5]
    with pytest.raises(ValueError):
        chunkers.chunk_recursive(docs(spark, "a"), 10, 10)


def test_sentence_chunks_end_where_the_carry_does_not_fit(spark):
    a, b = "A" * 15 + ".", "B" * 15 + "."
    assert texts(chunkers.chunk_sentence(docs(spark, f"{a} {b} {a}"), 20, 1)) == [a, b, a]
    assert texts(chunkers.chunk_sentence(docs(spark, "One. Two. Six."), 10, 1)) == ["One. Two.", "Two. Six."]


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", f"d{i}", t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, text string")


def brute_bm25(texts, query, k1=1.5, b=0.75):
    import re

    cut = [re.findall(r"[A-Za-z0-9]+(?:'[a-z]+)?", (t or "").lower()) for t in texts]
    avg, n = sum(map(len, cut)) / len(cut), len(cut)
    out = {}
    for q in re.findall(r"[A-Za-z0-9]+(?:'[a-z]+)?", query.lower()):
        df = sum(q in c for c in cut)
        for i, c in enumerate(cut):
            if tf := c.count(q):
                out[f"c{i}"] = out.get(f"c{i}", 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * max(len(c), 1) / avg))
    return out


def test_bm25_equals_brute_force(spark):
    corpus = ["the cat sat", "a dog and a cat", "birds can't fly here", "", None, "cat cat cat dog", "the cat sat"]
    asked = ["cat dog", "cat cat", "can't", "nothing matches zzz", ""]
    got = retrieval.bm25(chunks(spark, *corpus), queries(spark, *asked), 3, block=2).collect()
    for i, q in enumerate(asked):
        want = sorted(((round(s, 6), c) for c, s in brute_bm25(corpus, q).items()), key=lambda x: (-x[0], x[1]))[:3]
        mine = sorted(((r["rank"], round(r["score"], 6), r["chunk_id"]) for r in got if r["query_id"] == i))
        assert [(s, c) for _, s, c in mine] == want


def test_bm25_over_nothing(spark):
    assert retrieval.bm25(chunks(spark, "x").limit(0), queries(spark, "x"), 3).count() == 0
    assert retrieval.bm25(chunks(spark, "x"), queries(spark, "x").limit(0), 3).count() == 0


def test_dense_and_fusion(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None)], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "query_id int, embedding array<float>")
    got = [(r["query_id"], r["chunk_id"]) for r in retrieval.dense(v, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 5), (0, 4), (1, 0), (1, 1)]
    a = spark.createDataFrame([(0, "x", 0), (0, "y", 1)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(0, "y", 0)], "query_id int, chunk_id string, rank int")
    best = retrieval.rrf([a, b], 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == ["y", "x"] and best[0]["score"] == pytest.approx(1 / 62 + 1 / 61)


def test_embed_and_cross_encoder(spark):
    rows = retrieval.embed(chunks(spark, "aa", "bbbb"), lambda ts: np.array([[len(t), 0.0] for t in ts]), normalize=False)
    assert [r["embedding"] for r in rows.orderBy("chunk_id").collect()] == [[2.0, 0.0], [4.0, 0.0]]
    hits = spark.createDataFrame([(0, "c0", 9.0, 0, "q", "short"), (0, "c1", 8.0, 1, "q", "longer text")], "query_id int, chunk_id string, score double, rank int, query_text string, text string")
    got = rerank.cross_encoder(hits, lambda pairs: [len(t) for _, t in pairs], 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c1", "c0"]


def test_rerankers(spark):
    hits = spark.createDataFrame(
        [(0, "c0", 9.0, 0, "red fox", "blue whale"), (0, "c1", 8.0, 2, "red fox", "Red FOX"), (0, "c2", 7.0, 5, "red fox", "green whale")], "query_id int, chunk_id string, score double, rank int, query_text string, text string")
    assert [(r["chunk_id"], r["rank"]) for r in rerank.identity(hits, 2).orderBy("rank").collect()] == [("c0", 0), ("c1", 1)]
    assert [(r["chunk_id"], r["score"]) for r in rerank.lexical_overlap(hits, 3).orderBy("rank").collect()] == [("c1", 1.0), ("c0", 0.0), ("c2", 0.0)]


def test_generators(spark):
    items = spark.createDataFrame([(0, "who?"), (1, "what?")], "query_id int, question string")
    hits = spark.createDataFrame([(0, 0, "First one. Second."), (0, 1, "y" * 8000)], "query_id int, rank int, text string")
    by_id = lambda d: {r["query_id"]: r["text"] for r in d.collect()}
    assert by_id(generate.echo(items, hits)) == {0: "First one. Second.", 1: "INSUFFICIENT_CONTEXT"}
    assert by_id(generate.extractive(items, hits))[0] == "First one."
    assert generate.context(hits).first()["context"] == "[1] First one. Second."
    assert generate.context(hits.where("rank = 1").withColumn("rank", F.lit(0))).first()["context"] == ""
    made = {r["query_id"]: r["prompt"] for r in generate.prompts(items, hits, "{question} <{context}>").collect()}
    assert made == {0: "who? <[1] First one. Second.>", 1: "what? <>"}


def test_model_answers_and_costs(spark):
    prompted = spark.createDataFrame([(0, 3, "ask")], "query_id int, seed int, prompt string")
    got = generate.by_model(prompted, lambda: lambda p, o: (f" {p} {o['seed']} ", 1_000_000, 1_000_000), {"model": "gpt-4o", "temperature": 0.0, "max_tokens": 5}, "openai").first()
    assert got["text"] == "ask 3" and got["cost_usd"] == 12.5 and not got["unknown_model_rate"]
    rows = spark.createDataFrame([("nope", 5, 5), ("gpt-4o", -5, 0)], "model string, prompt_tokens int, completion_tokens int")
    assert [(r["cost_usd"], r["unknown_model_rate"]) for r in generate.with_cost(rows).orderBy("model").collect()] == [(0.0, False), (0.0, True)]


def test_intervals(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.6, 0.1, 200)
    lo, hi = stats.percentile_interval(x)
    assert lo < x.mean() < hi
    lo, hi = stats.bca_interval(x)
    assert lo < x.mean() < hi
    assert stats.percentile_interval(np.array([0.5])) == (0.5, 0.5) and math.isnan(stats.percentile_interval(np.array([]))[0])
    assert stats.bca_interval(np.full(5, 0.3)) == pytest.approx((0.3, 0.3))
    assert stats.paired_p(x, x) == 1.0 and stats.paired_p(x + 1, x) == 0.0
    with pytest.raises(ValueError):
        stats.paired_p(x, x[:3])
    items = spark.createDataFrame([("m", str(i).zfill(3), float(v)) for i, v in enumerate(x)], "metric string, item_id string, score double")
    exact = stats.with_intervals(items, ["metric"]).first()
    assert (exact["ci_lo"], exact["ci_hi"]) == pytest.approx(stats.percentile_interval(x))
    native = stats.native_intervals(items, ["metric"], 300).first()
    assert native["ci_lo"] < x.mean() < native["ci_hi"] and native["n"] == 200


def test_seed_means_and_percentile(spark):
    rows = spark.createDataFrame([("t", "m", "a", 0, 1.0), ("t", "m", "a", 1, 0.0), ("t", "m", "b", 0, 1.0), ("t", "m", "b", 1, None)], "task_id string, metric string, item_id string, seed int, score double")
    got = stats.means(stats.item_means(rows)).first()
    assert got["mean"] == 0.75 and got["n"] == 2
    v = spark.createDataFrame([("k", float(i)) for i in range(31)], "k string, v double")
    assert stats.nearest_rank(v, ["k"], "v").first()["p95"] == 28.0  # 28.5 goes to the even place


def test_agreement(spark):
    def alpha(pairs):
        row = stats.krippendorff(spark.createDataFrame(pairs, "a string, b string")).first()
        return row["alpha"]

    assert alpha([("x", "x")] * 4) == 1.0 and alpha([("x", "y")]) == 0.0 and alpha([("x", "x")]) == 1.0
    assert alpha([("x", "x"), ("y", "y"), ("x", "y"), ("y", "x")]) == pytest.approx(1 - 0.5 / (1 - 24 / 56))


def test_pareto_keeps_ties(spark):
    e = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.5, 1.0), ("c", 0.4, 1.0), ("d", 0.5, 2.0), ("e", 0.9, 2.0), ("f", 0.1, 0.5)], "id string, quality double, cost double")
    assert {r["id"] for r in leaderboard.pareto(e).where("pareto").collect()} == {"a", "b", "e", "f"}


def test_task_hash_and_split(spark):
    import hashlib

    t = tasks.unanswerable([("u2", "q2", ["x", "y"], [("b", "tb")], True), ("u1", "q1", [], [("a", "ta")], False)])
    want = "task_id:t\nitems:\nu1|q1|;\nu2|q2|x,y,;\ncorpus:\n" + "".join(f"{d}|{hashlib.sha256(x.encode()).hexdigest()}\n" for d, x in (("a", "ta"), ("b", "tb")))
    assert repro.task_data_hash("t", t.items(spark, "all"), t.corpus(spark)).first()["task_data_hash"] == hashlib.sha256(want.encode()).hexdigest()
    ids = spark.createDataFrame([(str(i),) for i in range(11)], "item_id string")
    assert {r[0] for r in tasks.split_items(ids, "holdout").collect()} == {"8", "9"}
    assert tasks.split_items(ids, "public").count() == 9 and tasks.split_items(ids, "all").count() == 11


def test_dataset_mapping(spark, tmp_path):
    raw = spark.createDataFrame([(7, "q", ["a", ""], ["p0", "p1"], [0, 1], ["u0", "u1"]), (8, "q", [""], ["p"], [1], ["u"])], "query_id int, query string, answers array<string>, passage_text array<string>, is_selected array<int>, url array<string>")
    records = tasks.map_msmarco(raw)
    assert records.count() == 1
    assert tasks.paragraph_items(records, "msmarco").first()["gold_passages"] == ["msm-7-1"]
    assert {r["doc_id"] for r in tasks.paragraph_corpus(records, "msmarco").collect()} == {"msm-7-0", "msm-7-1"}
    hp = spark.createDataFrame([("1", "q", "a", ["T", "U"], [[" x ", "y"], ["z"]], ["U"]), ("2", "q", "a", ["T"], [["other"]], ["T"])], "id string, question string, answer string, titles array<string>, sentences array<array<string>>, supporting array<string>")
    got = tasks.map_hotpot(hp)
    assert {r["doc_id"]: r["text"] for r in tasks.paragraph_corpus(got, "hotpotqa").collect()} == {"hpqa-T": "x y", "hpqa-U": "z"}
    nq = spark.createDataFrame([(1, "q", [([], 1, 3), (["yes"], None, None)], "a b c d", "t"), (2, "q", [], "x", "t")], "id int, question string, short_answers array<struct<text: array<string>, start_token: int, end_token: int>>, document_text string, document_title string")
    assert tasks.map_nq(nq).first()["answers"] == ["b c", "yes"] and tasks.map_nq(nq).count() == 1
    assert tasks.cached(records, str(tmp_path / "c"), 5).count() == 1


def test_verify_run(spark):
    submitted = spark.createDataFrame([("t", "m", 0.52, 0.58), ("t", "n", 0.0, 1.0), ("u", "m", 0.0, 1.0)], "task_id string, metric string, ci_lo double, ci_hi double")
    rerun = spark.createDataFrame([("t", "m", 0.49)], "task_id string, metric string, mean double")
    reasons = sorted(r["reason"] for r in repro.verify_run(submitted, rerun).collect())
    assert len(reasons) == 3 and any("metric missing" in r for r in reasons) and any("u: re-run missing" in r for r in reasons)
    assert any("outside" in r for r in reasons)
    assert repro.verify_run(submitted.limit(1), rerun, 0.04).count() == 0


def test_submissions_and_leaderboard(spark, tmp_path):
    folder = tmp_path / "subs"
    folder.mkdir()

    def entry(name, f1, cost, ratio, stamped="2026-01-01T00:00:00+00:00"):
        m = {"token_f1": {"mean": f1, "ci_95": [0.0, 1.0], "n": 3}, "length_ratio": {"mean": ratio, "ci_95": [0.0, 1.0], "n": 3}}
        task = {"task_data_hash": "x", "n_items": 3, "seeds": [0], "metrics": m, "cost_per_query_usd": {"mean": cost, "p95": cost}, "latency_ms": {"mean": 1.0, "p95": 2.0}, "wall_time_s": 1.0}
        s = submissions.Submission("1", f"sha256:{name}", "name: x", name, [0, 1, 2, 3, 4], {"noisy-qa": task}, submitted_at=stamped)
        s.save(str(folder / f"{name}.json"))
        return s

    a = entry("a", 0.9, 2.0, 11.0)
    entry("b", 0.5, 1.0, 3.0, None)
    entry("c", 0.4, 1.5, 10.0)
    (folder / "bad.json").write_text("{not json")
    read = submissions.read_submissions(spark, str(folder))
    assert read.count() == 3 and read.where("submitted_at is null").count() == 0
    board = {r["pipeline_name"]: r for r in leaderboard.leaderboard(read).collect()}
    assert board["a"]["tags"] == ["pareto", "verbose"] and board["b"]["tags"] == ["pareto"] and board["c"]["tags"] == []
    known = spark.createDataFrame([("sha256:a",)], "pipeline_hash string")
    assert [r["pipeline_name"] for r in leaderboard.view(leaderboard.leaderboard(read, known)).collect()] == ["a"]
    out = json.loads(open(submissions.write_leaderboard(leaderboard.leaderboard(read), str(tmp_path / "out.json"), "1")).read())
    assert out["tasks"] == ["noisy-qa"] and len(out["entries"]) == 3 and out["entries"][0]["metrics"]["noisy-qa"]["token_f1"] == 0.9
    wrong = {(r["severity"], r["message"].split(":")[0]) for r in repro.validate(submissions.as_rows(spark, [a])).collect()}
    assert wrong == {("error", "Missing required tasks")}
    assert repro.validate(submissions.as_rows(spark, [a]), False).count() == 0
    from plumbline.streaming.leaderboard import follow

    follow(spark, str(folder), str(tmp_path / "live.json"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert len(json.loads((tmp_path / "live.json").read_text())["entries"]) == 3


def test_passages_are_looked_for_all_at_once(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None), (4, ""), (5, "THREE one")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "two"), ("b", "one two"), ("c", "none"), ("d", ""), ("e", None), ("f", "two")], "query_id string, text string")
    want = {("a", 1), ("a", 2), ("b", 1), ("f", 1), ("f", 2)}
    for block in (1, 1 << 20):
        assert {(r["query_id"], r["doc_id"]) for r in retrieval.containing(docs, asked, block).collect()} == want
    assert retrieval.containing(docs, asked.limit(0)).count() == 0 and retrieval.containing(docs.limit(0), asked).count() == 0


def test_queries_in_blocks(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"w{i % 5} w{i % 3} x") for i in range(40)], "chunk_id string, text string")
    queries = spark.createDataFrame([(i, f"w{i % 4} x x") for i in range(6)] + [(2, "w9")], "query_id long, text string")
    whole = {tuple(r) for r in retrieval.bm25(chunks, queries, 3).select("query_id", "chunk_id", F.round("score", 9), "rank").collect()}
    assert len(whole) == 18
    for block in (2, 3, 4):
        assert {tuple(r) for r in retrieval.bm25(chunks, queries, 3, block=block).select("query_id", "chunk_id", F.round("score", 9), "rank").collect()} == whole
    assert [len(x) for x in retrieval._asked(queries, 3)] == [3, 3] and [len(x) for x in retrieval._asked(queries.limit(0), 3)] == [0]


def test_broadcasts_are_bounded_by_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000,)] * 20, "text string")
    assert retrieval.small(rows) and not retrieval.small(rows, rows=19) and not retrieval.small(rows, most=10_000)


def test_resamples_in_blocks(monkeypatch):
    x = np.random.default_rng(1).random(37)
    whole = stats._resampled(x, 200, 7)
    assert np.array_equal(whole, x[np.random.default_rng(7).integers(0, 37, size=(200, 37))].mean(axis=1))
    monkeypatch.setattr(stats, "HELD", 100)
    assert np.array_equal(stats._resampled(x, 200, 7), whole)


def test_intervals_by_weights_are_near_those_by_draws(spark):
    x = np.random.default_rng(3).random(400)
    items = spark.createDataFrame([("m", f"i{i}", float(v)) for i, v in enumerate(x)] + [("one", "i", 2.0)], "metric string, item_id string, score double")
    got = {r["metric"]: r for r in stats.native_intervals(items, ["metric"]).collect()}
    lo, hi = stats.percentile_interval(x)
    assert abs(got["m"]["ci_lo"] - lo) < 0.01 and abs(got["m"]["ci_hi"] - hi) < 0.01 and got["m"]["n"] == 400
    assert (got["one"]["ci_lo"], got["one"]["ci_hi"], got["one"]["n"]) == (2.0, 2.0, 1)


def test_nearest_rank_of_any_values(spark):
    r = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 30), ("d", 3000)) for v in r.integers(0, 40 if k == "c" else 10**6, n)] + [("e", 7.0)] * 500 + [("a", None)]
    got = {x["k"]: (x["mean"], x["p95"]) for x in stats.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in "abcde":
        v = sorted(y for x, y in rows if x == k and y is not None)
        assert got[k] == (pytest.approx(sum(v) / len(v)), v[round(0.95 * (len(v) - 1))])


def test_frontier_against_all_pairs(spark):
    r = np.random.default_rng(6)
    rows = [(i, float(q), float(c)) for i, (q, c) in enumerate(zip(r.integers(0, 9, 300), r.integers(0, 60, 300), strict=True))] + [(300, 9.0, 60.0), (301, 9.0, 60.0)]
    got = {x["i"]: x["pareto"] for x in leaderboard.pareto(spark.createDataFrame(rows, "i int, quality double, cost double")).collect()}
    for i, q, c in rows:
        assert got[i] == (not any(b >= q and d <= c and (b > q or d < c) for _, b, d in rows))


def test_task_hash_is_that_of_its_lines_in_order(spark):
    import hashlib

    docs = [(f"d{i}", f"text {i}") for i in range(50)]
    items = [("i2", "q2", ["x", "y"], None), ("i1", "q1", ["z"], ["d1"])]
    got = repro.task_data_hash("t", spark.createDataFrame(items, "item_id string, question string, gold_answers array<string>, gold_passages array<string>").repartition(2), spark.createDataFrame(docs, "doc_id string, text string").repartition(5)).first()
    lines = "task_id:t\nitems:\ni1|q1|z,;d1,\ni2|q2|x,y,;\ncorpus:\n" + "".join(f"{d}|{hashlib.sha256(t.encode()).hexdigest()}\n" for d, t in sorted(docs))
    assert got["task_data_hash"] == hashlib.sha256(lines.encode()).hexdigest()


def test_reruns_that_miss_a_task_or_a_metric(spark):
    submitted = spark.createDataFrame([("a", "m", 0.0, 1.0), ("b", "m", 0.0, 1.0), ("c", "m", 0.0, 1.0), ("d", "m", 0.0, 1.0)], "task_id string, metric string, ci_lo double, ci_hi double")
    rerun = spark.createDataFrame([("a", "m", 0.5), ("b", "other", 0.5), ("c", "m", 2.0)], "task_id string, metric string, mean double")
    got = {r["task_id"]: r["reason"] for r in repro.verify_run(submitted, rerun).collect()}
    assert set(got) == {"b", "c", "d"} and "missing" in got["b"] and "outside" in got["c"] and "missing" in got["d"]


def test_dense_holds_few_products_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    e = rng.integers(-3, 4, (1500, 5)).astype(float)
    monkeypatch.setattr(retrieval, "TILE", 4000)
    best, sizes = retrieval._best, []
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "chunk_id long, embedding array<double>").coalesce(2)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e[:90])], "query_id long, embedding array<double>")
    want = {(q, c, r) for q in range(90) for r, c in enumerate(sorted(range(1500), key=lambda c: (-float(e[q] @ e[c]), c))[:7])}

    def looked(scores, *more):
        assert scores.size <= 4000, scores.shape
        return best(scores, *more)

    monkeypatch.setattr(retrieval, "_best", looked)
    got = retrieval.dense(vectors, queries, 7, block=60)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got.collect()} == want


def test_poisson_weights_by_groups_that_are_let_go(spark, monkeypatch):
    from hashlib import md5

    rows = [(f"m{i % 7}", None if i == 20 else str(i), None if i % 11 == 3 else i / 8) for i in range(70)]
    monkeypatch.setattr(stats, "GROUPS", 3)
    got = stats._resampled_means(spark.createDataFrame(rows, "metric string, item_id string, score double").coalesce(1), ["metric"], 10, 5, "item_id")
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()  # as many tasks as cores, however few bytes the items have
    want = []
    for m in range(7):
        n, s = np.zeros(12), np.zeros(12)
        for name, score in ((r[1], r[2]) for r in rows if r[0] == f"m{m}"):
            h = b"".join(md5(f"5:{b}{'' if name is None else ':' + name}".encode()).digest() for b in range(3))
            w = np.array([sum(int.from_bytes(h[4 * k : 4 * k + 4], "big") >= limit for limit in stats.LIMITS) for k in range(12)])
            n += w
            s += w * (score or 0)
        want += [(f"m{m}", round(x / y, 9) if y else None) for x, y in zip(s[:10], n[:10])]
    assert sorted(((r["metric"], None if r["m"] is None else round(r["m"], 9)) for r in got.collect()), key=str) == sorted(want, key=str)


def test_document_frequencies_are_shuffled_by_term_alone(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"alpha alpha w{i % 3} beta") for i in range(12)] + [("n", None)], "chunk_id string, text string")
    wanted = spark.createDataFrame([("alpha",), ("alpha",), ("w1",), ("absent",)], "term string")
    got = retrieval.document_frequencies(chunks, wanted)
    assert {r["term"]: r["df"] for r in got.collect()} == {"alpha": 12, "w1": 4}
    assert "chunk_id" not in got._jdf.queryExecution().optimizedPlan().aggregateExpressions().toString()


def test_terms_are_looked_up_for_few_rows_at_once(spark, monkeypatch):
    places, rows, most = retrieval._places, 1300, 512

    def looked(some, vocabulary):
        assert len(some) <= most
        return places(some, vocabulary)

    monkeypatch.setattr(retrieval, "_places", looked)
    chunks = spark.createDataFrame([(f"c{i:04}", "a " * (i % 5) + f"b w{i}") for i in range(rows)], "chunk_id string, text string").coalesce(1)
    got = retrieval.bm25(chunks, spark.createDataFrame([(1, "a w7")], "query_id int, text string"), 3).collect()
    assert sorted((r["rank"], r["chunk_id"]) for r in got) == [(0, "c0007"), (1, "c0004"), (2, "c0009")]
