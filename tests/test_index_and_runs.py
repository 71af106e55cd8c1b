import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.partitions import numbered
from plumbline.operators import index, repro, retrieval
from plumbline.plans import pipeline, queries
from plumbline.sources import tasks


def corpus(spark, n=400, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    topic = lambda i: words[(i // 20 * 7) % 100 : (i // 20 * 7) % 100 + 20]
    rows = [(f"c{i:04}", i % 7, " ".join(r.choices(topic(i), k=r.randint(0, 40)))) for i in range(n)]
    rows += [("null", 0, None), ("empty", 1, ""), ("twin-b", 2, "w1 w2 w3 w3"), ("twin-a", 3, "w1 w2 w3 w3")]
    chunks = spark.createDataFrame(rows, "chunk_id string, place int, text string").repartition(3).sortWithinPartitions("chunk_id")
    asked = [(q, " ".join(r.choices(topic(r.randrange(n)), k=r.randint(1, 6)))) for q in range(40)] + [(100, "w1 w3"), (101, None), (102, "nowhere"), (103, "W1, w1")]
    return chunks, spark.createDataFrame([*asked, (100, "w5")], "query_id int, text string").coalesce(1)


def test_a_search_that_skips_blocks_finds_the_same(spark, tmp_path):
    chunks, queries = corpus(spark)
    saved = index.build(chunks, ["place"]).save(str(tmp_path / "index"))
    assert index.Index.load(spark, str(tmp_path / "index")).columns == ("chunk_id", "place") and saved.rows.where("size(chunk_id) > 16").isEmpty()
    for k, tie in ((1, ("chunk_id",)), (5, ("place", "chunk_id")), (1000, ("chunk_id",))):
        found = index.search(saved, queries, k, tie=tie, block=16)
        got = {(r["query_id"], r["rank"]): (r["chunk_id"], pytest.approx(r["score"])) for r in found.hits.collect()}
        want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.bm25(chunks, queries, k, tie=tie, keep=("place",)).collect()}
        assert want == got
        work = found.work().first()
        assert 0 < work["n_shards_read"] <= work["n_shards"] and work["n_read"] <= work["n_blocks"]
        assert k > 5 or work["n_read"] < work["n_blocks"]
    with pytest.raises(ValueError):
        index.search(saved, queries, 3, tie=("ordinal",))
    assert index.search(index.build(chunks.limit(0)), queries, 3).hits.count() == 0 and index.search(saved, queries.limit(0), 3).hits.count() == 0


def test_scopes_are_corpora_of_their_own(spark):
    chunks, queries = corpus(spark, 120)
    scoped = chunks.withColumn("task_id", F.concat(F.lit("t"), F.col("place") % 3)).cache()
    asked = queries.dropDuplicates(["query_id"]).withColumn("task_id", F.concat(F.lit("t"), F.col("query_id") % 3)).cache()
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], pytest.approx(r["score"])) for r in retrieval.bm25_by_scope(scoped, asked, 4).collect()}
    want = {}
    for t in ("t0", "t1", "t2"):
        own = retrieval.bm25(scoped.where(F.col("task_id") == t), asked.where(F.col("task_id") == t), 4)
        want |= {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in own.collect()}
    assert want == got
    r = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, f"t{i % 3}", r.normal(size=4).tolist()) for i in range(60)], "chunk_id int, task_id string, embedding array<double>")
    near = retrieval.dense(vectors, vectors.withColumnRenamed("chunk_id", "query_id"), 5, scope="task_id").collect()
    assert len(near) == 300 and all(x["query_id"] % 3 == x["chunk_id"] % 3 for x in near)


def test_rows_are_numbered_by_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i * 7919 % 1000:04}", i % 3) for i in range(1000)], "id string, g int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be put together
    got = numbered(rows, ["id"], path=str(tmp_path / "n"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["id"], r["number"]) for r in got.orderBy("id").collect()] == [(f"{i:04}", i + 1) for i in range(1000)]
    assert got.columns == ["id", "g", "number"]
    # no task wrote all rows
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "n")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 900
    ties = numbered(rows, [F.desc("g"), "id"], "place").collect()
    assert [r["id"] for r in sorted(ties, key=lambda r: r["place"])] == [r["id"] for r in sorted(ties, key=lambda r: (-r["g"], r["id"]))]
    assert numbered(rows.limit(0), ["id"]).count() == 0


def test_places_come_from_qualities_as_sql_rounds_them(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    # 64.0015 * 1000 lies below 64001.5, and 51.349999999999994 * 10 on 513.5
    values = {1: 64.0015, 2: 64.002, 3: 64.5, 4: 64.0, 5: 51.349999999999994}
    rows = [(2 * user + i, user, "view", value) for user, value in values.items() for i in (0, 1)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("leaderboard_view", "leaderboard_rollup", "pareto_front", "pareto_scatter"):
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(con.sql(queries.SQL[name]).fetchall()), name
    places = {r["pipeline_hash"]: r["place"] for r in queries.leaderboard_view(spark, str(tmp_path)).collect()}
    assert sorted(places, key=places.get) == ["3", "2", "1", "4", "5"]


def test_items_are_held_out_by_their_ids(spark):
    for n in (0, 1, 4, 5, 23):
        items = spark.createDataFrame([(i,) for i in range(n)], "item_id int")
        ids = sorted(map(str, range(n)))
        held = {str(r["item_id"]) for r in tasks.split_items(items, "holdout").collect()}
        assert held == set(ids[n - n // 5 :] if n // 5 else []) and tasks.split_items(items, "public").count() == n - len(held)


CONFIG = {"name": "x", "chunker": {"type": "recursive", "chunk_size": 500, "overlap": 50}, "retriever": {"type": "bm25"}, "reranker": {"type": "lexical-overlap"}, "generator": {"type": "extractive"}, "retriever_top_k": 10, "reranker_top_k": 3}


def test_tasks_together_give_what_each_gives(spark):
    listed = [tasks.get_task(t) for t in ("synthetic-10", "unanswerable-qa", "counterfactual-qa")]
    run = pipeline.Runner(pipeline.compose(CONFIG), (0, 1), "all")
    together = run.run(spark, listed)
    for t in listed:
        alone = run.run_task(spark, t)
        both = [{k: v for k, v in x.items() if k != "wall_time_s"} for x in (alone, together[t.spec.id])]
        assert both[0] == both[1]
        assert alone["task_data_hash"] == repro.task_data_hash(t.spec.id, t.items(spark, "all"), t.corpus(spark)).first()["task_data_hash"]
    assert run.run(spark, []) == {}


def test_dense_and_hybrid_runs_of_several_tasks(spark):
    pipeline.ENCODERS["lengths"] = lambda name: lambda ts: np.array([[len(t), 1.0 + t.count("e"), t.count("a")] for t in ts], float)
    for retriever in ({"type": "dense", "model": "lengths"}, {"type": "hybrid", "dense": {"type": "dense", "model": "lengths"}}):
        run = pipeline.Runner(pipeline.compose(CONFIG | {"retriever": retriever}), (0,), "all")
        both = [tasks.get_task(t) for t in ("synthetic-10", "counterfactual-qa")]
        together = run.run(spark, both)
        for t in both:
            assert run.run_task(spark, t)["metrics"] == together[t.spec.id]["metrics"]
