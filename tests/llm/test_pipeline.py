from collections import Counter

import corpus_pipeline
from plumbline.llm import decontaminate, queries
from tests.llm import cases
from tests.llm.test_rules_counts_and_scans import library, verdict


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(cases.rows(), cases.COLUMNS).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(cases.ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] if k < 4 else docs.collect()
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rules, single, clean, mixed, ids = seen.values()
    assert Counter(rules) == Counter((i, t, s) for i, t, _, s, *_ in cases.rows() if verdict(t))
    assert Counter(single) <= Counter(rules) and {t for _, t, _ in single} >= {t for _, t, _ in rules if sum(cases.jaccard(cases.shingles(t), cases.shingles(u)) >= 0.8 for _, u, _ in rules) == 1}
    assert all(cases.jaccard(cases.shingles(t), cases.shingles(u)) < 0.8 for n, (_, t, _) in enumerate(single) for _, u, _ in single[:n])
    matcher = decontaminate.Matcher(cases.ITEMS)
    assert Counter(clean) == Counter(r for r in single if not matcher.find(r[1])) and len(clean) < len(single)
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2
    assert Counter((r["doc_id"], r["n_tokens"]) for r in ids) == Counter((i, len(library(t)) + 1) for i, t, _ in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, ids)) and len(stages) == 5


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
