import numpy as np
import pytest

from plumbline.operators import stats


def test_the_stream_is_numpys():
    for n in (2, 3, 10, 1000, 70_001):
        want = np.random.default_rng(5).integers(0, n, size=3000)
        assert np.concatenate([stats._stream(5, n, k, 500) for k in range(0, 4000, 500)])[:3000].tolist() == want.tolist()


@pytest.mark.parametrize("method", ["percentile", "bca"])
def test_dealt_resamples_are_bit_for_bit_those_of_one_stream(spark, method):
    rng = np.random.default_rng(1)
    groups = {"one": [0.25], "two": [0.0, 1.0], "flat": [0.5] * 9, "odd": rng.beta(2, 5, 37).tolist(), "some": rng.normal(size=1200).tolist()}
    rows = [(k, f"{i:05}", x) for k, own in groups.items() for i, x in enumerate(own)]
    frame = spark.createDataFrame(rows, "metric string, item_id string, score double").repartition(5)
    want = {r["metric"]: tuple(r) for r in stats.with_intervals(frame, ["metric"], 300, 7, method).collect()}
    for segment, held in ((1 << 16, 1 << 15), (1 << 12, 2000)):
        got = stats.exact_intervals(frame.repartition(3), ["metric"], 300, 7, method, segment=segment, held=held).collect()
        assert {r["metric"]: tuple(r) for r in got} == want
    assert stats.exact_intervals(frame.limit(0), ["metric"]).count() == 0
    with pytest.raises(ValueError):
        stats.exact_intervals(frame, method="student")


def test_draws_that_the_generator_rejects(spark):
    """A group so large that some tens of its draws are rejected."""
    n = 90_001
    frame = spark.range(n).selectExpr("'m' AS metric", "id AS item_id", "CAST(pmod(xxhash64(id), 1000) AS DOUBLE) / 1000 AS score")
    assert 2**32 % n > 0 and len(stats._stream(0, n, 0, 1 << 22)) < 1 << 22
    got = stats.exact_intervals(frame, ["metric"], 60, segment=1 << 20, held=1 << 20).first()
    x = np.array([r["score"] for r in frame.orderBy("item_id").collect()])
    assert (got["ci_lo"], got["ci_hi"]) == stats.percentile_interval(x, 60) and got["n"] == n


def test_scores_are_carried_once_a_core(spark):
    items = spark.createDataFrame([("m", i, float(i % 17)) for i in range(600)], "metric string, item_id int, score double")
    got = stats.exact_intervals(items, ["metric"], 200, held=600)  # 200 blocks of one resample
    assert "share" in got._jdf.queryExecution().analyzed().toString()
    r, x = got.first(), np.array([float(i % 17) for i in range(600)])
    assert (r["ci_lo"], r["ci_hi"]) == stats.percentile_interval(x, 200)
