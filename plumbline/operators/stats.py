"""Aggregation of scores: means over seeds and items, bootstrap intervals, percentiles, agreement."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from hashlib import md5
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES = 2000
#: Draws that are held at once.
HELD = 1 << 22
#: A resample's weight of an item is the number of these limits that 32 bits of hash reach: a Poisson draw of mean 1.
LIMITS = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def item_means(scores: DataFrame, keys: Sequence[str] = ("task_id", "metric")) -> DataFrame:
    """``keys, item_id, score``: the mean over seeds, of the seeds in which the metric applies."""
    return scores.where("score is not null").groupBy(*keys, "item_id").agg(F.avg("score").alias("score"))


def means(items: DataFrame, keys: Sequence[str] = ("task_id", "metric")) -> DataFrame:
    """``keys, mean, n`` over items."""
    return items.groupBy(*keys).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


def percentile_interval(x: np.ndarray, resamples: int = RESAMPLES, seed: int = 0, confidence: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean, with numpy's generator; (nan, nan) for nothing, (x, x) for one value."""
    return _interval(x, resamples, seed, confidence, False)


def bca_interval(x: np.ndarray, resamples: int = RESAMPLES, seed: int = 0, confidence: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval; equal values give their mean twice."""
    return _interval(x, resamples, seed, confidence, True)


def _resampled(x: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Means of the resamples; some at a time, in the order of one stream of draws, so that memory is bounded."""
    draws, step = np.random.default_rng(seed), max(1, HELD // x.size)
    return np.concatenate([x[draws.integers(0, x.size, size=(min(step, resamples - k), x.size))].mean(axis=1) for k in range(0, resamples, step)])


def _interval(x: np.ndarray, resamples: int, seed: int, confidence: float, corrected: bool) -> tuple[float, float]:
    x = np.asarray(x, np.float64)
    if x.size == 0:
        return math.nan, math.nan
    if x.size == 1:
        return float(x[0]), float(x[0])
    return _limits(_resampled(x, resamples, seed), float(x.mean()), bool(np.ptp(x) == 0), _skewness(x) if corrected else None, confidence)


def _skewness(x: np.ndarray) -> float:
    """Of the means that leave one value out: the acceleration of the interval."""
    left_out = (x.sum() - x) / (x.size - 1)
    d = left_out.mean() - left_out
    spread = (d**2).sum()
    return float((d**3).sum() / (6 * spread**1.5)) if spread else 0.0


def _limits(drawn: np.ndarray, mean: float, flat: bool, skew: float | None, confidence: float = 0.95) -> tuple[float, float]:
    """The interval from the resamples' means; with ``skew`` bias-corrected and accelerated."""
    tails = np.array([(1 - confidence) / 2, (1 + confidence) / 2])
    if skew is not None:
        below = float((drawn < mean).mean())
        if flat or not 0 < below < 1:
            return float(drawn.min() if below else mean), float(drawn.max() if below else mean)
        normal = NormalDist()
        z0 = normal.inv_cdf(below)
        z = z0 + np.array([normal.inv_cdf(t) for t in tails])
        tails = np.array([normal.cdf(z0 + v / (1 - skew * v)) for v in z])
    lo, hi = np.percentile(drawn, tails * 100)
    return float(lo), float(hi)


def paired_p(a: np.ndarray, b: np.ndarray, resamples: int = 10_000, seed: int = 0) -> float:
    """Two-sided paired bootstrap p-value of equal means."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if a.shape != b.shape:
        raise ValueError("paired samples must have the same shape")
    drawn = _resampled(a - b, resamples, seed)
    return float(np.clip(2 * min((drawn >= 0).mean(), (drawn <= 0).mean()), 0, 1))


def with_intervals(items: DataFrame, keys: Sequence[str] = ("task_id", "metric"), resamples: int = RESAMPLES, seed: int = 0, method: str = "percentile", order: str | Sequence[str] = "item_id") -> DataFrame:
    """``keys, mean, ci_lo, ci_hi, n`` from one score an item, by numpy's generator over items in order.

    One group's scores are held by one task: a task's items are thousands, not a
    corpus.  ``native_intervals`` has no such bound.
    """
    of = {"percentile": percentile_interval, "bca": bca_interval}[method]
    kinds = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values([order] if isinstance(order, str) else list(order))["score"].to_numpy(np.float64)
        lo, hi = of(x, resamples, seed)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "mean": [float(x.mean())], "ci_lo": [lo], "ci_hi": [hi], "n": [len(x)]})

    return items.groupBy(*keys).applyInPandas(run, f"{kinds}, mean double, ci_lo double, ci_hi double, n bigint")


#: Draws of the generator's stream that are looked through at once for ones it rejects; an even number.
SEGMENT = 1 << 22


def _stream(seed: int, n: int, at: int, size: int) -> np.ndarray:
    """Of ``size`` 32-bit draws of the generator's stream from the even place ``at``: numbers below n, in order, without those rejected.

    numpy draws whole numbers below n by multiplying 32 bits of its stream by n
    and keeping the high half, unless the low half is below 2**32 modulo n.
    """
    bits = np.random.PCG64(seed)
    bits.advance(at // 2)
    product = bits.random_raw(size // 2).astype("<u8").view("<u4").astype(np.uint64) * np.uint64(n)
    return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64(2**32 % n)].astype(np.int64)


def exact_intervals(items: DataFrame, keys: Sequence[str] = ("task_id", "metric"), resamples: int = RESAMPLES, seed: int = 0, method: str = "percentile", order: str | Sequence[str] = "item_id", segment: int = SEGMENT, held: int = HELD) -> DataFrame:
    """What ``with_intervals`` gives, bit by bit, with the resamples of a group dealt to many tasks.

    The generator's one stream can be entered at any place.  How many of its
    draws are rejected before a place is not known beforehand, so a first pass
    counts those kept by segments of the stream, for each number of items that
    a group has.  Then each task enters the stream where its resamples begin.
    A task holds a group's scores, eight bytes an item, once for its share of
    the resamples, and ``held`` draws; a group has fewer than 2**31 items.
    """
    if method not in ("percentile", "bca"):
        raise ValueError(f"method must be percentile or bca, not {method!r}")
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    kinds = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("score").cast("double").alias("_score")))), lambda r: r["_score"])
    groups = items.groupBy(*keys).agg(ordered.alias("x")).withColumn("n", F.size("x").cast("bigint"))

    # accepted draws by segment, for each number of items
    sizes = groups.where("n > 1").select("n").distinct()
    # a draw is rejected with a probability below n / 2**32
    wanted = F.ceil(F.lit(resamples) * F.col("n") * (1 + 2 * F.col("n") / F.lit(2.0**32)) / segment) + 1
    segments = sizes.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), wanted - 1)).alias("segment")).repartition("n", "segment")

    def accepted(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kept = [len(_stream(seed, n, k * segment, segment)) for n, k in zip(f["n"].tolist(), f["segment"].tolist(), strict=True)]
            yield pd.DataFrame({"n": f["n"], "segment": f["segment"], "kept": kept})

    kept = segments.mapInPandas(accepted, "n bigint, segment bigint, kept bigint")
    kept = kept.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "kept"))), lambda r: r["kept"]).alias("kept"))

    rows = F.greatest(F.lit(1), (F.lit(held) / F.greatest(F.col("n"), F.lit(1))).cast("bigint"))
    # a row a group and core has the scores once, whatever the number of blocks of draws in its share
    cores = items.sparkSession.sparkContext.defaultParallelism
    share = F.col("rows") * F.ceil(F.ceil(F.lit(resamples) / F.col("rows")) / cores)
    blocks = groups.join(kept, "n", "left").withColumn("rows", rows).withColumn("share", share.cast("bigint"))
    blocks = blocks.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("n") > 1, F.lit(resamples - 1)).otherwise(0).cast("bigint"), F.col("share"))))

    def block(x: np.ndarray, n: int, first: int, many: int, ends: np.ndarray) -> np.ndarray:
        at = int(np.searchsorted(ends, first * n, "right"))
        skip, parts, have = first * n - int(ends[at - 1] if at else 0), [], 0
        while have < many * n + skip:
            parts.append(_stream(seed, n, at * segment, segment))
            have, at = have + len(parts[-1]), at + 1
        return x[np.concatenate(parts)[skip : skip + many * n].reshape(many, n)].mean(axis=1)

    def draw(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for own, n, first, many, share, segments_ in zip(f["x"], f["n"].tolist(), f["first"].tolist(), f["rows"].tolist(), f["share"].tolist(), f["kept"], strict=True):
                x = np.asarray(own, np.float64)
                means: np.ndarray = x
                if n > 1:
                    ends = np.cumsum(segments_)
                    last = min(first + share, resamples)
                    means = np.concatenate([block(x, n, k, min(many, last - k), ends) for k in range(first, last, many)])
                about = first == 0 and n > 0
                out.append((means.tolist(), float(x.mean()) if about else None, bool(np.ptp(x) == 0) if about else None, _skewness(x) if about and n > 1 else None))
            yield pd.DataFrame({**{k: f[k] for k in keys}, "n": f["n"], "first": f["first"], **{c: [o[i] for o in out] for i, c in enumerate(("means", "mean", "flat", "skew"))}})

    drawn = blocks.repartition(*keys, "first").mapInPandas(draw, f"{kinds}, n bigint, first bigint, means array<double>, mean double, flat boolean, skew double")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "means"))), lambda r: r["means"]))
    whole = drawn.groupBy(*keys).agg(F.max("n").alias("n"), listed.alias("means"), F.max("mean").alias("mean"), F.bool_or("flat").alias("flat"), F.max("skew").alias("skew"))

    def limits(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = [
                _limits(np.asarray(m, np.float64), mean, flat, skew if method == "bca" else None) if n > 1 else (m[0], m[0])
                for n, m, mean, flat, skew in zip(f["n"].tolist(), f["means"], f["mean"].tolist(), f["flat"].tolist(), f["skew"].tolist(), strict=True)
            ]
            yield pd.DataFrame({**{k: f[k] for k in keys}, "mean": f["mean"], "ci_lo": [b[0] for b in both], "ci_hi": [b[1] for b in both], "n": f["n"]})

    return whole.mapInPandas(limits, f"{kinds}, mean double, ci_lo double, ci_hi double, n bigint")


#: Groups whose sums a task holds at once.
GROUPS = 256


def _resampled_means(items: DataFrame, keys: Sequence[str], resamples: int, seed: int, item: str) -> DataFrame:
    """``keys, m``: a row a resample.  Items are weighed by a hash and added up where they lie: ``resamples`` sums a task are shuffled, never items."""
    keys = list(keys)
    blocks = -(-resamples // 4)
    kinds = "".join(f"`{k}` {items.schema[k].dataType.simpleString()}, " for k in keys)
    limits = np.array(LIMITS, np.uint64)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for row, n, s, known in held.values():
                own = [c.take(pa.array(np.zeros(resamples, np.int32))) for c in row.columns[: len(keys)]]
                sums = pa.array(s[:resamples], mask=~known[:resamples])
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(resamples, dtype=np.int32)), pa.array(n[:resamples]), sums], [*keys, "b", "n", "s"])
            held.clear()

        heads = [f"{seed}:{b}".encode() for b in range(blocks)]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, (score, name) in enumerate(zip(columns[-2], columns[-1], strict=True)):
                key = tuple(c[i] for c in columns[:-2])
                if key not in held:
                    if len(held) == GROUPS:
                        yield from told()
                    held[key] = batch.slice(i, 1), np.zeros(4 * blocks, np.int64), np.zeros(4 * blocks), np.zeros(4 * blocks, bool)
                _, n, s, known = held[key]
                tail = b"" if name is None else b":" + name.encode()
                drawn = np.frombuffer(b"".join([md5(h + tail).digest() for h in heads]), ">u4")
                w = np.searchsorted(limits, drawn, "right")
                n += w
                if score is not None:
                    s += w * score
                    known[:] = True
        yield from told()

    # a task's time is its items', which are few bytes: as many tasks as cores, whatever their size
    cores = items.sparkSession.sparkContext.defaultParallelism
    dealt = items.select(*keys, F.col("score").cast("double").alias("score"), F.col(item).cast("string").alias("_item")).repartition(cores, "_item")
    sums = dealt.mapInArrow(weigh, f"{kinds}b int, n bigint, s double").groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sums.select(*keys, (F.col("s") / F.when(F.col("n") > 0, F.col("n"))).alias("m"))


def native_intervals(items: DataFrame, keys: Sequence[str] = ("task_id", "metric"), resamples: int = RESAMPLES, seed: int = 0, item: str = "item_id") -> DataFrame:
    """``keys, mean, ci_lo, ci_hi, n`` by the Poisson bootstrap, for any number of items.

    An item's weight in resample b comes from ``md5(seed:b/4:item)``, of which
    each 32 bits give one resample's; a resample in which nothing was drawn
    does not count.
    """
    sizes = items.groupBy(*keys).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    drawn = _resampled_means(items, keys, resamples, seed, item)
    limits = drawn.groupBy(*keys).agg(F.expr("percentile(m, 0.025)").alias("ci_lo"), F.expr("percentile(m, 0.975)").alias("ci_hi"))
    return sizes.join(limits, list(keys)).select(*keys, "mean", "ci_lo", "ci_hi", "n")


def native_paired_p(pairs: DataFrame, resamples: int = RESAMPLES, seed: int = 0, item: str = "item_id") -> DataFrame:
    """One row ``p_value, n`` from item_id, a, b, by the same weights."""
    d = pairs.select(item, (F.col("a") - F.col("b")).alias("score"))
    m = F.round("m", 9)
    p = 2 * F.least(F.avg((m >= 0).cast("double")), F.avg((m <= 0).cast("double")))
    return _resampled_means(d, [], resamples, seed, item).agg(F.least(F.lit(1.0), p).alias("p_value")).crossJoin(d.agg(F.count(F.lit(1)).alias("n")))  # one row each


#: Values of a group up to which a sketch is not needed to find a rank among them.
SKETCHED = 20_000


def nearest_rank(values: DataFrame, keys: Sequence[str], value: str, q: float = 0.95) -> DataFrame:
    """``keys, mean, p95``: the value at place round(q * (n - 1)) of the sorted ones, halves to even; nulls do not count.

    A sketch that errs by n / 10,000 places gives two values between which it
    lies.  All that is below the first is counted as one, what is above the
    second is left out, and the values between both, a thousandth of them, are
    counted by value and put in order: no rows are sorted.
    """
    known = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    near = F.percentile_approx("_v", [max(0.0, q - 5e-4), min(1.0, q + 5e-4)], 10_000)
    edges = known.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("_n"), near.alias("_e"))
    edges = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "mean", "_n", "_e")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    met = known.join(edges, same) if keys else known.crossJoin(edges)  # without keys one row
    every = F.col("_n") <= SKETCHED
    inside = every | (F.col("_v") >= F.col("_e")[0])
    counted = met.where(every | (F.col("_v") <= F.col("_e")[1])).groupBy(*keys, F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("mean").alias("mean"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()))
    at = F.bround(F.lit(q) * (F.col("_n") - 1), 0).cast("long")
    return counted.withColumn("_upto", upto).groupBy(*keys).agg(F.first("mean").alias("mean"), F.min(F.when(F.col("_upto") > at, F.col("_v"))).alias("p95"))


def krippendorff(ratings: DataFrame, keys: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """``keys, alpha, n``: nominal agreement of two raters; null without ratings."""
    keys = list(keys)
    agree = ratings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) != F.col(b)).alias("differ"))
    pooled = ratings.select(*keys, F.explode(F.array(F.col(a), F.col(b))).alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    same = pooled.groupBy(*keys).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.count(F.lit(1)).alias("kinds"))
    both = agree.join(same, keys) if keys else agree.crossJoin(same)
    n, total = F.col("n"), 2 * F.col("n")
    expected = 1 - F.col("same") / (total * (total - 1))
    alpha = F.when(n == 0, None).when(n == 1, (F.col("differ") == 0).cast("double")).when((F.col("kinds") < 2) | (expected == 0), 1.0).otherwise(1 - (F.col("differ") / n) / expected)
    return both.select(*keys, alpha.alias("alpha"), "n")


def calibration(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From judge, task_family, verdict, gold_verdict: alpha by judge, by family and judge (null below two ratings), and counts of verdicts."""
    overall = krippendorff(judged, ["judge"], "verdict", "gold_verdict")
    family = krippendorff(judged, ["task_family", "judge"], "verdict", "gold_verdict").withColumn("alpha", F.when(F.col("n") >= 2, F.col("alpha")))
    return overall, family, judged.groupBy("judge", "verdict").agg(F.count(F.lit(1)).alias("n"))
