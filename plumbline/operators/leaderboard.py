"""Leaderboard: entries from submissions, their quality, cost and tags, and the views of the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.metrics import VERBOSE
from plumbline.sources.scratch import work_dir


def task_metrics(submissions: DataFrame) -> DataFrame:
    """``pipeline_hash, task_id, metric, mean, ci_lo, ci_hi, n`` from parsed submissions."""
    tasks = submissions.select("pipeline_hash", F.explode("tasks").alias("task_id", "task"))
    each = tasks.select("pipeline_hash", "task_id", F.explode("task.metrics").alias("metric", "m"))
    return each.select("pipeline_hash", "task_id", "metric", F.col("m.mean").alias("mean"), F.get("m.ci_95", F.lit(0)).alias("ci_lo"), F.get("m.ci_95", F.lit(1)).alias("ci_hi"), F.col("m.n").alias("n"))


def operational(submissions: DataFrame) -> DataFrame:
    """``pipeline_hash, cost_per_query_usd_mean, latency_ms_p95``: mean over tasks of mean costs, and largest p95."""
    tasks = submissions.select("pipeline_hash", F.explode_outer("tasks").alias("task_id", "task"))
    return roll_up(tasks.select("pipeline_hash", F.col("task.cost_per_query_usd.mean").alias("cost"), F.col("task.latency_ms.p95").alias("latency")))


def roll_up(tasks: DataFrame, key: str = "pipeline_hash") -> DataFrame:
    """From a row for each pipeline and task with cost and latency."""
    return tasks.groupBy(key).agg(F.avg(F.coalesce("cost", F.lit(0.0))).alias("cost_per_query_usd_mean"), F.greatest(F.coalesce(F.max("latency"), F.lit(0.0)), F.lit(0.0)).alias("latency_ms_p95"))


def quality(metrics: DataFrame, key: str = "pipeline_hash") -> DataFrame:
    """``key, quality``: mean token_f1 over the tasks that report it, 0 if none does."""
    return metrics.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("metric") == "token_f1", F.col("mean"))), F.lit(0.0)).alias("quality"))


def verbose(metrics: DataFrame, key: str = "pipeline_hash", threshold: float = VERBOSE) -> DataFrame:
    """``key, verbose``: whether length_ratio is above the threshold in any task."""
    return metrics.groupBy(key).agg(F.coalesce(F.bool_or((F.col("metric") == "length_ratio") & (F.col("mean") > threshold)), F.lit(False)).alias("verbose"))


#: Parts in which a frontier is looked for first.
PARTS = 256


def pareto(entries: DataFrame, quality: str = "quality", cost: str = "cost", path: str | None = None) -> DataFrame:
    """``entries`` with pareto: no other entry is as good and as cheap, and better in one.

    Entries that tie in both are kept together.  Best qualities at each cost
    are dealt to ``PARTS`` parts by hash, and what is beaten in its own part by
    a lower cost goes.  What is left, which may be all, is dealt to ranges of
    cost: each range has its best quality carried on to the ranges behind it, of
    which there are as many as tasks, and is gone through on its own.
    """
    running = lambda by, value="_best": F.max(value).over(Window.partitionBy(*by).orderBy(F.col("_cost").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    best = entries.groupBy(F.col(cost).alias("_cost")).agg(F.max(quality).alias("_best"))
    best = best.withColumn("_cheaper", running([F.pmod(F.xxhash64("_cost"), F.lit(PARTS))])).where("_cheaper is null or _cheaper < _best").drop("_cheaper")
    where = path or work_dir(entries.sparkSession, "frontier")
    best.repartitionByRange(F.col("_cost").asc_nulls_first()).withColumn("_range", F.spark_partition_id()).write.parquet(where)
    ranged = entries.sparkSession.read.parquet(where)
    tops = ranged.groupBy("_range").agg(F.max("_best").alias("_top"))
    carried = tops.select("_range", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))  # a row a range
    cheaper = F.greatest(running(["_range"]), F.col("_carried"))
    front = ranged.join(F.broadcast(carried), "_range").withColumn("_cheaper", cheaper).where("_cheaper is null or _cheaper < _best").select("_cost", F.col("_best").alias("_front"))
    joined = entries.join(front, F.col(cost).eqNullSafe(F.col("_cost")), "left")
    return joined.withColumn("pareto", F.coalesce(F.col(quality) == F.col("_front"), F.lit(False))).drop("_front", "_cost")


def leaderboard(submissions: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """One entry a submission, with metrics by task, operational figures and tags.

    ``verified``: pipeline_hash of verified ones; None: all are.
    """
    metrics = task_metrics(submissions)
    costs = operational(submissions)
    frontier = pareto(
        submissions.select("pipeline_hash").distinct().join(quality(metrics), "pipeline_hash", "left").fillna(0.0, ["quality"])
        .join(costs.select("pipeline_hash", F.coalesce("cost_per_query_usd_mean", F.lit(0.0)).alias("cost")), "pipeline_hash"))
    by_task = metrics.groupBy("pipeline_hash", "task_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct("mean", "ci_lo", "ci_hi", "n"))))).alias("m"))
    by_entry = by_task.groupBy("pipeline_hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task_id", F.map_entries("m").alias("m"))))).alias("listed"))
    entries = submissions.join(by_entry, "pipeline_hash", "left").join(costs, "pipeline_hash").join(frontier.select("pipeline_hash", "quality", "pareto"), "pipeline_hash").join(verbose(metrics), "pipeline_hash", "left")
    if verified is None:
        entries = entries.withColumn("verified", F.lit(True))
    else:
        known = verified.select("pipeline_hash").distinct().withColumn("verified", F.lit(True))
        entries = entries.join(known, "pipeline_hash", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    tags = F.filter(F.array(F.when(F.col("pareto"), "pareto"), F.when(F.col("verbose"), "verbose")), lambda t: t.isNotNull())
    return entries.select(
        "pipeline_hash", "pipeline_name", "submitter", "verified", "submitted_at", F.col("listed").alias("metrics"),
        F.struct("cost_per_query_usd_mean", "latency_ms_p95").alias("operational"), F.coalesce(F.col("judge_ensemble.fingerprint"), F.lit("none")).alias("judge_fingerprint"), tags.alias("tags"), "quality")


SORTS = {"quality": F.desc, "cost": F.asc, "latency": F.asc}


def view(entries: DataFrame, sort: str = "quality", verified_only: bool = True) -> DataFrame:
    """Entries as the site lists them: by quality, best first, or by cost or latency, lowest first."""
    column = {"quality": "quality", "cost": "operational.cost_per_query_usd_mean", "latency": "operational.latency_ms_p95"}[sort]
    rows = entries.where("verified") if verified_only else entries
    return rows.orderBy(SORTS[sort](column), "pipeline_hash")


def scatter(entries: DataFrame, cost: str = "cost", quality: str = "quality", least: float = 1e-5) -> DataFrame:
    """``entries`` with x (log10 of the cost, placed between 0 and 1) and y (quality to the best one)."""
    floored = F.greatest(F.col(cost), F.lit(least))
    limits = entries.agg(F.log10(F.min(floored)).alias("_lo"), F.log10(F.max(floored)).alias("_hi"), F.max(quality).alias("_q"))
    x = F.when(F.col("_hi") > F.col("_lo"), (F.log10(floored) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    y = F.when(F.col("_q") > 0, F.col(quality) / F.col("_q")).otherwise(0.0)
    return entries.crossJoin(F.broadcast(limits)).withColumns({"x": x, "y": y}).drop("_lo", "_hi", "_q")  # one row of limits
