"""How a scan is dealt to tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's place within its task in ``monotonically_increasing_id``.
_PLACE = 33


def spread(df: DataFrame) -> DataFrame:
    """A scan of few files, dealt to as many tasks as there are cores; a scan that has as many tasks already stays as it is.

    For scans and projections of scans alone: the number of tasks of anything
    behind a shuffle is Spark's to choose.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number", path: str | None = None) -> DataFrame:
    """``df`` with each row's place in ``order``, from 1, without one task that sees all rows.

    Rows are dealt to ranges, sorted there and written with their place in the
    range; the ranges, of which there are as many as tasks, are counted, and
    each one's beginning is added.  Rows that tie have one of the places that
    they share.
    """
    from plumbline.sources.scratch import work_dir

    spark = df.sparkSession
    path = path or work_dir(spark, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", _PLACE))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row a range
    begins = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_begin"))
    place = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1)) + 1
    return rows.join(F.broadcast(begins), "_range").withColumn(name, place).drop("_range", "_at", "_begin")
