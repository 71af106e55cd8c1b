"""An append-only table of answers, so that what a language model was asked once is not asked again.

A row is kept under a key that tells everything an answer depends on.  What
the table has not got is asked for by tasks of a few rows each, and a task's
answers are in the table as soon as the task has ended, whether the job ends
well or not: a lost executor or a second run asks for the rest alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task asks for at most; so many are asked for again if it fails.
PER_TASK = 32
#: The setting of a session that names the folder of its table of answers.
SETTING = "spark.plumbline.answers"


def folder(df: DataFrame, kind: str) -> str:
    """The session's folder of answers of a kind, or the empty string."""
    path = df.sparkSession.conf.get(SETTING, "")
    return f"{path.rstrip('/')}/{kind}" if path else ""


def key_of(*parts: Column) -> Column:
    """A digest of values; null and the empty string differ."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 256)


def _there(df: DataFrame, path: str) -> bool:
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return files.exists(where) and any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(where))


def kept(path: str, like: DataFrame) -> DataFrame | None:
    """The table's rows, one a key; None if there are none yet."""
    return like.sparkSession.read.parquet(path).dropDuplicates(["_key"]) if _there(like, path) else None


def through(rows: DataFrame, key: Column, path: str, ask: Callable[[DataFrame], DataFrame], per_task: int = PER_TASK) -> DataFrame:
    """``rows`` with the columns that ``ask`` adds, from the table where it has them.

    ``ask`` takes rows, a key each, and gives them with further columns; it is
    called for keys that the table has not got.  Answers of one key are shared.
    """
    keyed = rows.withColumn("_key", key)
    known = kept(path, rows)
    todo = keyed.dropDuplicates(["_key"])
    if known is not None:
        todo = todo.join(known.select("_key"), "_key", "left_anti")
    if n := todo.count():
        asked = ask(todo.repartition(-(-n // per_task), "_key"))
        added = [c for c in asked.columns if c not in keyed.columns]
        # with this committer a task's file is in its place when the task ends
        asked.select("_key", *added).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
        known = kept(path, rows)
    if known is None:  # nothing was asked, ever
        return ask(keyed).drop("_key")
    return keyed.join(known, "_key").drop("_key")
