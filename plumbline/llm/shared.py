"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``).

Intermediate results that are read more than once are written there, so that a
lost executor costs a re-read and not a re-run.  Where the setting is absent
and the master is local (tests, a laptop), a folder of this machine is set; on
a cluster its absence is an error, since executors would write to disks of
their own.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between the driver's collections of garbage.
LET_GO = 0.1

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints; one is set only where the session has none."""
    known = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + os.path.join(tempfile.gettempdir(), "plumbline-shared")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder: small tables that are read several times."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused folder below the shared one; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back: large tables that are read several times.

    Shuffle files behind ``df`` are of no more use if nobody else holds it.
    Executors keep them until the driver has collected its garbage, so it is
    asked to: by the next stage their space is free.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    del df
    gc.collect()
    for _ in range(2):  # what the first finds is let go of before the second
        spark.sparkContext._jvm.System.gc()
        time.sleep(LET_GO)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            remove(spark, path)
