"""A leaderboard that follows a folder of submissions: a file stream whose batches rewrite the published file.

The engine has no other streams; this one keeps the leaderboard up to date as
submissions arrive, and starts again from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline import __version__
from plumbline.operators import leaderboard
from plumbline.sources import submissions


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Regenerate ``out`` whenever files arrive in ``folder``; ``once``: what is there now, and stop."""
    arrivals = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)

    def regenerate(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            entries = leaderboard.leaderboard(submissions.read_submissions(batch.sparkSession, folder))
            submissions.write_leaderboard(entries, out, __version__)

    writer = arrivals.writeStream.foreachBatch(regenerate).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
