"""Batch-job counters kept up to date as results arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_counters(results: DataFrame) -> DataFrame:
    """Files done, completed and failed per job, for `update` mode."""
    return results.groupBy("job_id").agg(F.count("*").alias("processed"), F.count_if(F.col("error").isNull()).alias("completed"),
                                         F.count_if(F.col("error").isNotNull()).alias("failed"))


def keep_counters(results: DataFrame, folder: str, checkpoint: str):
    """Write every change of the counters under its batch number; replays overwrite."""
    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return job_counters(results).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counters(changes: DataFrame) -> DataFrame:
    """Latest counters of every job from the written changes (with their `epoch`)."""
    newest = F.max_by(F.struct("processed", "completed", "failed"), "epoch").alias("c")
    return changes.groupBy("job_id").agg(newest).select("job_id", "c.*")
