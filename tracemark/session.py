"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tracemark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a scratch folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    return _local_scratch(spark.sparkContext.applicationId)


@cache
def _local_scratch(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def new_folder(spark: SparkSession, label: str) -> str:
    """Path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tracemark/{label}-{uuid.uuid4().hex}"


def mounted_folder(spark: SparkSession, label: str) -> str | None:
    """A new folder in the shared folder as the machines' own file systems name it; None if Spark alone reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_folder(spark, label))
    return path.toUri().getPath() if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file" else None


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in `path`; none if it doesn't exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in system.listStatus(folder) if f.isDirectory()) if system.exists(folder) else []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where several branches of one plan need the same expensive intermediate: the rows survive
    the loss of any executor, and the rewritten scan carries real sizes for the join planner. Used as well for
    one-row-per-group tables that are joined back to their rows: adaptive execution splits a hot group of a join
    between two scans, but not of a join with an aggregation on one side.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(stored: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast a stored table of short rows when it is small enough, else leave the join to the planner."""
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


def spread(df: DataFrame) -> DataFrame:
    """Spread a plain scan over the idle cores before heavy row-local work.

    A small table sits in fewer splits than there are cores; a large one does not and is left as it is.
    Only for scans and projections of scans: counting the splits of a plan with a shuffle would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key into the configured number of shuffle partitions.

    The explicit number keeps small but compute-heavy inputs from being packed into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
