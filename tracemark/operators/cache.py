"""Result cache with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_entries(entries: DataFrame, now: Column, cache_type: str | None = None) -> DataFrame:
    """Entries that have not expired at `now`; entries without expiry stay."""
    kept = entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    return kept.filter(F.col("cache_type") == cache_type) if cache_type else kept


def expired_entries(entries: DataFrame, now: Column) -> DataFrame:
    """Entries to purge."""
    return entries.filter(F.col("expires_at") < now)


def lookup(requests: DataFrame, entries: DataFrame, payload: str, now: Column) -> DataFrame:
    """Requests (pos, cache_key, …) with the cached payload, or NULL and `hit = false` for what must be computed.

    The request position travels along, so answers keep the order of the questions.
    """
    fresh = valid_entries(entries, now).select("cache_key", payload, F.lit(True).alias("_hit"))
    found = requests.join(fresh, "cache_key", "left")
    return found.withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def answer(requests: DataFrame, entries: DataFrame, payload: str, compute: Column, now: Column) -> DataFrame:
    """Cached answers and freshly computed ones, with their request position."""
    found = lookup(requests, entries, payload, now)
    return found.withColumn(payload, F.when(F.col("hit"), F.col(payload)).otherwise(compute))


def touch(entries: DataFrame, reads: DataFrame) -> DataFrame:
    """Entries after a batch of reads (cache_key, read_at): access count and last access brought forward."""
    per_key = reads.groupBy("cache_key").agg(F.count("*").alias("_reads"), F.max("read_at").alias("_last"))
    merged = entries.join(per_key, "cache_key", "left")
    return merged.withColumns({
        "access_count": F.col("access_count") + F.coalesce("_reads", F.lit(0)),
        "last_accessed": F.coalesce("_last", "last_accessed"),
    }).drop("_reads", "_last")
