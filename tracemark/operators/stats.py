"""Catalogue, cache and batch statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.operators.ranking import running_totals
from tracemark.session import materialise


def hash_statistics(hashes: DataFrame) -> DataFrame:
    """Number of hashes and of files per hash type, and over all types (hash_type `all`).

    Files are reduced to one row per (file, type) first, so that the distinct count never gathers in one place.
    """
    per_file = hashes.groupBy("file_id", "hash_type").agg(F.count("*").alias("n"))
    per_type = per_file.groupBy("hash_type").agg(F.sum("n").alias("hashes"), F.count("*").alias("files"))
    per_any = per_file.groupBy("file_id").agg(F.sum("n").alias("n"))
    total = per_any.agg(F.sum("n").alias("hashes"), F.count("*").alias("files"))
    return per_type.unionByName(total.select(F.lit("all").alias("hash_type"), "hashes", "files"))


def file_statistics(files: DataFrame) -> DataFrame:
    """Counts by type, by status and in total from one pass; sizes count active files, averages divide by all."""
    active = F.sum(F.when(F.col("status") == "active", F.col("file_size")).otherwise(0))
    sets = files.groupingSets([["file_type"], ["status"], []], "file_type", "status").agg(
        F.grouping_id().alias("g"), F.count("*").alias("files"), active.alias("active_size"))
    return sets.select(
        F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "status").otherwise("total").alias("scope"),
        F.coalesce("file_type", "status", F.lit("all")).alias("name"),
        "files", "active_size", F.round(F.col("active_size") / F.col("files"), 6).alias("average_size"),
    )


def cache_statistics(entries: DataFrame, now: Column) -> DataFrame:
    """Entries, expired entries and share of entries read more than once, per cache type and in total."""
    sets = entries.rollup("cache_type").agg(
        F.count("*").alias("entries"), F.count_if(F.col("expires_at") < now).alias("expired"),
        F.count_if(F.col("access_count") > 1).alias("reused"))
    return sets.select(F.coalesce("cache_type", F.lit("all")).alias("cache_type"), "entries", "expired",
                       F.round(F.col("reused") / F.col("entries"), 6).alias("hit_potential"))


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count, column count and column names per table."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
            F.lit(",".join(df.columns)).alias("column_names"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def exact_median(rows: DataFrame, key: str, value: str, name: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median per key without sorting a whole group in one task.

    A sketch brackets the middle of every group; rows below the bracket are only counted, rows inside it are
    reduced to distinct values with counts and ranked block by block. The sketch's rank error is below 1/accuracy, so the
    bracket always holds the median and about a thousandth of the group (plus ties, which share one row), and no task ranks a whole bracket.
    """
    step = 3.0 / accuracy
    valued = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    bounds = F.percentile_approx("v", [0.5 - step, 0.5 + step], accuracy)
    lows = valued.groupBy("k").agg(bounds.alias("b"), F.count("*").alias("n")).select(
        "k", "n", F.get("b", F.lit(0)).alias("low"), F.get("b", F.lit(1)).alias("high"))
    placed = valued.join(materialise(lows, "median-brackets"), "k").withColumn("v", F.when(F.col("v") >= F.col("low"), F.col("v"))).filter("v is null or v <= high")
    counts = placed.groupBy("k", "v", "n").agg(F.count("*").alias("c"))
    ranked = running_totals(counts, ["k"], ["v"], "c", "upto")  # the row of those below has no value and comes first
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return ranked.groupBy("k").agg(((at(first) + at(second)) / 2).alias(name)).withColumnRenamed("k", key)


def batch_statistics(results: DataFrame, key: str = "job_id") -> DataFrame:
    """Outcome counts and confidence and time statistics of every batch.

    Fake, duplicate and authentic exclude each other in this order and count successes only, as do the
    confidence and time statistics. The deviation is that of the whole population.
    """
    ok = F.col("error").isNull()
    fake = F.coalesce("is_fake", F.lit(False))
    duplicate = F.coalesce("is_duplicate", F.lit(False))
    good = lambda c: F.when(ok, F.col(c))
    totals = results.groupBy(key).agg(
        F.count("*").alias("total_processed"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & fake).alias("fake_detected"),
        F.count_if(ok & ~fake & duplicate).alias("duplicate_detected"),
        F.count_if(ok & ~fake & ~duplicate).alias("authentic"),
        F.avg(good("confidence")).alias("mean_confidence"),
        F.stddev_pop(good("confidence")).alias("std_confidence"),
        F.min(good("confidence")).alias("min_confidence"),
        F.max(good("confidence")).alias("max_confidence"),
        F.sum(good("processing_time")).alias("total_time"),
        F.avg(good("processing_time")).alias("mean_time"),
        F.min(good("processing_time")).alias("fastest"),
        F.max(good("processing_time")).alias("slowest"),
    )
    successes = results.filter(ok)
    medians = exact_median(successes, key, "confidence", "median_confidence").join(
        exact_median(successes, key, "processing_time", "median_time"), key, "full")
    return totals.join(medians, key, "left")


def error_counts(results: DataFrame, key: str = "job_id") -> DataFrame:
    return results.filter(F.col("error").isNotNull()).groupBy(key, "error").agg(F.count("*").alias("n"))


def export_summary(results: DataFrame, key: str) -> DataFrame:
    """Summary written next to an export: fake and duplicate counts and all means run over every row."""
    return results.groupBy(key).agg(
        F.count("*").alias("total_processed"),
        F.count_if(F.col("error").isNull()).alias("successful_analyses"),
        F.count_if(F.col("error").isNotNull()).alias("failed_analyses"),
        F.count_if("is_fake").alias("fake_detections"),
        F.count_if("is_duplicate").alias("duplicate_detections"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.stddev_pop("confidence").alias("confidence_std"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.avg("processing_time").alias("average_processing_time"),
        F.sum("processing_time").alias("total_processing_time"),
    )


def report_percentages(stats: DataFrame) -> DataFrame:
    """Shares of a batch in percent; an empty denominator counts as one."""
    share = lambda part, whole: F.col(part) * 100.0 / F.greatest(F.col(whole), F.lit(1))
    return stats.select(
        "*", share("successful", "total_processed").alias("successful_pct"), share("failed", "total_processed").alias("failed_pct"),
        share("fake_detected", "successful").alias("fake_pct"), share("duplicate_detected", "successful").alias("duplicate_pct"))


def job_status(results: DataFrame) -> DataFrame:
    """Completed and failed files, start, end and duration of every job."""
    return results.groupBy("job_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("error").isNull()).alias("completed_files"),
        F.count_if(F.col("error").isNotNull()).alias("failed_files"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
    ).withColumn("duration", (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6)


def confidence_histogram(rows: DataFrame, value: str = "confidence", bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows per equal-width bin; the upper edge belongs to the last bin."""
    bin_no = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return rows.filter(F.col(value).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))


def model_agreement(results: DataFrame) -> DataFrame:
    """Mean, population deviation and share above one half of each row's model confidences."""
    scores = F.transform(F.map_values("model_predictions"), lambda p: p["confidence"])
    n = F.size("s")
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda acc, v: acc + f(v))
    with_mean = results.select("item_id", scores.alias("s")).filter(n > 0).withColumn("mean_confidence", total(lambda v: v) / n)
    mean = F.col("mean_confidence")
    return with_mean.select(
        "item_id", "mean_confidence", F.sqrt(total(lambda v: (v - mean) * (v - mean)) / n).alias("std_confidence"),
        (F.size(F.filter("s", lambda v: v > 0.5)) / n).alias("model_agreement"))


# Error classes that count as critical.
CRITICAL_ERRORS = ["MemoryError", "SystemError", "OSError", "RuntimeError"]


def error_statistics(results: DataFrame) -> DataFrame:
    """Errors per type with the last time seen, and whether the type is critical."""
    return results.filter(F.col("error").isNotNull()).groupBy("error").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_time")).withColumn("critical", F.col("error").isin(CRITICAL_ERRORS))


def processing_statistics(requests: DataFrame) -> DataFrame:
    """Hit rate, duplicates per file and mean batch time from rows (batch, hit, duplicates, seconds)."""
    batches = requests.groupBy("batch").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        F.sum("duplicates").alias("duplicates"), F.sum("seconds").alias("seconds"), F.count("*").alias("files"))
    return batches.agg(
        F.sum("files").alias("processed_files"), F.sum("hits").alias("cache_hits"), F.sum("misses").alias("cache_misses"),
        F.try_divide(F.sum("hits"), F.sum("hits") + F.sum("misses")).alias("cache_hit_rate"),
        F.try_divide(F.sum("duplicates"), F.sum("files")).alias("duplicates_per_file"),
        F.avg("seconds").alias("avg_batch_time"), F.sum("seconds").alias("total_processing_time"))
