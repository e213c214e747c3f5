"""The training-data pipeline: identify languages, judge quality, drop near-duplicates, pack what is left.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame. `run` writes each result as Parquet to the shared
folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.llm import language_codes, length_buckets, near_dups, quality_rules
from tracemark.llm.common import id_remainder
from tracemark.session import materialise

#: Estimation and connected components have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language can't be told."""
    learnt = docs.where(~F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(True))).select("doc_id", "text", "lang")
    return language_codes.keep_known(docs, language_codes.fit(learnt))


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that fail the base rules or are more likely bad than good."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return near_dups.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut into pieces, put into length buckets and batches."""
    return length_buckets.pack_documents(docs)


STAGES = [("language", identify_language), ("quality", judge_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
