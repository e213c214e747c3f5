"""User functions run by Spark: per-item processors with error capture, model scoring, frame extraction, exports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def process_items(items: DataFrame, key: str, processor: Callable[[pd.Series], str]) -> DataFrame:
    """Run `processor` on every row; an exception fails its own row only."""
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                started = time.perf_counter()
                try:
                    outcome = (processor(row), True, None)
                except Exception as error:
                    outcome = (None, False, f"{type(error).__name__}: {error}")
                out.append((row[key], *outcome, time.perf_counter() - started))
            yield pd.DataFrame(out, columns=[key, "result", "success", "error", "seconds"])

    return items.mapInPandas(run, f"{key} {kind}, result string, success boolean, error string, seconds double")


def extract_frames(videos: DataFrame, key: str, extractor: Callable[[pd.Series], Iterable[tuple]], fields: str) -> DataFrame:
    """Rows made by `extractor` from every row: none, one or many tuples of `fields`."""
    names = [f.strip().split()[0] for f in fields.split(",")]
    kind = dict(videos.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(row[key], *values) for _, row in batch.iterrows() for values in extractor(row)]
            yield pd.DataFrame(made, columns=[key, *names])

    return videos.mapInPandas(run, f"{key} {kind}, {fields}")


def model_score(loader: Callable[[], Callable[[pd.Series], pd.Series]]) -> Callable[[Column], Column]:
    """Column function of a model that each Python worker loads once and uses for all its batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for batch in batches:
            yield model(batch)

    return score


def hash_with(function: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """Column function of a user's own content hash."""

    @F.pandas_udf("string")
    def hashed(content: pd.Series) -> pd.Series:
        return content.map(function)

    return hashed


def export_each(results: DataFrame, export: Callable[[dict], None]) -> None:
    """Hand every row to a user's export function on the executors."""
    def run(rows) -> None:
        for row in rows:
            export(row.asDict(recursive=True))

    results.foreachPartition(run)


def export_parts(results: DataFrame, key: str, render: Callable[[dict], bytes], folder: str) -> None:
    """Write what `render` makes of every row under `folder`, a file a task, such that every row comes once however often tasks are tried.

    An attempt writes to a file of its own. Its commit marker (file, rows, failed rows) is an output row of the task, so Spark keeps the marker of one attempt
    of each task, and `exported_files` names the files of these alone. A row whose rendering fails is listed with its error and fails alone.
    `folder` is one that every executor reaches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        name, rows, failed = f"part-{context.partitionId():05d}-{context.taskAttemptId()}", 0, []
        system.create_dir(f"{base}/parts", recursive=True)
        with system.open_output_stream(f"{base}/parts/{name}") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    try:
                        data = render(row)
                    except Exception as error:
                        failed.append({"key": str(row[key]), "error": f"{type(error).__name__}: {error}"})
                        continue
                    out.write(data)
                    rows += 1
        yield pa.RecordBatch.from_pylist([{"file": name, "rows": rows, "failed": failed}], schema=pa.schema([
            ("file", pa.string()), ("rows", pa.int64()), ("failed", pa.list_(pa.struct([("key", pa.string()), ("error", pa.string())])))]))

    results.mapInArrow(run, COMMITS).write.mode("overwrite").parquet(f"{folder}/commits")


COMMITS = "file string, rows long, failed array<struct<key: string, error: string>>"


def exported_files(spark: SparkSession, folder: str) -> DataFrame:
    """Commit markers of an export: file, rows, failed."""
    return spark.read.schema(COMMITS).parquet(f"{folder}/commits")


def exported_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines (`value`) of the committed files of an export; files that attempts left behind are passed over."""
    lines = spark.read.text(f"{folder}/parts").select("value", F.col("_metadata.file_name").alias("file"))
    return lines.join(exported_files(spark, folder).select("file"), "file", "left_semi").select("value")


SQL_FUNCTIONS = {
    "char_hamming": "(a STRING, b STRING) RETURNS INT RETURN CASE WHEN length(a) = length(b) THEN "
                    "aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> CASE WHEN x = y THEN 0 ELSE 1 END), 0, (s, v) -> s + v) END",
    "bit_hamming": "(a STRING, b STRING) RETURNS INT RETURN bit_count(CAST(conv(a, 16, -10) AS BIGINT) ^ CAST(conv(b, 16, -10) AS BIGINT))",
    "hash_similarity": "(distance INT, digits INT) RETURNS DOUBLE RETURN coalesce(1.0D - try_divide(CAST(distance AS DOUBLE), digits * 4), 0.0D)",
    "confidence_tier": "(distance INT) RETURNS STRING RETURN CASE WHEN distance <= 2 THEN 'high' WHEN distance <= 5 THEN 'medium' ELSE 'low' END",
    "youtube_id": "(url STRING) RETURNS STRING RETURN coalesce("
                  "nullif(regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, 'youtu[.]be/([A-Za-z0-9_-]{11})', 1), ''), "
                  "nullif(regexp_extract(url, 'youtube[.]com/embed/([A-Za-z0-9_-]{11})', 1), ''), nullif(regexp_extract(url, '^([A-Za-z0-9_-]{11})$', 1), ''))",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Make the fingerprint and text functions callable from SQL; they are expanded into the plan."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
