"""Export sinks. Every sink writes a folder of part files from the executors; nothing passes the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemark.operators import reporting, stats


def export_json(results: DataFrame, path: str) -> None:
    """One JSON document per result: routed scalar fields, metadata and model outputs."""
    scalars = [f.name for f in results.schema if isinstance(f.dataType, T.AtomicType) and f.name != "item_id"]
    payload = F.create_map(*[x for c in scalars for x in (F.lit(c), F.col(c).cast("string"))])
    document = F.struct(
        "item_id",
        F.struct(F.lit("json").alias("format"), F.lit("1.0").alias("version"), F.current_timestamp().alias("timestamp")).alias("export_info"),
        reporting.route_keys(F.map_filter(payload, lambda _, v: v.isNotNull())).alias("technical_analysis"),
        *[F.col(c) for c in results.columns if c not in scalars and c != "item_id"],
    )
    results.select(F.to_json(document).alias("value")).write.mode("overwrite").text(path)


def export_csv(results: DataFrame, path: str, list_length: int = 5) -> None:
    reporting.flatten(results, list_length).write.mode("overwrite").option("header", True).csv(path)


def export_xml(results: DataFrame, path: str) -> None:
    """`TechnicalAnalysis` root with one `Data` element per result. Maps become JSON text, as XML tags must be known."""
    flat = results.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.MapType) else
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.TimestampNTZType,)) else F.col(f.name)
        for f in results.schema])
    flat.write.mode("overwrite").format("xml").option("rootTag", "TechnicalAnalysis").option("rowTag", "Data").save(path)


def export_sheets(results: DataFrame, folder: str) -> list[str]:
    """One dataset per workbook sheet under `folder`."""
    models = results.select("item_id", F.explode("model_predictions").alias("model", "p")).select("item_id", "model", "p.*")
    quality = results.select("item_id", reporting.quality_metrics(columns=results.columns).alias("q")).select("item_id", "q.*")
    sheets = {"Summary": reporting.export_summary_row(results), "Model_Predictions": models, "Quality_Metrics": quality,
              "Raw_Data": reporting.flatten(results)}
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return list(sheets)


def export_batch_sheets(results: DataFrame, folder: str) -> list[str]:
    """Job information, statistics and result lines of every batch."""
    sheets = {"Job_Info": stats.job_status(results), "Statistics": stats.batch_statistics(results),
              "Results_Summary": results.select("job_id", "item_id", "confidence", "is_fake", "is_duplicate", "processing_time", "error")}
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return list(sheets)


def indented_lines(df: DataFrame) -> Column:
    """`name: value` lines of a row, nested parts two spaces deeper, list items numbered."""
    def lines(column: Column, kind: T.DataType, name: str, level: int) -> Column:
        pad = "  " * level
        if isinstance(kind, T.StructType):
            inner = [lines(column.getField(f.name), f.dataType, f.name, level + 1) for f in kind]
            return F.concat_ws("\n", F.lit(f"{pad}{name}:"), *inner)
        if isinstance(kind, T.MapType):
            entries = F.transform(F.map_entries(column), lambda e: F.concat(F.lit(pad + "  "), e["key"], F.lit(": "), _plain(e["value"], kind.valueType)))
            return F.concat_ws("\n", F.lit(f"{pad}{name}:"), entries)
        if isinstance(kind, T.ArrayType):
            items = F.transform(column, lambda x, i: F.concat(F.lit(pad + "  ["), i.cast("string"), F.lit("]: "), _plain(x, kind.elementType)))
            return F.concat_ws("\n", F.lit(f"{pad}{name}:"), items)
        return F.concat(F.lit(f"{pad}{name}: "), F.coalesce(column.cast("string"), F.lit("None")))

    return F.concat_ws("\n", *[lines(F.col(f.name), f.dataType, f.name, 0) for f in df.schema])


def _plain(column: Column, kind: T.DataType) -> Column:
    text = column.cast("string") if isinstance(kind, T.AtomicType) else F.to_json(column)
    return F.coalesce(text, F.lit("None"))


def export_text(results: DataFrame, path: str) -> None:
    rule = "=" * 80
    head = F.lit(f"{rule}\nMEDIA FORENSICS TECHNICAL ANALYSIS REPORT\n{rule}\n")
    results.select(F.concat(head, indented_lines(results), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def export_batch(results: DataFrame, folder: str, fmt: str = "json") -> None:
    """All results in one format, split by outcome, with the summary beside them."""
    status = F.when(F.col("error").isNull(), "completed").otherwise("error")
    rows = results.withColumn("status", status)
    if fmt == "json":
        rows.write.mode("overwrite").partitionBy("status").json(f"{folder}/results")
    elif fmt == "csv":
        reporting.flatten(rows).write.mode("overwrite").partitionBy("status").option("header", True).csv(f"{folder}/results")
    else:
        writers = {"xml": export_xml, "txt": export_text}
        writers[fmt](results, f"{folder}/results")
    stats.export_summary(results.withColumn("batch", F.lit("all")), "batch").write.mode("overwrite").json(f"{folder}/summary")


def export_hashes(wide: DataFrame, folder: str) -> None:
    """Hash table as JSON lines, and its total with the export time."""
    wide.write.mode("overwrite").json(f"{folder}/hashes")
    wide.agg(F.count("*").alias("total_files")).withColumn("export_timestamp", F.current_timestamp()).write.mode("overwrite").json(f"{folder}/info")


def append_jobs(jobs: DataFrame, path: str) -> None:
    """New processing jobs (job_type, file_id, parameters): id from the content, status `pending`."""
    jobs.select(
        F.xxhash64("job_type", "file_id", "parameters").alias("job_id"), "job_type", "file_id", "parameters",
        F.lit("pending").alias("status"), F.lit(0.0).alias("progress"), F.current_timestamp().alias("created_at"),
    ).write.mode("append").parquet(path)


def write_split_dataset(crops: DataFrame, path: str) -> None:
    """Training crops by split and label folders."""
    crops.write.mode("overwrite").partitionBy("split", "label").parquet(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """One file per row of `files` (`name`, relative to the folder, and binary `content`), written by the executors; returns name and length of each.

    `folder` is one that every executor reaches. A file is written under a name of its own attempt and moved to its place when complete, so readers meet
    no half-written file and an attempt that comes again puts the same bytes in the same place. Rows without a name or content are left out.
    """

    def run(batches):
        from pyarrow import fs

        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names, contents = batch.column("name").to_pylist(), batch.column("content")
            for name, content in zip(names, contents):
                target = f"{base}/{name}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{target}._{attempt}") as out:
                    out.write(content.as_buffer())
                system.move(f"{target}._{attempt}", target)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([len(c.as_buffer()) for c in contents], pa.int64())], ["name", "length"])

    rows = files.where("name is not null and content is not null").select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(run, "name string, length long")
