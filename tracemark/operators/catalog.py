"""Media catalogue: attributes, validation, search, changes, integrity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemark.functions import files as ff


def with_attributes(files: DataFrame, path: str = "file_path") -> DataFrame:
    p = F.col(path)
    return files.withColumns({"filename": ff.basename(p), "file_type": ff.media_type(p), "mime_type": ff.mime_type(p)})


def list_files(files: DataFrame, file_type: str | None = None, status: str | None = "active", limit: int | None = None, offset: int = 0) -> DataFrame:
    """The catalogue, newest first; a page of it with `limit` and `offset`."""
    kept = files
    if file_type:
        kept = kept.filter(F.col("file_type") == file_type)
    if status:
        kept = kept.filter(F.col("status") == status)
    ordered = kept.orderBy(F.desc("created_at"), F.desc("file_id")).offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def search(files: DataFrame, term: str, fields: Sequence[str] = ("filename", "file_path"), limit: int | None = None) -> DataFrame:
    """Newest active files whose chosen fields contain the term, in any letter case."""
    pattern = "%" + term + "%"
    hit = reduce(Column.__or__, [F.col(f).ilike(pattern) for f in fields])
    active = files.filter((F.col("status") == "active") & hit)
    ordered = active.orderBy(F.desc("created_at"), F.desc("file_id"))
    return ordered if limit is None else ordered.limit(limit)


def validate_upload(files: DataFrame, kind: Column, extensions: dict[str, list[str]], max_mb: int = 100) -> DataFrame:
    """Extension and size checks as arrays of messages."""
    mb = F.col("file_size") / ff.MEGABYTE
    ext = ff.extension(F.col("file_path"))
    allowed = reduce(Column.__or__, [(kind == k) & ext.isin(v) for k, v in extensions.items()])
    listed = reduce(lambda acc, kv: acc.when(kind == kv[0], ", ".join(e.lstrip(".") for e in kv[1])), extensions.items(), F)
    errors = F.array_compact(F.array(
        F.when(~allowed, F.concat(F.lit("File extension not allowed. Allowed: "), listed)),
        F.when(mb > max_mb, F.format_string(f"File size (%.1fMB) exceeds maximum allowed ({max_mb}MB)", mb)),
    ))
    warnings = F.array_compact(F.array(
        F.when(mb > max_mb * 0.8, F.format_string("Large file detected (%.1fMB). Processing may take longer.", mb))
    ))
    return files.withColumns({"errors": errors, "warnings": warnings}).withColumn("valid", F.size("errors") == 0)


def duration_allowed(frame_count: Column, fps: Column, max_seconds: int = 300) -> Column:
    return F.coalesce(F.try_divide(frame_count, fps) <= max_seconds, F.lit(False))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """`current` with the rows of `changes` put in place by key, the highest `version` winning, changes first.

    One partial aggregation per key, so a key that changes very often costs no more than its last row.
    """
    columns = current.columns
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.select(columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    newest = F.max(F.struct(F.col("_new"), F.col(version).alias("_version"), F.struct(*rest).alias("row"))).alias("m")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"m.row.{c}").alias(c) for c in rest]).select(columns)


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Change rows (file_id, metadata, checksum, deleted) laid over the catalogue; NULL keeps the old value."""
    new = changes.select("file_id", *[F.col(c).alias(f"new_{c}") for c in ("metadata", "checksum", "deleted")])
    merged = files.join(new, "file_id", "left").withColumns({
        "metadata": F.coalesce("new_metadata", "metadata"),
        "checksum": F.coalesce("new_checksum", "checksum"),
        "status": F.when(F.col("new_deleted"), "deleted").otherwise(F.col("status")),
    })
    return merged.select(files.columns)


def mark_missing(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Active files absent from the current listing become deleted."""
    seen = listing.select("file_path").distinct().withColumn("_seen", F.lit(True))
    gone = F.col("_seen").isNull() & (F.col("status") == "active")
    return files.join(seen, "file_path", "left").withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).select(files.columns)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def batch_outcomes(paths: DataFrame, known: DataFrame, existing: DataFrame) -> DataFrame:
    """Registration outcome of every requested path: `missing`, `skipped` (already known) or `success`."""
    flag = lambda df, name: df.select("file_path").distinct().withColumn(name, F.lit(True))
    state = paths.join(flag(existing, "_there"), "file_path", "left").join(flag(known, "_known"), "file_path", "left")
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.col("_known"), "skipped").otherwise("success")
    return state.select("file_path", outcome.alias("outcome"))


def latest_results(results: DataFrame) -> DataFrame:
    """Newest detection per file and type; the history keeps every run."""
    rest = [c for c in results.columns if c not in ("file_id", "detection_type")]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "result_id")).alias("r")
    return results.groupBy("file_id", "detection_type").agg(newest).select("file_id", "detection_type", "r.*")


def schema_issues(df: DataFrame, name: str, expected: T.StructType) -> list[str]:
    """Columns that a table lacks or holds with another type; reads the plan only."""
    found = {f.name: f.dataType for f in df.schema}
    issues = [f"Missing column: {name}.{f.name}" for f in expected if f.name not in found]
    return issues + [f"Wrong type: {name}.{f.name}" for f in expected if f.name in found and found[f.name] != f.dataType]


def integrity_issues(tables: dict[str, DataFrame], keys: dict[str, str], links: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Counts of repeated keys per table and of dangling references per link (child, column, parent, key)."""
    parts = []
    for name, key in keys.items():
        repeated = tables[name].groupBy(key).count().filter(F.col("count") > 1)
        parts.append(repeated.agg(F.count("*").alias("n")).select(F.lit(f"Duplicate keys: {name}.{key}").alias("issue"), "n"))
    for child, column, parent, key in links:
        dangling = tables[child].select(F.col(column).alias("k")).join(tables[parent].select(F.col(key).alias("k")), "k", "left_anti")
        parts.append(dangling.agg(F.count("*").alias("n")).select(F.lit(f"Dangling reference: {child}.{column} -> {parent}").alias("issue"), "n"))
    return reduce(DataFrame.unionByName, parts)
