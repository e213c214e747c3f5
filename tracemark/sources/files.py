"""Readers for media folders and labelled text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.functions import files as ff
from tracemark.functions import hashing, text

TEXT_COLUMNS = ["text", "content", "body", "article"]


def scan_directory(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Listing of the supported files in a folder. Pass it on without `content` to read names and sizes only."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = ff.local_path(F.col("path"))
    listed = raw.select(path.alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), "content")
    return listed.filter(ff.is_media(F.col("file_path")))


def register_files(listing: DataFrame) -> DataFrame:
    """Catalogue rows of a listing; the id is a hash of the path, so it is the same in every run."""
    p = F.col("file_path")
    return listing.select(
        F.xxhash64("file_path").alias("file_id"), "file_path", ff.basename(p).alias("filename"), "file_size",
        ff.media_type(p).alias("file_type"), ff.mime_type(p).alias("mime_type"), "modified_at", F.lit("active").alias("status"))


def scan_outcome(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Found, skipped (already known) and newly registered files of a scan, in one row."""
    state = listing.select("file_path").join(known.select("file_path", F.lit(True).alias("_known")), "file_path", "left")
    return state.agg(F.count("*").alias("total_found"), F.count_if("_known").alias("skipped"),
                     F.count_if(F.col("_known").isNull()).alias("success"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pixels; a file that cannot be decoded has height -1."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(folder)
    return raw.select(ff.local_path(F.col("image.origin")).alias("file_path"), "image.height", "image.width",
                      F.col("image.nChannels").alias("channels"), "image.data")


def validate_files(listing: DataFrame, images: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Existence, size, format and corruption checks.

    Spark lists no empty files, so a missing and an empty file look alike: both are absent from the listing. Pass
    the `expected` paths to get a row for those as well.
    """
    p = F.col("file_path")
    decoded = images.select("file_path", "height")
    rows = listing if expected is None else expected.select("file_path").join(listing, "file_path", "left")
    checked = rows.join(decoded, "file_path", "left")
    is_picture = ff.media_type(p) == "image"
    return checked.select(
        "file_path", F.col("content").isNotNull().alias("exists"), (F.coalesce("file_size", F.lit(0)) > 0).alias("file_size_valid"), ff.magic_matches(F.col("content"), p).alias("format_matches_extension"),
        F.when(F.col("content").isNull(), "unknown").when(is_picture & (F.coalesce("height", F.lit(-1)) < 0), "failed").when(is_picture, "passed").otherwise("unknown").alias("corruption_check"))


def is_valid(path: Column) -> Column:
    """Short check of a listed file: its MIME type is known."""
    return ff.mime_type(path) != "application/octet-stream"


def comprehensive_metadata(listing: DataFrame, images: DataFrame) -> DataFrame:
    """File information, digests, picture data and validation of every listed file in one struct."""
    p = F.col("file_path")
    checks = validate_files(listing, images)
    info = F.struct(ff.basename(p).alias("filename"), "file_size", ff.megabytes(F.col("file_size")).alias("size_mb"),
                    ff.mime_type(p).alias("mime_type"), "modified_at")
    digests = F.struct(*[hashing.digest(F.col("content"), a).alias(a) for a in ("md5", "sha1", "sha256", "crc32")])
    base = listing.select("file_path", info.alias("file_info"), digests.alias("hashes"))
    technical = images.select("file_path", F.struct("height", "width", "channels").alias("technical_data"))
    validation = checks.select("file_path", F.struct("file_size_valid", "format_matches_extension", "corruption_check").alias("validation"))
    return base.join(technical, "file_path", "left").join(validation, "file_path", "left")


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    return labelled_texts(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def labelled_texts(raw: DataFrame) -> DataFrame:
    """One `text` column: title and first text-like column joined by a full stop, trimmed, empty rows dropped."""
    lowered = {c.lower(): c for c in raw.columns}
    body = next((c for c in raw.columns if c.lower() in TEXT_COLUMNS), None)
    if body is None:
        raise ValueError(f"no text column among {raw.columns}")
    content = F.coalesce(F.col(f"`{body}`").cast("string"), F.lit(""))
    if "title" in lowered:
        content = F.concat(F.coalesce(F.col(f"`{lowered['title']}`").cast("string"), F.lit("")), F.lit(". "), content)
    others = [c for c in raw.columns if c.lower() not in ("text", "title") and c != body]
    return raw.select(*others, text.strip(content).alias("text")).filter(F.col("text") != "")


def combine_corpora(genuine: DataFrame, misleading: DataFrame) -> DataFrame:
    """Labelled set: 0 genuine, 1 misleading."""
    return genuine.withColumn("label", F.lit(0)).unionByName(misleading.withColumn("label", F.lit(1)))


def source_signature(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and change time of every training file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        ff.local_path(F.col("path")).alias("file_path"), "length", "modificationTime")


def needs_training(current: DataFrame, stored: DataFrame) -> bool:
    """Whether any training file was added, removed or changed since the stored signature."""
    return not (current.exceptAll(stored).isEmpty() and stored.exceptAll(current).isEmpty())
