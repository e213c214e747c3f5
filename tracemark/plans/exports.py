"""Exports written to the shared folder and read back, and the remaining source queries."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.functions import files as ff
from tracemark.functions import payloads as pl
from tracemark.operators import catalog
from tracemark.plans.registry import query
from tracemark.session import shared_folder
from tracemark.sources import files, sinks


def _folder(t, name):
    return f"{shared_folder(t.spark)}/tracemark/{name}-{uuid.uuid4().hex}"


@query("S07_all_hashes", "SELECT file_id, dhash, ahash, phash, whash FROM media_hashes_wide", ("media_hashes_wide",))
def all_hashes(t):
    return t.media_hashes_wide


@query("S08_json_export", "SELECT item_id, detection_mode, round(confidence, 6) AS confidence, is_fake, error FROM result_envelope", ("result_envelope",))
def json_export(t):
    path = _folder(t, "json")
    sinks.export_json(t.result_envelope, path)
    parts = "item_id long, technical_analysis struct<scores:map<string,string>,metrics:map<string,string>,results:map<string,string>,details:map<string,string>>"
    doc = t.spark.read.schema(parts).json(path)
    part = lambda group, key: F.col(f"technical_analysis.{group}")[key]
    return doc.select("item_id", part("details", "detection_mode").alias("detection_mode"), F.round(part("scores", "confidence").cast("double"), 6).alias("confidence"),
                      part("results", "is_fake").cast("boolean").alias("is_fake"), part("details", "error").alias("error"))


@query("S09_csv_export", "SELECT item_id, round(xc_conf, 6) AS xception, m_software AS software FROM result_envelope", ("result_envelope",))
def csv_export(t):
    path = _folder(t, "csv")
    rows = t.result_envelope.select("item_id", F.struct(F.col("model_predictions")["xception"]["confidence"].alias("xception")).alias("scores"),
                                    F.array(F.col("metadata")["Software"]).alias("software"))
    sinks.export_csv(rows, path, list_length=1)
    back = t.spark.read.schema("item_id long, scores_xception double, software_0 string, software_rest string").option("header", True).csv(path)
    return back.select("item_id", F.round("scores_xception", 6).alias("xception"), F.col("software_0").alias("software"))


@query("S10_xml_export", "SELECT item_id, job_id, detection_mode, is_fake FROM result_envelope", ("result_envelope",))
def xml_export(t):
    path = _folder(t, "xml")
    sinks.export_xml(t.result_envelope, path)
    return t.spark.read.format("xml").schema("item_id long, job_id long, detection_mode string, is_fake boolean").option("rowTag", "Data").load(path)


@query("S11_sheets_export", """
    SELECT 'Model_Predictions' AS sheet, item_id AS id, 'xception' AS name, round(xc_conf, 6) AS value FROM result_envelope
    UNION ALL SELECT 'Model_Predictions', item_id, 'meso', round(me_conf, 6) FROM result_envelope
    UNION ALL SELECT 'Raw_Data', item_id, detection_mode, round(confidence, 6) FROM result_envelope
    UNION ALL SELECT 'Results_Summary', item_id, coalesce(error, ''), round(processing_time, 6) FROM result_envelope
    UNION ALL SELECT 'Statistics', job_id, 'successful', CAST(count(*) FILTER (error IS NULL) AS DOUBLE) FROM result_envelope GROUP BY job_id""", ("result_envelope",))
def sheets_export(t):
    """Values of the written sheets, read back."""
    path = _folder(t, "sheets")
    sinks.export_sheets(t.result_envelope, path)
    sinks.export_batch_sheets(t.result_envelope, path)
    cell = lambda sheet, id, name, value: t.spark.read.parquet(f"{path}/{sheet}").select(
        F.lit(sheet).alias("sheet"), F.col(id).alias("id"), name.alias("name"), F.round(F.col(value).cast("double"), 6).alias("value"))
    return reduce(DataFrame.unionByName, [
        cell("Model_Predictions", "item_id", F.col("model"), "confidence"), cell("Raw_Data", "item_id", F.col("detection_mode"), "confidence"),
        cell("Results_Summary", "item_id", F.coalesce("error", F.lit("")), "processing_time"), cell("Statistics", "job_id", F.lit("successful"), "successful")])


@query("S11_sheet_sizes", """
    SELECT 'Model_Predictions' AS sheet, 2 * count(*) AS n FROM events UNION ALL SELECT 'Quality_Metrics', count(*) FROM events
    UNION ALL SELECT 'Raw_Data', count(*) FROM events UNION ALL SELECT 'Summary', count(*) FROM events
    UNION ALL SELECT 'Job_Info', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Statistics', count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'Results_Summary', count(*) FROM events""")
def sheet_sizes(t):
    path = _folder(t, "sheets")
    names = sinks.export_sheets(t.result_envelope, path) + sinks.export_batch_sheets(t.result_envelope, path)
    counts = [t.spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("sheet"), "n") for n in names]
    return reduce(DataFrame.unionByName, counts)


@query("S12_text_export", """
    SELECT item_id, job_id, detection_mode, CAST(is_fake AS BOOLEAN) AS is_fake, m_software AS software FROM result_envelope""", ("result_envelope",))
def text_export(t):
    """The written reports, cut apart at their heads and read back field by field."""
    path = _folder(t, "text")
    sinks.export_text(t.result_envelope, path)
    reports = t.spark.read.option("lineSep", "=" * 80 + "\nMEDIA FORENSICS TECHNICAL ANALYSIS REPORT\n").text(path).filter(F.col("value").contains("item_id: "))
    field = lambda name, pad="": F.nullif(F.regexp_extract("value", f"(?m)^{pad}{name}: (.*)$", 1), F.lit(""))
    return reports.select(field("item_id").cast("long").alias("item_id"), field("job_id").cast("long").alias("job_id"), field("detection_mode").alias("detection_mode"),
                          field("is_fake").cast("boolean").alias("is_fake"), field("Software", "  ").alias("software"))


@query("S13_batch_export", """
    SELECT item_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS status, detection_mode, round(confidence, 6) AS confidence, error FROM result_envelope""", ("result_envelope",))
def batch_export(t):
    path = _folder(t, "batch")
    sinks.export_batch(t.result_envelope, path)
    back = t.spark.read.schema("item_id long, status string, detection_mode string, confidence double, error string").json(f"{path}/results")
    return back.withColumn("confidence", F.round("confidence", 6))


@query("S14_hash_export", """
    SELECT file_id, dhash, ahash, phash, whash, (SELECT count(*) FROM documents) AS total_files FROM media_hashes_wide""", ("media_hashes_wide",))
def hash_export(t):
    path = _folder(t, "hashes")
    sinks.export_hashes(t.media_hashes_wide, path)
    rows = t.spark.read.schema("file_id long, dhash string, ahash string, phash string, whash string").json(f"{path}/hashes")
    return rows.withColumn("total_files", F.lit(t.spark.read.schema("total_files long").json(f"{path}/info").first()["total_files"]))


@query("S16_append_jobs", """
    SELECT event_type AS job_type, user_id AS file_id, props AS parameters, 'pending' AS status, 0.0::DOUBLE AS progress FROM events""")
def append_jobs(t):
    path = _folder(t, "jobs")
    jobs = t.read("events").select(F.col("event_type").alias("job_type"), F.col("user_id").alias("file_id"), F.col("props").alias("parameters"))
    sinks.append_jobs(jobs, path)
    return t.spark.read.parquet(path).select("job_type", "file_id", "parameters", "status", "progress")


@query("S05_csv_source", """
    SELECT page_id, length(text) AS chars, md5(text) AS digest FROM (
        SELECT page_id, regexp_replace(url || '. ' || html, '^\\s+|\\s+$', '', 'g') AS text FROM pages)""")
def csv_source(t):
    path = _folder(t, "labelled")
    t.read("pages").select("page_id", F.col("url").alias("Title"), F.col("html").alias("Article")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_labelled_csv(t.spark, path).select(F.col("page_id").cast("long").alias("page_id"), F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query("S02_register_files", """
    SELECT file_path, regexp_extract(file_path, '[^/]*$') AS filename, file_size, 'active' AS status FROM media_files""", ("media_files",))
def register_files(t):
    listing = t.media_files.select("file_path", "file_size", F.col("created_at").alias("modified_at"))
    return files.register_files(listing).select("file_path", "filename", "file_size", "status")


@query("S01_scan_outcome", """
    SELECT count(*) AS total_found, count(*) FILTER (status = 'deleted') AS success, count(*) FILTER (status = 'active') AS skipped FROM media_files""", ("media_files",))
def scan_outcome(t):
    known = t.media_files.filter("status = 'active'")
    return files.scan_outcome(t.media_files.select("file_path"), known).select("total_found", "success", "skipped")


@query("F12_json_columns", "SELECT event_id, k, '{\"k\":' || k || ',\"type\":\"' || event_type || '\"}' AS payload FROM ev", ("ev",))
def json_columns(t):
    parsed = t.read("events").withColumn("p", F.from_json("props", "k int"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("type"))).alias("payload"))


_PAYLOAD = """
    CASE WHEN k % 10 = 9 THEN '{"k":' WHEN k % 4 = 0 THEN props WHEN k % 4 = 1 THEN '{"k":"' || k || '","note":null}'
         WHEN k % 4 = 2 THEN '{"k":{"value":' || k || ',"unit":"s"}}' ELSE '[' || k || ',true]' END"""


def _payloads(t):
    return t.events.select("event_id", "event_type", "k", pl.payload(F.expr(_PAYLOAD)).alias("p"))


@query("F12_open_payloads", """
    SELECT event_id, CASE WHEN k % 10 <> 9 THEN k END AS number, CASE WHEN k % 10 <> 9 AND k % 4 = 2 THEN 's' END AS unit,
           CASE WHEN k % 10 = 9 THEN NULL WHEN k % 4 = 0 THEN 'OBJECT<k: BIGINT>' WHEN k % 4 = 1 THEN 'OBJECT<k: STRING, note: VOID>'
                WHEN k % 4 = 2 THEN 'OBJECT<k: OBJECT<unit: STRING, value: BIGINT>>' ELSE 'ARRAY<VARIANT>' END AS shape FROM ev""", ("ev",))
def open_payloads(t):
    """Payloads of five shapes, one of them broken, read without a schema."""
    p = F.col("p")
    return _payloads(t).select("event_id", pl.first_of(p, "int", "$.k", "$.k.value", "$[0]").alias("number"), pl.first_of(p, "string", "$.k.unit").alias("unit"), pl.shape(p).alias("shape"))


@query("F12_common_shapes", """
    SELECT k % 2 AS parity, k % 4 = 3 AS listed, count(*) AS n, CASE WHEN k % 4 = 3 THEN 'ARRAY<VARIANT>' WHEN k % 2 = 0 THEN 'OBJECT<k: VARIANT>' ELSE 'OBJECT<k: STRING, note: VOID>' END AS shape
    FROM ev WHERE k % 10 <> 9 GROUP BY ALL""", ("ev",))
def common_shapes(t):
    rows = _payloads(t).filter("p is not null").select((F.col("k") % 2).alias("parity"), (F.col("k") % 4 == 3).alias("listed"), "p")
    return rows.groupBy("parity", "listed").agg(F.count("*").alias("n"), pl.common_shape(F.col("p")).alias("shape"))


@query("P15_threshold_decisions", """
    SELECT item_id, confidence > 0.5 AS above, confidence >= 0.8 AS duplicate, confidence >= 0.38 AS misleading FROM result_envelope""", ("result_envelope",))
def threshold_decisions(t):
    c = F.col("confidence")
    return t.result_envelope.select("item_id", (c > 0.5).alias("above"), (c >= 0.8).alias("duplicate"), (c >= 0.38).alias("misleading"))


_KINDS = """
    p AS (SELECT video_id, 8 * count(*) AS h, flatten(list(pixels ORDER BY frame_idx)) AS px FROM frames GROUP BY 1),
    b AS (SELECT video_id, h, from_hex('424d' || le(24 * h + 54) || '00000000' || le(54) || le(40) || le(8) || le(h) || '01001800' || '00000000' || le(24 * h) || le(2835) || le(2835) || le(0) || le(0)
              || array_to_string(list_transform(range(h), lambda y: array_to_string(list_transform(px[8 * (h - 1 - y) + 1:8 * (h - y)], lambda v: repeat(printf('%02x', v), 3)), '')), '')) AS bmp FROM p),
    f AS (SELECT video_id, h, CASE video_id % 8 WHEN 3 THEN bmp[:60] WHEN 6 THEN from_hex('') ELSE bmp END AS content,
              'set-' || (video_id % 3) || '/' || video_id || CASE video_id % 8 WHEN 4 THEN '.png' WHEN 5 THEN '.xyz' ELSE '.bmp' END AS name FROM b)"""
_LE = "(printf('%02x', ({0}) & 255) || printf('%02x', (({0}) >> 8) & 255) || printf('%02x', (({0}) >> 16) & 255) || printf('%02x', (({0}) >> 24) & 255))"
_FILES = re.sub(r"\ble\(([^()]*)\)", lambda m: _LE.format(f"CAST({m[1]} AS BIGINT)"), _KINDS)


def _pictures(t):
    """Every video's frames, one above the other, as a picture file of 8 columns. One in eight is cut off, carries a wrong extension, an unknown one, is empty, or is not written."""
    kind = F.col("video_id") % 8
    sheets = t.frames.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "pixels"))).alias("s")).select(
        "video_id", F.flatten(F.transform("s", lambda x: x["pixels"])).alias("px"), (F.size("s") * 8).alias("h"))
    bmp = ff.bitmap(F.col("px"), 8, F.col("h"))
    content = F.when(kind == 3, F.substring(bmp, 1, 60)).when(kind == 6, F.lit(b"")).otherwise(bmp)
    name = F.concat(F.lit("set-"), F.col("video_id") % 3, F.lit("/"), "video_id", F.when(kind == 4, ".png").when(kind == 5, ".xyz").otherwise(".bmp"))
    folder = _folder(t, "pictures")
    expected = sheets.select("video_id", name.alias("name"), content.alias("content"))
    sinks.write_files(expected.filter(kind != 7), folder).write.format("noop").mode("overwrite").save()
    return folder, expected.select(F.concat(F.lit(f"{folder}/"), "name").alias("file_path"), "name")


@query("S01_folder_scan", f"""{_FILES}
    SELECT name, octet_length(content) AS file_size, regexp_extract(name, '[^/]*$') AS filename, 'image' AS file_type FROM f WHERE video_id % 8 NOT IN (5, 6, 7)""", ("frames",))
def folder_scan(t):
    folder, expected = _pictures(t)
    return files.register_files(files.scan_directory(t.spark, folder)).join(expected, "file_path").select("name", "file_size", "filename", "file_type")


@query("S04_picture_pixels", f"""{_FILES}
    SELECT name, CASE WHEN video_id % 8 = 3 THEN -1 ELSE h END AS height, CASE WHEN video_id % 8 = 3 THEN -1 ELSE 8 END AS width,
           CASE WHEN video_id % 8 = 3 THEN '' ELSE hex(content[55:]) END AS data FROM f WHERE video_id % 8 NOT IN (6, 7)""", ("frames",))
def picture_pixels(t):
    """Decoded pixels, bottom row first as the files hold them; a file cut off can't be decoded."""
    folder, expected = _pictures(t)
    rows = files.read_images(t.spark, folder).join(expected, "file_path")
    line = lambda y: F.substring("data", y * 24 + 1, F.lit(24))
    flipped = F.array_join(F.transform(F.sequence(F.col("height") - 1, F.lit(0)), lambda y: F.hex(line(y))), "")
    return rows.select("name", "height", "width", F.when(F.col("height") > 0, flipped).otherwise("").alias("data"))


@query("P08_file_validation", f"""{_FILES}
    SELECT name, video_id % 8 NOT IN (6, 7) AS exists, video_id % 8 NOT IN (6, 7) AS file_size_valid, CASE WHEN video_id % 8 NOT IN (6, 7) THEN video_id % 8 <> 4 END AS format_matches_extension,
           CASE WHEN video_id % 8 IN (6, 7) THEN 'unknown' WHEN video_id % 8 = 3 THEN 'failed' ELSE 'passed' END AS corruption_check FROM f WHERE video_id % 8 <> 5""", ("frames",))
def file_validation(t):
    """Existence, size, format and decoding of real files; missing and empty ones are known from the expected paths."""
    folder, expected = _pictures(t)
    wanted = expected.filter(ff.is_media(F.col("file_path")))
    checked = files.validate_files(files.scan_directory(t.spark, folder), files.read_images(t.spark, folder), wanted)
    return checked.join(wanted, "file_path").select("name", "exists", "file_size_valid", "format_matches_extension", "corruption_check")


@query("I23_comprehensive_metadata", f"""{_FILES}
    SELECT name, octet_length(content) AS file_size, round(octet_length(content) / 1048576.0::DOUBLE, 2) AS size_mb, CASE WHEN video_id % 8 = 4 THEN 'image/png' ELSE 'image/bmp' END AS mime_type,
           md5(content) AS md5, sha256(content) AS sha256, CASE WHEN video_id % 8 = 3 THEN -1 ELSE h END AS height, video_id % 8 <> 4 AS format_matches_extension FROM f WHERE video_id % 8 NOT IN (5, 6, 7)""", ("frames",))
def comprehensive_metadata(t):
    folder, expected = _pictures(t)
    rows = files.comprehensive_metadata(files.scan_directory(t.spark, folder), files.read_images(t.spark, folder)).join(expected, "file_path")
    return rows.select("name", "file_info.file_size", "file_info.size_mb", "file_info.mime_type", "hashes.md5", "hashes.sha256", "technical_data.height", "validation.format_matches_extension")


@query("P08_format_checks", """
    SELECT doc_id AS file_id, n_chars > 0 AS file_size_valid, doc_id % 6 <> 5 AS is_valid FROM documents""")
def format_checks(t):
    rows = t.media_files.join(t.contents, "file_id")
    return rows.select("file_id", (F.length("content") > 0).alias("file_size_valid"), files.is_valid(F.col("file_path")).alias("is_valid"))


@query("U04_set_difference", """
    SELECT 'uncached' AS what, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
    UNION ALL SELECT 'orphans', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 17 <> 0)""")
def set_difference(t):
    docs, labels = t.read("documents").select("doc_id"), t.read("labels").select("doc_id")
    active = t.media_files.filter("status = 'active'").select(F.col("file_id").alias("doc_id"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(docs.exceptAll(labels), "uncached").unionByName(count(catalog.orphans(labels, active, "doc_id"), "orphans"))


@query("L03_L04_ordered_matches", "SELECT user_id AS file_id, event_id AS similar_id, k / 100.0::DOUBLE AS similarity_score FROM ev ORDER BY 1, 3 DESC, 2", ("ev",))
def ordered_matches(t):
    rows = t.events.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("similar_id"), (F.col("k") / 100.0).alias("similarity_score"))
    return rows.orderBy("file_id", F.desc("similarity_score"), "similar_id")
