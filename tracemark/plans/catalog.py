"""Catalogue, cache and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemark.functions import files as ff
from tracemark.functions import hashing
from tracemark.operators import cache, catalog, stats
from tracemark.plans.registry import query

_TYPE = """CASE WHEN regexp_matches(file_path, '[.](jpg|jpeg|png|bmp|tiff|gif|webp)$') THEN 'image'
                WHEN regexp_matches(file_path, '[.](mp4|avi|mov|mkv|flv|wmv|m4v)$') THEN 'video'
                WHEN regexp_matches(file_path, '[.](mp3|wav|flac|aac|ogg|m4a)$') THEN 'audio' ELSE 'unknown' END"""
_ATTR = f"""attr AS (SELECT *, regexp_extract(file_path, '[^/]*$') AS filename, {_TYPE} AS file_type FROM media_files)"""
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _files(t):
    return catalog.with_attributes(t.media_files)


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


@query("P01_file_attributes", f"""
    {_ATTR}
    SELECT file_id, filename, file_type,
           CASE regexp_extract(file_path, '[.][a-z0-9]+$') WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png'
                WHEN '.gif' THEN 'image/gif' WHEN '.mp4' THEN 'video/mp4' WHEN '.mp3' THEN 'audio/mpeg'
                ELSE 'application/octet-stream' END AS mime_type FROM attr""", ("media_files",))
def file_attributes(t):
    return _files(t).select("file_id", "filename", "file_type", "mime_type")


@query("P02_supported_media", """
    SELECT file_id, regexp_matches(file_path, '[.](jpg|png|mp4|gif|mp3)$') AS in_catalogue,
           regexp_matches(file_path, '[.](jpg|png|mp4)$') AS can_fingerprint FROM media_files""", ("media_files",))
def supported_media(t):
    p = F.col("file_path")
    return t.media_files.select("file_id", ff.is_media(p).alias("in_catalogue"), ff.is_media(p, ff.FINGERPRINT_TYPES).alias("can_fingerprint"))


@query("P03_L01_list_files", f"""
    {_ATTR}
    SELECT file_id, file_path, file_size, created_at FROM attr WHERE file_type = 'image' AND status = 'active'
    ORDER BY created_at DESC, file_id DESC LIMIT 100 OFFSET 20""", ("media_files",))
def list_files(t):
    return catalog.list_files(_files(t), "image", limit=100, offset=20).select("file_id", "file_path", "file_size", "created_at")


@query("P04_L02_search_files", f"""
    {_ATTR}
    SELECT file_id, file_path FROM attr
    WHERE status = 'active' AND (filename ILIKE '%SRC7%' OR file_path ILIKE '%SRC7%' OR metadata ILIKE '%SRC7%')
    ORDER BY created_at DESC, file_id DESC LIMIT 50""", ("media_files",))
def search_files(t):
    return catalog.search(_files(t), "SRC7", ("filename", "file_path", "metadata"), limit=50).select("file_id", "file_path")


@query("P05_lookup_by_path", """
    SELECT m.file_id, m.file_path, file_size, status FROM media_files m
    JOIN (SELECT '/media/' || source || '/' || d.doc_id || '.png' AS file_path FROM documents d JOIN labels USING (doc_id)) q
      ON q.file_path = m.file_path""", ("media_files",))
def lookup_by_path(t):
    asked = t.read("documents").join(t.read("labels"), "doc_id", "left_semi").select(
        F.concat(F.lit("/media/"), "source", F.lit("/"), "doc_id", F.lit(".png")).alias("file_path"))
    return t.media_files.join(asked, "file_path").select("file_id", "file_path", "file_size", "status")


@query("P06_files_by_hash", """
    h AS (SELECT md5(text) AS hash_value, doc_id AS file_id FROM documents),
    asked AS (SELECT DISTINCT md5(text) AS hash_value FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT hash_value, file_id FROM h WHERE hash_value IN (SELECT hash_value FROM asked)""")
def files_by_hash(t):
    stored = t.crypto_hashes.filter(F.col("hash_type") == "md5").select("hash_value", "file_id")
    toxic = t.read("labels").filter("toxic = 1").select(F.col("doc_id").alias("file_id"))
    asked = stored.join(toxic, "file_id", "left_semi").select("hash_value").distinct()
    return stored.join(asked, "hash_value", "left_semi")


@query("P07_validate_upload", f"""
    {_ATTR},
    s AS (SELECT *, file_size * 10000 / (1024 * 1024)::DOUBLE AS mb, CASE WHEN file_id % 6 IN (2, 4) THEN 'video' ELSE 'image' END AS kind FROM attr),
    v AS (SELECT file_id, mb, (kind = 'image' AND regexp_matches(file_path, '[.](jpg|jpeg|png|bmp|tiff)$'))
                 OR (kind = 'video' AND regexp_matches(file_path, '[.](mp4|avi|mov|mkv)$')) AS ext_ok FROM s)
    SELECT file_id, ext_ok AND mb <= 100 AS valid, CAST(NOT ext_ok AS INT) + CAST(mb > 100 AS INT) AS n_errors,
           CASE WHEN mb > 80 THEN printf('Large file detected (%.1fMB). Processing may take longer.', mb) ELSE '' END AS warnings FROM v""",
       ("media_files",))
def validate_upload(t):
    kind = F.when((F.col("file_id") % 6).isin(2, 4), "video").otherwise("image")
    allowed = {"image": [".jpg", ".jpeg", ".png", ".bmp", ".tiff"], "video": [".mp4", ".avi", ".mov", ".mkv"]}
    checked = catalog.validate_upload(t.media_files.withColumn("file_size", F.col("file_size") * 10000), kind, allowed)
    return checked.select("file_id", "valid", F.size("errors").alias("n_errors"), F.array_join("warnings", "").alias("warnings"))


@query("P09_video_duration", """
    SELECT video_id, n_frames * 40 / fps <= 15 AS allowed, printf('%d:%02d', CAST(floor(n_frames * 40 / fps) AS INT) // 60,
           CAST(floor(n_frames * 40 / fps) AS INT) % 60) AS duration FROM videos""", ("videos",))
def video_duration(t):
    frames = F.col("n_frames") * 40
    return t.videos.select("video_id", catalog.duration_allowed(frames, F.col("fps"), 15).alias("allowed"),
                           ff.clock(frames / F.col("fps")).alias("duration"))


@query("P10_apply_changes", """
    ch AS (SELECT doc_id AS file_id, CASE WHEN quality = 0 THEN '{"reviewed":true}' END AS metadata,
                  CASE WHEN toxic = 1 THEN 'cleared' END AS checksum, toxic = 1 AND quality = 0 AS deleted FROM labels)
    SELECT m.file_id, coalesce(ch.metadata, m.metadata) AS metadata, coalesce(ch.checksum, m.checksum) AS checksum,
           CASE WHEN ch.deleted THEN 'deleted' ELSE m.status END AS status
    FROM media_files m LEFT JOIN ch USING (file_id)""", ("media_files",))
def apply_changes(t):
    changes = t.read("labels").select(
        F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 0, '{"reviewed":true}').alias("metadata"),
        F.when(F.col("toxic") == 1, "cleared").alias("checksum"), ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("deleted"))
    return catalog.apply_changes(t.media_files, changes).select("file_id", "metadata", "checksum", "status")


def _listing(t):
    """Files still on disk: those whose text is not toxic."""
    toxic = t.read("labels").filter("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return t.media_files.join(toxic, "file_id", "left_anti").select("file_path")


@query("P11_mark_missing", """
    SELECT file_id, CASE WHEN status = 'active' AND file_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
                         THEN 'deleted' ELSE status END AS status FROM media_files""", ("media_files",))
def mark_missing(t):
    return catalog.mark_missing(t.media_files, _listing(t)).select("file_id", "status")


@query("S03_batch_register", """
    SELECT outcome, count(*) AS files FROM (
        SELECT CASE WHEN file_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'missing'
                    WHEN status = 'deleted' THEN 'success' ELSE 'skipped' END AS outcome FROM media_files) GROUP BY 1""",
       ("media_files",))
def batch_register(t):
    known = t.media_files.filter(F.col("status") == "active")
    outcomes = catalog.batch_outcomes(t.media_files.select("file_path"), known, _listing(t))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("files"))


@query("P12_valid_cache_entries", f"SELECT cache_key, cache_type, access_count FROM cache_entries WHERE expires_at >= {_NOW}", ("cache_entries",))
def valid_cache(t):
    return cache.valid_entries(t.cache_entries, _now()).select("cache_key", "cache_type", "access_count")


@query("P12_expired_cache_entries", f"SELECT cache_key, expires_at FROM cache_entries WHERE expires_at < {_NOW}", ("cache_entries",))
def expired_cache(t):
    return cache.expired_entries(t.cache_entries, _now()).select("cache_key", "expires_at")


@query("P16_fake_results", "SELECT item_id, job_id, confidence FROM result_envelope WHERE is_fake AND error IS NULL", ("result_envelope",))
def fake_results(t):
    return t.result_envelope.filter(F.col("is_fake") & F.col("error").isNull()).select("item_id", "job_id", "confidence")


@query("P17_integrity_issues", """
    SELECT 'Duplicate keys: media_files.file_id' AS issue, count(*) - count(DISTINCT file_id) AS n FROM media_files
    UNION ALL SELECT 'Duplicate keys: media_files.checksum',
        (SELECT count(*) FROM (SELECT checksum FROM media_files GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'Dangling reference: detection_results.file_id -> media_files',
        (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents))
    UNION ALL SELECT 'Dangling reference: labels.doc_id -> media_files',
        (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""", ("media_files",))
def integrity(t):
    tables = {"media_files": t.media_files, "detection_results": t.detection_results, "labels": t.read("labels")}
    ids = catalog.integrity_issues({"media_files": t.media_files}, {"media_files": "file_id"}, [])
    rest = catalog.integrity_issues(tables, {"media_files": "checksum"}, [
        ("detection_results", "file_id", "media_files", "file_id"), ("labels", "doc_id", "media_files", "file_id")])
    return ids.unionByName(rest)


@query("J10_orphan_hashes", """
    SELECT doc_id AS file_id, 'md5' AS hash_type, md5(text) AS hash_value FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_hashes(t):
    kept = t.read("labels").select(F.col("doc_id").alias("file_id"))
    return catalog.orphans(t.crypto_hashes.filter(F.col("hash_type") == "md5"), kept, "file_id").select("file_id", "hash_type", "hash_value")


@query("J15_referential_integrity", """
    SELECT doc_id IN (SELECT doc_id FROM labels) AS kept, count(*) AS n FROM documents GROUP BY 1""")
def referential_integrity(t):
    hashes = t.crypto_hashes.filter(F.col("hash_type") == "sha256").select("file_id")
    parents = t.read("labels").select(F.col("doc_id").alias("file_id"))
    kept = hashes.join(parents, "file_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit(True).alias("kept"), "n")
    gone = hashes.join(parents, "file_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(False).alias("kept"), "n")
    return kept.unionByName(gone)


@query("U05_upsert_files", """
    SELECT m.file_id, CASE WHEN l.doc_id IS NULL THEN file_size ELSE file_size + 1 END AS file_size,
           CASE WHEN l.doc_id IS NULL THEN m.status ELSE 'moved' END AS status
    FROM media_files m LEFT JOIN labels l ON l.doc_id = m.file_id""", ("media_files",))
def upsert_files(t):
    files = t.media_files.select("file_id", "file_size", "status", "created_at")
    changed = files.join(t.read("labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi")
    older = changed.withColumns({"file_size": F.col("file_size") + 7, "status": F.lit("stale"), "created_at": F.col("created_at") - F.make_dt_interval(days=F.lit(1))})
    changes = changed.withColumns({"file_size": F.col("file_size") + 1, "status": F.lit("moved")}).unionByName(older)
    return catalog.upsert(files, changes, ["file_id"], "created_at").select("file_id", "file_size", "status")


@query("W01_latest_detection", """
    SELECT file_id, detection_type, result_id, confidence_score, result_data FROM (
        SELECT *, row_number() OVER (PARTITION BY file_id, detection_type ORDER BY created_at DESC, result_id DESC) AS rn
        FROM detection_results) WHERE rn = 1""", ("detection_results",))
def latest_detection(t):
    return catalog.latest_results(t.detection_results).select("file_id", "detection_type", "result_id", "confidence_score", "result_data")


@query("A01_hash_statistics", """
    SELECT hash_type, count(*) AS hashes, count(DISTINCT file_id) AS files FROM media_hashes GROUP BY 1
    UNION ALL SELECT 'all', count(*), count(DISTINCT file_id) FROM media_hashes""", ("media_hashes",))
def hash_statistics(t):
    return stats.hash_statistics(t.media_hashes)


@query("A02_file_statistics", f"""
    {_ATTR},
    s AS (SELECT 'type' AS scope, file_type AS name, count(*) AS files, sum(CASE WHEN status = 'active' THEN file_size ELSE 0 END) AS z FROM attr GROUP BY 2
          UNION ALL SELECT 'status', status, count(*), sum(CASE WHEN status = 'active' THEN file_size ELSE 0 END) FROM attr GROUP BY 2
          UNION ALL SELECT 'total', 'all', count(*), sum(CASE WHEN status = 'active' THEN file_size ELSE 0 END) FROM attr)
    SELECT scope, name, files, CAST(z AS BIGINT) AS active_size, round(z / files, 6) AS average_size FROM s""", ("media_files",))
def file_statistics(t):
    return stats.file_statistics(_files(t))


@query("A03_cache_statistics", f"""
    s AS (SELECT cache_type, count(*) AS entries, count(*) FILTER (expires_at < {_NOW}) AS expired, count(*) FILTER (access_count > 1) AS r
          FROM cache_entries GROUP BY ROLLUP (cache_type))
    SELECT coalesce(cache_type, 'all') AS cache_type, entries, expired, round(r / entries, 6) AS hit_potential FROM s""", ("cache_entries",))
def cache_statistics(t):
    return stats.cache_statistics(t.cache_entries, _now())


@query("L05_most_accessed_entries", """
    SELECT cache_key, cache_type, access_count FROM cache_entries ORDER BY access_count DESC, cache_key LIMIT 10""", ("cache_entries",))
def most_accessed(t):
    return t.cache_entries.orderBy(F.desc("access_count"), "cache_key").limit(10).select("cache_key", "cache_type", "access_count")


@query("A04_table_statistics", """
    SELECT 'documents' AS table_name, count(*) AS row_count, 5 AS column_count, 'doc_id,text,lang,source,n_chars' AS column_names FROM documents
    UNION ALL SELECT 'events', count(*), 6, 'event_id,ts,user_id,event_type,value,props' FROM events
    UNION ALL SELECT 'labels', count(*), 3, 'doc_id,quality,toxic' FROM labels""")
def table_statistics(t):
    return stats.table_statistics({n: t.read(n) for n in ("documents", "events", "labels")})


@query("A05_system_statistics", f"""
    SELECT 'files' AS area, count(*) AS n FROM documents
    UNION ALL SELECT 'active_size', CAST(sum(n_chars) FILTER (doc_id % 17 <> 0) AS BIGINT) FROM documents
    UNION ALL SELECT 'cache_entries', count(*) FROM cache_entries
    UNION ALL SELECT 'expired_entries', count(*) FILTER (expires_at < {_NOW}) FROM cache_entries
    UNION ALL SELECT 'hashes', 6 * count(*) FROM documents
    UNION ALL SELECT 'orphan_hashes', 6 * count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""", ("cache_entries",))
def system_statistics(t):
    files = stats.file_statistics(_files(t)).filter("scope = 'total'").select(F.expr("stack(2, 'files', files, 'active_size', active_size) AS (area, n)"))
    entries = stats.cache_statistics(t.cache_entries, _now()).filter("cache_type = 'all'").select(
        F.expr("stack(2, 'cache_entries', entries, 'expired_entries', expired) AS (area, n)"))
    hashes = t.media_hash_keys.agg(F.count("*").alias("n")).select(F.lit("hashes").alias("area"), "n")
    kept = t.read("labels").select(F.col("doc_id").alias("file_id"))
    orphans = catalog.orphans(t.media_hash_keys, kept, "file_id").agg(F.count("*").alias("n")).select(F.lit("orphan_hashes").alias("area"), "n")
    return files.unionByName(entries).unionByName(hashes).unionByName(orphans)


@query("A06_duplicate_statistics", f"""
    {_ATTR}
    SELECT count(*) AS files, count(*) FILTER (file_type = 'image') AS images, count(*) FILTER (file_type = 'video') AS videos,
           CAST(sum(file_size) AS BIGINT) AS bytes FROM attr""", ("media_files",))
def duplicate_statistics(t):
    return _files(t).agg(F.count("*").alias("files"), F.count_if(F.col("file_type") == "image").alias("images"),
                         F.count_if(F.col("file_type") == "video").alias("videos"), F.sum("file_size").alias("bytes"))


@query("F01_digests", "SELECT doc_id AS file_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digests(t):
    return t.contents.select("file_id", *[hashing.digest(F.col("content"), a).alias(a) for a in ("md5", "sha1", "sha256")])


@query("F01_crc32_sha512")
def more_digests(t):
    return t.contents.select("file_id", *[hashing.digest(F.col("content"), a).alias(a) for a in ("crc32", "sha512")])


@query("F06_F07_cache_keys", """
    SELECT event_id, md5(user_id || '|' || event_type || '|' || coalesce(CAST(nullif(k, 50) AS VARCHAR), 'None')) AS cache_key,
           ts + INTERVAL 168 HOUR AS expires_at FROM ev""", ("ev",))
def cache_keys(t):
    return t.events.select("event_id", hashing.cache_key(F.col("user_id"), F.col("event_type"), F.nullif("k", F.lit(50))).alias("cache_key"),
                           hashing.expires_at(F.col("ts"), 168).alias("expires_at"))


@query("F16_F20_size_and_threshold", """
    SELECT file_id, round(file_size * 1000 / 1048576.0::DOUBLE, 2) AS mb,
           CAST(floor((1 - (file_id % 20) * 5 / 100.0::DOUBLE) * 64) AS INT) AS bit_threshold FROM media_files""", ("media_files",))
def size_and_threshold(t):
    return t.media_files.select("file_id", ff.megabytes(F.col("file_size") * 1000).alias("mb"),
                                hashing.bit_threshold((F.col("file_id") % 20) * 5 / 100.0).alias("bit_threshold"))


_REQ = """
    req AS (SELECT event_id AS pos, md5(event_type || '|' || ((user_id * 3) % 200)) AS cache_key, value, ts,
                   row_number() OVER () AS x FROM events)"""


def _requests(t):
    return t.read("events").select(F.col("event_id").alias("pos"),
                                   hashing.cache_key(F.col("event_type"), (F.col("user_id") * 3) % 200).alias("cache_key"), "value", "ts")


@query("J11_cache_hits_and_misses", f"""
    {_REQ}
    SELECT pos, c.cache_key IS NOT NULL AS hit, coalesce(c.access_count, CAST(round(value) AS BIGINT)) AS access_count
    FROM req LEFT JOIN (SELECT * FROM cache_entries WHERE expires_at >= {_NOW}) c ON c.cache_key = req.cache_key""", ("cache_entries",))
def cache_hits(t):
    got = cache.answer(_requests(t), t.cache_entries, "access_count", F.round("value").cast("long"), _now())
    return got.select("pos", "hit", "access_count")


@query("U02_cached_and_computed", f"""
    {_REQ}
    SELECT c.cache_key IS NOT NULL AS hit, count(*) AS n FROM req
    LEFT JOIN (SELECT * FROM cache_entries WHERE expires_at >= {_NOW}) c ON c.cache_key = req.cache_key GROUP BY 1""", ("cache_entries",))
def cached_and_computed(t):
    return cache.lookup(_requests(t), t.cache_entries, "access_count", _now()).groupBy("hit").agg(F.count("*").alias("n"))


@query("P12_touch_entries", f"""
    {_REQ},
    r AS (SELECT cache_key, count(*) AS n, max(ts) AS last FROM req GROUP BY 1)
    SELECT c.cache_key, access_count + coalesce(r.n, 0) AS access_count, coalesce(r.last, c.created_at) AS last_accessed
    FROM cache_entries c LEFT JOIN r ON r.cache_key = c.cache_key""", ("cache_entries",))
def touch_entries(t):
    entries = t.cache_entries.withColumn("last_accessed", F.col("created_at"))
    reads = _requests(t).select("cache_key", F.col("ts").alias("read_at"))
    return cache.touch(entries, reads).select("cache_key", "access_count", "last_accessed")


# ---- batches of detection results ----------------------------------------------------------------


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])


@query("A08_batch_statistics", """
    SELECT job_id, count(*) AS total_processed, count(*) FILTER (error IS NULL) AS successful, count(error) AS failed,
           count(*) FILTER (error IS NULL AND is_fake) AS fake_detected,
           count(*) FILTER (error IS NULL AND NOT is_fake AND is_duplicate) AS duplicate_detected,
           count(*) FILTER (error IS NULL AND NOT is_fake AND NOT is_duplicate) AS authentic,
           round(avg(confidence) FILTER (error IS NULL), 6) AS mean_confidence,
           round(stddev_pop(confidence) FILTER (error IS NULL), 6) AS std_confidence,
           min(confidence) FILTER (error IS NULL) AS min_confidence, max(confidence) FILTER (error IS NULL) AS max_confidence,
           round(sum(processing_time) FILTER (error IS NULL), 6) AS total_time,
           round(avg(processing_time) FILTER (error IS NULL), 6) AS mean_time,
           round(min(processing_time) FILTER (error IS NULL), 6) AS fastest, round(max(processing_time) FILTER (error IS NULL), 6) AS slowest,
           round(median(confidence) FILTER (error IS NULL), 6) AS median_confidence,
           round(median(processing_time) FILTER (error IS NULL), 6) AS median_time
    FROM result_envelope GROUP BY job_id""", ("result_envelope",))
def batch_statistics(t):
    return _rounded(stats.batch_statistics(t.result_envelope))


@query("A08_error_counts", "SELECT job_id, error, count(*) AS n FROM result_envelope WHERE error IS NOT NULL GROUP BY 1, 2", ("result_envelope",))
def error_counts(t):
    return stats.error_counts(t.result_envelope)


@query("A09_export_summary", """
    SELECT detection_mode, count(*) AS total_processed, count(*) - count(error) AS successful_analyses, count(error) AS failed_analyses,
           count(*) FILTER (is_fake) AS fake_detections, count(*) FILTER (is_duplicate) AS duplicate_detections,
           round(avg(confidence), 6) AS average_confidence, round(stddev_pop(confidence), 6) AS confidence_std,
           min(confidence) AS min_confidence, max(confidence) AS max_confidence,
           round(avg(processing_time), 6) AS average_processing_time, round(sum(processing_time), 6) AS total_processing_time
    FROM result_envelope GROUP BY 1""", ("result_envelope",))
def export_summary(t):
    return _rounded(stats.export_summary(t.result_envelope, "detection_mode"))


@query("A10_report_percentages", """
    s AS (SELECT job_id, count(*) AS n, count(*) - count(error) AS ok, count(error) AS bad, count(*) FILTER (error IS NULL AND is_fake) AS f,
                 count(*) FILTER (error IS NULL AND NOT is_fake AND is_duplicate) AS d FROM result_envelope GROUP BY 1)
    SELECT job_id, round(ok * 100.0::DOUBLE / greatest(n, 1), 4) AS successful_pct, round(bad * 100.0::DOUBLE / greatest(n, 1), 4) AS failed_pct,
           round(f * 100.0::DOUBLE / greatest(ok, 1), 4) AS fake_pct, round(d * 100.0::DOUBLE / greatest(ok, 1), 4) AS duplicate_pct FROM s""",
       ("result_envelope",))
def report_percentages(t):
    shares = stats.report_percentages(stats.batch_statistics(t.result_envelope))
    return shares.select("job_id", *[F.round(c, 4).alias(c) for c in ("successful_pct", "failed_pct", "fake_pct", "duplicate_pct")])


@query("A11_job_status", """
    SELECT job_id, count(*) AS total_files, count(*) - count(error) AS completed_files, count(error) AS failed_files,
           min(ts) AS start_time, max(ts) AS end_time, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration
    FROM result_envelope GROUP BY 1""", ("result_envelope",))
def job_status(t):
    return _rounded(stats.job_status(t.result_envelope))


@query("A17_confidence_histogram", """
    SELECT least(20, CAST(floor(20 * confidence) AS INT) + 1) AS bin, count(*) AS n FROM result_envelope GROUP BY 1""", ("result_envelope",))
def confidence_histogram(t):
    return stats.confidence_histogram(t.result_envelope)


@query("A18_model_agreement", """
    SELECT item_id, round((xc_conf + me_conf) / 2, 6) AS mean_confidence, round(abs(xc_conf - me_conf) / 2, 6) AS std_confidence,
           (CAST(xc_conf > 0.5 AS INT) + CAST(me_conf > 0.5 AS INT)) / 2.0::DOUBLE AS model_agreement FROM result_envelope""", ("result_envelope",))
def model_agreement(t):
    return _rounded(stats.model_agreement(t.result_envelope))


@query("A20_error_statistics", """
    SELECT error, count(*) AS n, max(ts) AS last_time, error IN ('MemoryError', 'SystemError', 'OSError', 'RuntimeError') AS critical
    FROM result_envelope WHERE error IS NOT NULL GROUP BY 1""", ("result_envelope",))
def error_statistics(t):
    return stats.error_statistics(t.result_envelope)


@query("A21_processing_statistics", """
    b AS (SELECT job_id, count(*) FILTER (NOT has_warnings) AS h, count(*) FILTER (has_warnings) AS m, sum(duplicate_count) AS d,
                 sum(processing_time) AS s, count(*) AS n FROM result_envelope GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS processed_files, CAST(sum(h) AS BIGINT) AS cache_hits, CAST(sum(m) AS BIGINT) AS cache_misses,
           round(sum(h) / sum(h + m), 6) AS cache_hit_rate, round(sum(d) / sum(n), 6) AS duplicates_per_file,
           round(avg(s), 4) AS avg_batch_time, round(sum(s), 4) AS total_processing_time FROM b""", ("result_envelope",))
def processing_statistics(t):
    rows = t.result_envelope.select(F.col("job_id").alias("batch"), (~F.col("has_warnings")).alias("hit"),
                                    F.col("duplicate_count").alias("duplicates"), F.col("processing_time").alias("seconds"))
    s = stats.processing_statistics(rows)
    return s.withColumns({c: F.round(c, 6) for c in ("cache_hit_rate", "duplicates_per_file")}).withColumns(
        {c: F.round(c, 4) for c in ("avg_batch_time", "total_processing_time")})
