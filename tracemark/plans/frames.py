"""Frame, face and pixel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemark.operators import frames as fr
from tracemark.operators import pixels as px
from tracemark.operators.ranking import positions
from tracemark.plans.registry import query
from tracemark.session import spread

_idx = lambda: F.col("frame_idx")
_n = lambda: F.col("n_frames")


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _positions(t):
    return t.frames.select("video_id", "frame_idx", "fps").join(t.videos.select("video_id", "n_frames"), "video_id")


# Longer frame numberings for the samplers: one video per user, its events in order.
_LONG = """lv AS (SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS frame_idx FROM events),
    ln AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM lv)"""


def _long(t):
    placed = positions(t.read("events").select(F.col("user_id").alias("video_id"), "event_id"), ["video_id"], ["event_id"])
    return placed.select("video_id", (F.col("position") - 1).alias("frame_idx"), F.col("group_size").alias("n_frames"))


@query("I01_stride_sample", f"""
    {_LONG} SELECT video_id, frame_idx FROM ln WHERE frame_idx % greatest(1, n // 20) = 0 AND frame_idx // greatest(1, n // 20) < 20""")
def stride_sample(t):
    return _long(t).filter(fr.stride_sample(_idx(), _n(), 20)).select("video_id", "frame_idx")


@query("I01_face_counted_sample", """
    ln AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame_idx, count(*) OVER (PARTITION BY event_type) AS n,
                  CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END AS faces FROM events),
    s AS (SELECT * FROM ln WHERE frame_idx % greatest(1, n // 500) = 0),
    c AS (SELECT *, coalesce(sum(faces) OVER (PARTITION BY event_type ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT event_type AS video_id, frame_idx, faces FROM c WHERE before < 50""")
def face_counted_sample(t):
    """All events of a type as the frames of one long video, a few with faces; sampling stops once 50 faces were seen."""
    placed = positions(t.read("events").select(F.col("event_type").alias("video_id"), "event_id"), ["video_id"], ["event_id"])
    faces = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 4).otherwise(0)
    frames = placed.select("video_id", (F.col("position") - 1).alias("frame_idx"), F.col("group_size").alias("n_frames"), faces.alias("faces"))
    return fr.until_counted(frames.filter(_idx() % F.greatest(F.lit(1), F.floor(_n() / 500)) == 0), "faces").select("video_id", "frame_idx", "faces")


@query("I02_interval_sample", f"{_LONG} SELECT video_id, frame_idx FROM ln WHERE frame_idx % 30 = 0")
def interval_sample(t):
    return _long(t).filter(fr.interval_sample(_idx())).select("video_id", "frame_idx")


@query("I03_even_sample", f"""
    {_LONG},
    pick AS (SELECT DISTINCT video_id, (i * (n - 1)) // 15 AS frame_idx FROM (SELECT DISTINCT video_id, n FROM ln), range(16) r(i) WHERE n > 16)
    SELECT video_id, frame_idx FROM ln WHERE n <= 16 UNION ALL SELECT video_id, frame_idx FROM pick""")
def even_sample(t):
    return _long(t).filter(fr.even_sample(_idx(), _n(), 16)).select("video_id", "frame_idx")


@query("I04_rate_sample", f"{_LONG} SELECT video_id, frame_idx FROM ln WHERE frame_idx % 12 = 0")
def rate_sample(t):
    return _long(t).filter(fr.rate_sample(_idx(), F.lit(25.0), 2.0)).select("video_id", "frame_idx")


@query("I05_timestamp_sample", """
    SELECT f.video_id, f.frame_idx, w.at FROM (SELECT user_id AS video_id, value / 100 AS at FROM events) w
    JOIN frames f ON f.video_id = w.video_id AND f.frame_idx = CAST(floor(w.at * 25.0::DOUBLE) AS INT)""", ("frames",))
def timestamp_sample(t):
    wanted = t.read("events").select(F.col("user_id").alias("video_id"), (F.col("value") / 100).alias("at"))
    return fr.timestamp_sample(t.frames, t.videos, wanted).select("video_id", "frame_idx", "at")


@query("I06_segment_sample", f"""
    {_LONG}
    SELECT DISTINCT video_id, least((i * n) // 5, n - 1) AS frame_idx FROM (SELECT DISTINCT video_id, n FROM ln), range(5) r(i)""")
def segment_sample(t):
    return _long(t).filter(fr.segment_sample(_idx(), _n(), 5)).select("video_id", "frame_idx")


@query("W06_batch_positions", """
    SELECT item_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY item_id) AS file_index, count(*) OVER (PARTITION BY job_id) AS total_files,
           round(row_number() OVER (PARTITION BY job_id ORDER BY item_id) / count(*) OVER (PARTITION BY job_id), 6) AS progress
    FROM result_envelope""", ("result_envelope",))
def batch_positions(t):
    return _r(fr.batch_positions(t.result_envelope.select("item_id", "job_id"), "job_id", "item_id"))


_LAG = """lg AS (SELECT video_id, frame_idx, fps, pixels, lag(pixels) OVER (PARTITION BY video_id ORDER BY frame_idx) AS before FROM frames),
    df AS (SELECT video_id, frame_idx, fps, list_transform(range(1, 65), lambda i: CAST(abs(pixels[i] - before[i]) AS DOUBLE)) AS d FROM lg WHERE before IS NOT NULL)"""
_LAP = """lap AS (SELECT video_id, frame_idx, var_pop(pixels[(CASE WHEN y = 0 THEN 1 ELSE y - 1 END) * 8 + x + 1] + pixels[(CASE WHEN y = 7 THEN 6 ELSE y + 1 END) * 8 + x + 1]
        + pixels[y * 8 + (CASE WHEN x = 0 THEN 1 ELSE x - 1 END) + 1] + pixels[y * 8 + (CASE WHEN x = 7 THEN 6 ELSE x + 1 END) + 1] - 4 * pixels[i + 1]) AS sharpness,
        avg(pixels[i + 1]) AS brightness, stddev_pop(pixels[i + 1]) AS contrast
    FROM (SELECT video_id, frame_idx, pixels, i, i // 8 AS y, i % 8 AS x FROM frames, range(64) r(i)) GROUP BY 1, 2)"""


def _quality(t):
    return px.with_features(t.frames, "sharpness", ["video_id", "frame_idx"])


@query("I10_P14_frame_quality", f"""
    {_LAP}
    SELECT video_id, frame_idx, round(least(1.0::DOUBLE, sharpness / 1000 + contrast / 255), 6) AS quality FROM lap
    WHERE least(1.0::DOUBLE, sharpness / 1000 + contrast / 255) >= 0.5""", ("frames",))
def frame_quality(t):
    rated = _quality(t).withColumn("quality", px.frame_quality())
    return _r(rated.filter("quality >= 0.5").select("video_id", "frame_idx", "quality"))


@query("W02_scene_cuts", f"""
    {_LAG}, {_LAP},
    c AS (SELECT df.video_id, df.frame_idx, df.frame_idx / fps AS timestamp, least(1.0::DOUBLE, sharpness / 1000 + contrast / 255) AS quality, list_avg(d) AS change
          FROM df JOIN lap USING (video_id, frame_idx))
    SELECT video_id, frame_idx, round(timestamp, 6) AS timestamp, round(quality, 6) AS quality, round(change, 6) AS change FROM c WHERE change > 30""", ("frames",))
def scene_cuts(t):
    quality = _quality(t).select("video_id", "frame_idx", px.frame_quality().alias("quality"))
    return _r(fr.scene_cuts(t.frames, quality))


@query("W03_temporal_scores", f"""
    {_LAG}
    SELECT video_id, round(least(1.0::DOUBLE, avg(list_stddev_pop(d) / (list_avg(d) + 1e-6)) / 10), 6) AS temporal FROM df GROUP BY 1""", ("frames",))
def temporal_scores(t):
    return _r(fr.temporal_scores(t.frames))


@query("A15_video_quality", f"""
    {_LAP}
    SELECT video_id, count(*) AS total_frames, round(avg(brightness) + 1e-9, 6) AS avg_brightness, round(avg(contrast), 6) AS avg_contrast,
           round(avg(sharpness) + 1e-9, 5) AS avg_sharpness, round(stddev_pop(brightness), 6) AS frame_consistency FROM lap GROUP BY 1""", ("frames",))
def video_quality(t):
    q = fr.video_quality(_quality(t)).withColumn("avg_sharpness", F.round(F.col("avg_sharpness") + 1e-9, 5))
    return _r(q.withColumn("avg_brightness", F.col("avg_brightness") + 1e-9))


@query("A24_glcm_contrast", """
    SELECT video_id, frame_idx, round(least(1.0::DOUBLE, avg((pixels[i + 2] - pixels[i + 1]) * (pixels[i + 2] - pixels[i + 1])) / 10000) + 1e-9, 6) AS glcm
    FROM frames, range(63) r(i) WHERE i % 8 < 7 GROUP BY 1, 2""", ("frames",))
def glcm_contrast(t):
    features = px.with_features(t.frames, "texture", ["video_id", "frame_idx"])
    return _r(features.select("video_id", "frame_idx", (px.capped(F.col("glcm_contrast") / 10000) + 1e-9).alias("glcm")))


@query("I18_lbp_uniformity", """
    c AS (SELECT video_id, frame_idx, i, list_sum([CASE WHEN pixels[i - 8] >= pixels[i + 1] THEN 128 ELSE 0 END, CASE WHEN pixels[i - 7] >= pixels[i + 1] THEN 64 ELSE 0 END,
              CASE WHEN pixels[i - 6] >= pixels[i + 1] THEN 32 ELSE 0 END, CASE WHEN pixels[i + 2] >= pixels[i + 1] THEN 16 ELSE 0 END,
              CASE WHEN pixels[i + 10] >= pixels[i + 1] THEN 8 ELSE 0 END, CASE WHEN pixels[i + 9] >= pixels[i + 1] THEN 4 ELSE 0 END,
              CASE WHEN pixels[i + 8] >= pixels[i + 1] THEN 2 ELSE 0 END, CASE WHEN pixels[i] >= pixels[i + 1] THEN 1 ELSE 0 END]) AS code
          FROM frames, range(64) r(i) WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6),
    n AS (SELECT video_id, frame_idx, code, count(*) AS k FROM c GROUP BY ALL)
    SELECT video_id, frame_idx, round(sum(k * k) / 1296.0::DOUBLE, 6) AS lbp_uniformity FROM n GROUP BY 1, 2""", ("frames",))
def lbp_uniformity(t):
    features = px.with_features(t.frames, "texture", ["video_id", "frame_idx"])
    return _r(features.select("video_id", "frame_idx", "lbp_uniformity"))


_HEX = """array_to_string(list_transform(range(16), lambda j: ('0123456789abcdef')[CAST(8 * CAST(pixels[4 * j + 1] > {m} AS INT) + 4 * CAST(pixels[4 * j + 2] > {m} AS INT)
           + 2 * CAST(pixels[4 * j + 3] > {m} AS INT) + CAST(pixels[4 * j + 4] > {m} AS INT) AS INT) + 1]), '')"""
_FH = f"""fh AS (SELECT video_id, frame_idx, {_HEX.format(m='(list_sum(pixels) / 64.0::DOUBLE)')} AS ahash, {_HEX.format(m='list_median(pixels)')} AS whash FROM frames)"""


@query("I07_frame_hashes", f"{_FH} SELECT video_id, frame_idx, ahash, whash FROM fh", ("frames",))
def frame_hashes(t):
    return px.with_features(t.frames, "hashes", ["video_id", "frame_idx"]).select("video_id", "frame_idx", "ahash", "whash")


@query("I07_I08_image_hashes")
def image_hashes(t):
    pictures = spread(t.images)
    perceptual = px.with_features(pictures, "hashes", ["file_id"])
    crypto = pictures.select("file_id", F.sha2("data", 256).alias("sha256"))
    return perceptual.join(crypto, "file_id").unpivot("file_id", ["sha256", "phash", "dhash"], "hash_type", "hash_value")


@query("A16_video_fingerprint", f"""
    {_FH},
    l AS (SELECT video_id, frame_idx, 'ahash' AS hash_type, ahash AS hash_value FROM fh UNION ALL SELECT video_id, frame_idx, 'whash', whash FROM fh),
    c AS (SELECT video_id, hash_type, hash_value, count(*) AS n, min(frame_idx) AS f FROM l GROUP BY ALL)
    SELECT video_id, hash_type, hash_value FROM (SELECT *, row_number() OVER (PARTITION BY video_id, hash_type ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""", ("frames",))
def video_fingerprint(t):
    hashes = px.with_features(t.frames, "hashes", ["video_id", "frame_idx"])
    return fr.modal_hashes(hashes, ["ahash", "whash"])


@query("A16_video_hashes_sampled")
def video_hashes(t):
    sampled = t.frames.filter(fr.interval_sample(_idx(), 3))
    return fr.modal_hashes(px.with_features(sampled, "hashes", ["video_id", "frame_idx"]), ["dhash", "ahash", "phash", "whash"])


@query("I09_image_statistics")
def image_statistics(t):
    s = px.with_features(spread(t.images), "statistics", ["file_id"])
    return s.select("file_id", *[F.round(c, 6).alias(c) for c in ("mean_brightness", "std_brightness", "contrast_ratio", "edge_density", "texture_variance")])


@query("I09_frame_brightness", """
    SELECT video_id, frame_idx, round(avg(pixels[i + 1]), 6) AS mean_brightness, round(stddev_pop(pixels[i + 1]), 6) AS std_brightness,
           CAST(min(pixels[i + 1]) AS DOUBLE) AS min_brightness, CAST(max(pixels[i + 1]) AS DOUBLE) AS max_brightness,
           round(stddev_pop(pixels[i + 1]) / avg(pixels[i + 1]), 6) AS contrast_ratio FROM frames, range(64) r(i) GROUP BY 1, 2""", ("frames",))
def frame_brightness(t):
    s = px.with_features(t.frames, "statistics", ["video_id", "frame_idx"])
    return _r(s.select("video_id", "frame_idx", "mean_brightness", "std_brightness", "min_brightness", "max_brightness", "contrast_ratio"))


@query("I12_spectral_score")
def spectral_score(t):
    s = px.with_features(spread(t.images), "spectral", ["file_id"])
    return s.select("file_id", F.round(px.spectral_score(), 6).alias("score"))


@query("I13_patch_score")
def patch_score(t):
    s = px.with_features(spread(t.images), "patches", ["file_id"])
    return s.select("file_id", F.size("edge_densities").alias("patches"), F.round(px.patch_score(), 6).alias("score"))


#: A model input is 600 times its frame: a task gets a fixed number of frames, however large the splits of the file are.
FRAMES_A_TASK = 500


@query("I22_model_input")
def model_input(t):
    tasks = max(t.read("embeddings").count() // FRAMES_A_TASK + 1, t.spark.sparkContext.defaultParallelism)
    s = px.with_features(t.frames.repartition(tasks), "model_input", ["video_id", "frame_idx"])
    return s.select("video_id", "frame_idx", F.size("model_input").alias("n"), F.array_min("model_input").alias("low"), F.array_max("model_input").alias("high"))


def _video_scores(t):
    picked = _positions(t).filter(fr.stride_sample(_idx(), _n(), 100)).select("video_id", "frame_idx", fr.stride_slot(_idx(), _n(), 100).alias("slot"))
    sampled = picked.join(t.frames, ["video_id", "frame_idx"])
    key = ["video_id", "frame_idx"]
    first = lambda n: sampled.filter(F.col("slot") < n)
    texture = px.with_features(first(10), "texture", key).groupBy("video_id").agg(F.avg(px.spatial_score()).alias("spatial"), F.avg(px.texture_score()).alias("texture"))
    blocks = px.with_features(first(5), "blocks", key).groupBy("video_id").agg(F.avg(px.compression_score()).alias("compression"))
    counted = sampled.groupBy("video_id").agg(F.count("*").alias("frames_analyzed"))
    scores = counted.join(fr.temporal_scores(sampled), "video_id", "left").join(texture, "video_id", "left").join(blocks, "video_id", "left")
    return scores.withColumn("motion", F.lit(None).cast("double"))


@query("I17_I18_I19_video_scores")
def video_scores(t):
    return _r(_video_scores(t).select("video_id", "temporal", "spatial", "texture", "compression"))


@query("I19_compression_scores", """
    b AS (SELECT video_id, (list_avg(list_transform(range(1, 9), lambda i: CAST(abs(pixels[56 + i] - pixels[48 + i]) AS DOUBLE)))
                 + list_avg(list_transform(range(8), lambda i: CAST(abs(pixels[8 * i + 8] - pixels[8 * i + 7]) AS DOUBLE)))) / 2 AS step
          FROM frames WHERE frame_idx < 5)
    SELECT video_id, round(avg(least(1.0::DOUBLE, step / 50)) * 0.4::DOUBLE, 6) AS compression FROM b GROUP BY 1""", ("frames",))
def compression_scores(t):
    picked = _positions(t).filter(fr.stride_sample(_idx(), _n(), 100) & (fr.stride_slot(_idx(), _n(), 100) < 5)).select("video_id", "frame_idx")
    blocks = px.with_features(picked.join(t.frames, ["video_id", "frame_idx"]), "blocks", ["video_id", "frame_idx"])
    return _r(blocks.groupBy("video_id").agg(F.avg(px.compression_score()).alias("compression")))


@query("I20_ai_video_verdict")
def ai_video_verdict(t):
    return _r(fr.ai_video_verdict(_video_scores(t)).select("video_id", "frames_analyzed", "confidence", "is_ai_generated", "explanation"))


_SC = """sc AS (SELECT event_id AS video_id, value / 500 AS temporal, k / 100.0::DOUBLE AS spatial, (k * 37 % 101) / 101.0::DOUBLE AS texture,
    CASE WHEN k % 3 = 0 THEN (k * 13 % 97) / 97.0::DOUBLE END AS motion, (k * 7 % 89) / 89.0::DOUBLE AS compression, k % 8 AS frames_analyzed FROM ev)"""


def _scores(t):
    k = F.col("k")
    return t.events.select(F.col("event_id").alias("video_id"), (F.col("value") / 500).alias("temporal"), (k / 100.0).alias("spatial"), ((k * 37 % 101) / 101.0).alias("texture"),
                           F.when(k % 3 == 0, (k * 13 % 97) / 97.0).alias("motion"), ((k * 7 % 89) / 89.0).alias("compression"), (k % 8).alias("frames_analyzed"))


@query("I20_ensemble_rule", f"""
    {_SC},
    e AS (SELECT *, CASE WHEN frames_analyzed >= 3 THEN (0.25::DOUBLE * temporal + 0.20::DOUBLE * spatial + 0.20::DOUBLE * texture + coalesce(0.20::DOUBLE * motion, 0)
              + 0.15::DOUBLE * compression) / (CASE WHEN motion IS NULL THEN 0.80::DOUBLE ELSE 1.0::DOUBLE END) ELSE 0.0::DOUBLE END AS c FROM sc)
    SELECT video_id, round(c, 6) AS confidence, c > 0.5 AS is_ai_generated FROM e""", ("ev",))
def ensemble_rule(t):
    return _r(fr.ai_video_verdict(_scores(t)).select("video_id", "confidence", "is_ai_generated"))


@query("A23_score_summary", f"""
    {_SC},
    l AS (SELECT video_id, unnest([temporal, spatial, texture, motion, compression]) AS v, unnest(['temporal', 'spatial', 'texture', 'motion', 'compression']) AS m FROM sc)
    SELECT video_id, arg_max(m, (v, m)) AS highest_scoring_method, round(avg(v), 6) AS average_detection_score, round(var_pop(v), 6) AS detection_score_variance
    FROM l WHERE v IS NOT NULL GROUP BY 1""", ("ev",))
def score_summary(t):
    s = fr.score_summary(_scores(t), ["temporal", "spatial", "texture", "motion", "compression"])
    return _r(s.drop("most_reliable_indicators"))


# ---- faces ---------------------------------------------------------------------------------------

_ENS = "es AS (SELECT *, (xception + meso) / 2 AS ensemble, (xception + meso) / 2 > 0.6 AS fake FROM faces)"


def _scored(t):
    return fr.face_ensemble(t.faces, 0.6)


@query("I21_face_ensemble", f"{_ENS} SELECT video_id, frame_idx, face_idx, round(ensemble, 6) AS ensemble, fake AS is_fake FROM es", ("faces",))
def face_ensemble(t):
    return _r(_scored(t).select("video_id", "frame_idx", "face_idx", "ensemble", "is_fake"))


@query("A12_deepfake_verdict", f"""
    {_ENS},
    v AS (SELECT video_id, count(*) AS faces, count(*) FILTER (fake) AS f, avg(xception) AS x, avg(meso) AS m, avg(ensemble) AS e FROM es GROUP BY 1)
    SELECT videos.video_id, coalesce(faces, 0) AS faces, coalesce(f, 0) AS fake_frames, round(x, 6) AS avg_xception, round(m, 6) AS avg_meso,
           round(coalesce(e, 0), 6) AS confidence, coalesce(f / faces > 0.3, false) AS is_fake,
           CASE WHEN faces IS NULL THEN 'no_faces_detected' ELSE 'completed' END AS status FROM videos LEFT JOIN v ON v.video_id = videos.video_id""", ("faces", "videos"))
def deepfake_verdict(t):
    return _r(fr.deepfake_verdict(_scored(t), t.videos).select("video_id", "faces", "fake_frames", "avg_xception", "avg_meso", "confidence", "is_fake", "status"))


@query("A13_confidence_summary", f"""
    {_ENS} SELECT video_id, count(*) AS faces, round(avg(ensemble), 6) AS avg_confidence, round(max(ensemble), 6) AS max_confidence, round(min(ensemble), 6) AS min_confidence,
           round(stddev_pop(ensemble), 6) AS std_confidence FROM es GROUP BY 1""", ("faces",))
def confidence_summary(t):
    return _r(fr.confidence_summary(_scored(t)))


@query("A19_fake_frame_split", f"{_ENS} SELECT fake AS is_fake, count(*) AS n FROM es GROUP BY 1", ("faces",))
def fake_split(t):
    return _scored(t).groupBy("is_fake").agg(F.count("*").alias("n"))


@query("W07_confidence_series", f"""
    {_ENS} SELECT video_id, frame_idx, round(avg(xception), 6) AS xception, round(avg(meso), 6) AS meso, round(avg(ensemble), 6) AS ensemble FROM es GROUP BY 1, 2""", ("faces",))
def confidence_series(t):
    return _r(fr.confidence_series(_scored(t))).orderBy("video_id", "frame_idx")


@query("L06_first_faces", f"""
    {_ENS} SELECT video_id, frame_idx, face_idx, fake AS is_fake FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, face_idx) AS r FROM es) WHERE r <= 5""", ("faces",))
def first_faces(t):
    return fr.first_faces(_scored(t), 5).select("video_id", "frame_idx", "face_idx", "is_fake")


_BOX = """bx AS (SELECT *, (x2c - x1c) * (y2c - y1c) AS area FROM (SELECT *, greatest(0, least(x1, 40)) AS x1c, greatest(0, least(y1, 40)) AS y1c,
    greatest(0, least(x2, 40)) AS x2c, greatest(0, least(y2, 40)) AS y2c FROM faces) WHERE x2c > x1c AND y2c > y1c)"""


@query("W04_F17_largest_faces", f"""
    {_BOX} SELECT video_id, frame_idx, face_idx, area FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY area DESC, face_idx) AS r FROM bx) WHERE r = 1""", ("faces",))
def largest_faces(t):
    boxed = fr.clamp_boxes(t.faces, F.lit(40), F.lit(40))
    return fr.largest_faces(boxed).select("video_id", "frame_idx", "face_idx", "area")


_FQ = """fl AS (SELECT video_id, frame_idx, face_idx, least(x2 - x1, y2 - y1) AS side,
        var_pop(crop[(CASE WHEN y = 0 THEN 1 ELSE y - 1 END) * 8 + x + 1] + crop[(CASE WHEN y = 3 THEN 2 ELSE y + 1 END) * 8 + x + 1]
        + crop[y * 8 + (CASE WHEN x = 0 THEN 1 ELSE x - 1 END) + 1] + crop[y * 8 + (CASE WHEN x = 7 THEN 6 ELSE x + 1 END) + 1] - 4 * crop[i + 1]) AS sharpness,
        avg(crop[i + 1]) AS brightness, stddev_pop(crop[i + 1]) AS contrast
    FROM (SELECT *, i // 8 AS y, i % 8 AS x FROM faces, range(32) r(i)) GROUP BY ALL),
    fq AS (SELECT *, sharpness > 10 AND brightness > 20 AND brightness < 250 AND contrast > 5 AND side >= 32 AS hq FROM fl)"""


def _face_quality(t):
    crops = t.faces.select("video_id", "frame_idx", "face_idx", F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("int").alias("side"),
                           F.lit(4).alias("height"), F.lit(8).alias("width"), F.col("crop").alias("pixels"))
    features = px.with_features(crops, "sharpness", ["video_id", "frame_idx", "face_idx", "side"])
    good = px.is_high_quality(F.col("sharpness"), F.col("brightness"), F.col("contrast"), F.col("side"))
    return features.withColumn("is_high_quality", good)


@query("I11_P13_face_quality", f"{_FQ} SELECT video_id, frame_idx, face_idx, round(sharpness + 1e-9, 5) AS sharpness, round(brightness, 6) AS brightness, hq AS is_high_quality FROM fq", ("faces",))
def face_quality(t):
    return _face_quality(t).select("video_id", "frame_idx", "face_idx", F.round(F.col("sharpness") + 1e-9, 5).alias("sharpness"), F.round("brightness", 6).alias("brightness"), "is_high_quality")


@query("A14_face_statistics", f"""
    {_FQ} SELECT count(*) AS total_faces, count(*) FILTER (hq) AS high_quality_faces, round(count(*) FILTER (hq) / count(*), 6) AS quality_ratio,
           round(avg(sharpness), 4) AS avg_sharpness, round(avg(brightness), 4) AS avg_brightness, round(avg(contrast), 4) AS avg_contrast FROM fq""", ("faces",))
def face_statistics(t):
    s = fr.face_statistics(_face_quality(t))
    return s.withColumns({"quality_ratio": F.round("quality_ratio", 6), **{c: F.round(c, 4) for c in ("avg_sharpness", "avg_brightness", "avg_contrast")}})


@query("I24_face_table", f"""
    {_FQ} SELECT video_id, frame_idx, face_idx, round(frame_idx / 25.0::DOUBLE, 6) AS timestamp FROM fq WHERE hq AND frame_idx % 2 = 0""", ("faces",))
def face_table(t):
    return _r(fr.face_table(t.frames, _face_quality(t), 2).select("video_id", "frame_idx", "face_idx", "timestamp"))


@query("X06_frame_indices", "SELECT video_id, unnest(range(n_frames)) AS frame_idx FROM videos", ("videos",))
def frame_indices(t):
    return t.videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - 1)).alias("frame_idx"))
