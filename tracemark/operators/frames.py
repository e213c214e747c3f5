"""Frame sampling, frame sequences, face tables and per-video verdicts.

The samplers are predicates on the frame number and the number of frames, so they run before any pixel is
touched and need no ordering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.functions.text import percent
from tracemark.operators.ranking import positions
from tracemark.session import bounded_broadcast, materialise

RUN = 256


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("bigint")


def _ceil_div(a: Column, b: Column) -> Column:
    return _div(a + b - 1, b)


def stride_slot(idx: Column, n: Column, limit: int) -> Column:
    """Number of a frame in the stride sample, from 0: the sample's first k frames are those with a slot below k."""
    return _div(idx, F.greatest(F.lit(1), _div(n, F.lit(limit))))


def stride_sample(idx: Column, n: Column, limit: int) -> Column:
    """Every (n // limit)-th frame, at most `limit` frames."""
    step = F.greatest(F.lit(1), _div(n, F.lit(limit)))
    return (idx % step == 0) & (stride_slot(idx, n, limit) < limit)


def interval_sample(idx: Column, every: int = 30) -> Column:
    return idx % every == 0


def even_sample(idx: Column, n: Column, limit: int) -> Column:
    """`limit` frames evenly from first to last, positions truncated; all frames of a short video, none twice."""
    slot = _ceil_div(idx * (limit - 1), F.greatest(n - 1, F.lit(1)))
    hit = (slot <= limit - 1) & (_div(slot * (n - 1), F.lit(max(limit - 1, 1))) == idx)
    return (n <= limit) | (hit if limit > 1 else idx == 0)


def rate_sample(idx: Column, fps: Column, rate: float) -> Column:
    """About `rate` frames per second."""
    return idx % F.greatest(F.lit(1), F.floor(fps / rate)) == 0


def segment_sample(idx: Column, n: Column, limit: int) -> Column:
    """First frame of each of `limit` equal segments."""
    slot = _ceil_div(idx * limit, n)
    return (slot < limit) & (_div(slot * n, F.lit(limit)) == idx)


def timestamp_sample(frames: DataFrame, videos: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames shown at the wanted times (video_id, at); times after the end give nothing."""
    asked = wanted.join(videos.select("video_id", "n_frames", "fps"), "video_id").withColumn(
        "frame_idx", F.floor(F.col("at") * F.col("fps")).cast("int")).filter(F.col("frame_idx") < F.col("n_frames"))
    return frames.join(asked.select("video_id", "frame_idx", "at"), ["video_id", "frame_idx"])


def until_counted(sampled: DataFrame, count: str, limit: int = 50) -> DataFrame:
    """Frames of a sample up to the one with which the video's running total of `count` reaches `limit`.

    A frame stays while the earlier frames of its video hold fewer than `limit`, so the last one may pass it. Totals come from two levels: inside runs
    of 256 frame numbers, and over the runs' sums, which are a 256th of the rows. Runs that begin beyond the limit are dropped before frames are counted.
    """
    columns = sampled.columns
    runs = materialise(sampled.withColumn("_run", _div(F.col("frame_idx"), F.lit(RUN))), "counted-runs")
    sums = runs.groupBy("video_id", "_run").agg(F.sum(count).alias("_sum"))
    earlier_runs = Window.partitionBy("video_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select("video_id", "_run", F.coalesce(F.sum("_sum").over(earlier_runs), F.lit(0)).alias("_before")).filter(F.col("_before") < limit)
    inside = Window.partitionBy("video_id", "_run").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    counted = runs.join(materialise(begun, "begun-runs"), ["video_id", "_run"]).withColumn("_before", F.col("_before") + F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return counted.filter(F.col("_before") < limit).select(*columns)


def with_previous(frames: DataFrame, value: str, name: str) -> DataFrame:
    """`value` of the preceding frame of the same video, whatever the gap between their numbers, as column `name`.

    Videos are cut into runs of 256 frame numbers, so that a very long one is worked on by many tasks. The last frame of a run is
    repeated in the next run that has frames.
    """
    run = _div(F.col("frame_idx"), F.lit(RUN))
    lasts = frames.groupBy("video_id", run.alias("_run")).agg(F.max("frame_idx").alias("frame_idx"))
    follows = F.lead("_run").over(Window.partitionBy("video_id").orderBy("_run"))  # one row per run
    borders = materialise(lasts.select("video_id", "frame_idx", follows.alias("_run")).filter("_run is not null"), "run-borders")
    repeated = frames.join(bounded_broadcast(borders), ["video_id", "frame_idx"])
    spread = frames.withColumn("_run", run).withColumn("_own", F.lit(True)).unionByName(repeated.withColumn("_own", F.lit(False)))
    before = F.lag(value).over(Window.partitionBy("video_id", "_run").orderBy("frame_idx"))
    return spread.withColumn(name, before).filter("_own").drop("_run", "_own")


def _differences(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def scene_cuts(frames: DataFrame, quality: DataFrame, threshold: float = 30.0, min_quality: float = 0.0, limit: int | None = None) -> DataFrame:
    """Frames that differ strongly from the one before, of sufficient quality; with a `limit` the first ones of each video."""
    pairs = with_previous(frames, "pixels", "before").filter(F.col("before").isNotNull())
    changed = pairs.select("video_id", "frame_idx", "fps", _mean(_differences("pixels", "before")).alias("change")).filter(F.col("change") > threshold)
    good = changed.join(quality.filter(F.col("quality") >= min_quality), ["video_id", "frame_idx"])
    if limit is not None:
        first = Window.partitionBy("video_id").orderBy("frame_idx")
        good = good.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
    return good.select(
        "video_id", "frame_idx", F.try_divide("frame_idx", "fps").alias("timestamp"), "quality", "change")


def temporal_scores(frames: DataFrame) -> DataFrame:
    """Mean over a video of deviation / mean of the frame-to-frame differences, a tenth of it, at most 1."""
    pairs = with_previous(frames, "pixels", "before").filter(F.col("before").isNotNull())
    steps = pairs.select("video_id", _differences("pixels", "before").alias("d")).withColumn("m", _mean(F.col("d")))
    variance = F.aggregate("d", F.lit(0.0), lambda acc, v: acc + (v - F.col("m")) * (v - F.col("m"))) / F.size("d")
    return steps.groupBy("video_id").agg(F.least(F.avg(F.sqrt(variance) / (F.col("m") + 1e-6)) / 10, F.lit(1.0)).alias("temporal"))


def video_quality(features: DataFrame) -> DataFrame:
    """Means of the frame qualities; consistency is the population deviation of brightness."""
    return features.groupBy("video_id").agg(
        F.count("*").alias("total_frames"), F.avg("brightness").alias("avg_brightness"), F.avg("contrast").alias("avg_contrast"),
        F.avg("sharpness").alias("avg_sharpness"), F.stddev_pop("brightness").alias("frame_consistency"))


def modal_hashes(hashes: DataFrame, types: list[str]) -> DataFrame:
    """Most frequent frame hash of every video and type; the one seen first wins a tie."""
    long = hashes.unpivot(["video_id", "frame_idx"], types, "hash_type", "hash_value")
    counts = long.groupBy("video_id", "hash_type", "hash_value").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first"))
    return counts.groupBy("video_id", "hash_type").agg(F.max_by("hash_value", F.struct("n", -F.col("first"))).alias("hash_value"))


def ai_video_verdict(scores: DataFrame, threshold: float = 0.5, min_frames: int = 3) -> DataFrame:
    """Weighted ensemble of the video scores; a missing motion score leaves the weights, too few frames give no verdict."""
    weights = {"temporal": 0.25, "spatial": 0.20, "texture": 0.20, "motion": 0.20, "compression": 0.15}
    total = reduce(Column.__add__, [F.coalesce(F.col(s) * w, F.lit(0.0)) for s, w in weights.items()])
    used = reduce(Column.__add__, [F.when(F.col(s).isNotNull(), w).otherwise(0.0) for s, w in weights.items()])
    enough = F.col("frames_analyzed") >= min_frames
    rated = scores.withColumn("confidence", F.when(enough, F.coalesce(F.try_divide(total, used), F.lit(0.0))).otherwise(0.0))
    fake = F.col("confidence") > threshold
    high = lambda s, note: F.when(F.col(s) > 0.6, note)
    text = (
        F.when(~enough, "Video too short for reliable AI detection analysis (minimum 3 frames required)")
        .when(fake, F.concat_ws(" - ", F.concat(F.lit("AI-GENERATED VIDEO DETECTED: Confidence "), percent(F.col("confidence")), F.lit(" (above "), percent(F.lit(threshold)), F.lit(" threshold)")),
                                high("temporal", "High temporal inconsistencies detected"), high("spatial", "Spatial artifacts present"), high("texture", "Unusual texture patterns found")))
        .otherwise(F.concat(F.lit("AUTHENTIC VIDEO: Confidence "), percent(F.col("confidence")), F.lit(" (below "), percent(F.lit(threshold)), F.lit(" threshold) - Natural video characteristics detected"))))
    return rated.withColumn("is_ai_generated", enough & fake).withColumn("explanation", text)


def score_summary(scores: DataFrame, names: list[str]) -> DataFrame:
    """Best method, mean, population variance and the two strongest methods of every video's scores."""
    ranked = F.array_sort(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("v"), F.lit(n).alias("k"))) for n in names])))
    rows = scores.select("video_id", ranked.alias("r"))
    mean = F.aggregate("r", F.lit(0.0), lambda acc, e: acc + e["v"]) / F.size("r")
    with_mean = rows.withColumn("average_detection_score", mean)
    m = F.col("average_detection_score")
    return with_mean.select(
        "video_id", F.element_at("r", -1)["k"].alias("highest_scoring_method"), "average_detection_score",
        (F.aggregate("r", F.lit(0.0), lambda acc, e: acc + (e["v"] - m) * (e["v"] - m)) / F.size("r")).alias("detection_score_variance"),
        F.transform(F.slice("r", -2, 2), lambda e: e["k"]).alias("most_reliable_indicators"))


# ---- faces ---------------------------------------------------------------------------------------


def clamp_boxes(faces: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to the picture, empty ones dropped, with their area."""
    clip = lambda c, top: F.greatest(F.lit(0), F.least(F.col(c), top))
    cut = faces.withColumns({"x1": clip("x1", width), "y1": clip("y1", height), "x2": clip("x2", width), "y2": clip("y2", height)})
    return cut.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumn(
        "area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


def largest_faces(faces: DataFrame) -> DataFrame:
    """Largest face of every frame, the first on ties."""
    rest = [c for c in faces.columns if c not in ("video_id", "frame_idx")]
    return faces.groupBy("video_id", "frame_idx").agg(F.max_by(F.struct(*rest), F.struct("area", -F.col("face_idx"))).alias("f")).select("video_id", "frame_idx", "f.*")


def face_ensemble(faces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean of the two model scores; fake when strictly above the threshold."""
    return faces.withColumn("ensemble", (F.col("xception") + F.col("meso")) / 2).withColumn("is_fake", F.col("ensemble") > threshold)


def deepfake_verdict(faces: DataFrame, videos: DataFrame, frame_threshold: float = 0.3) -> DataFrame:
    """Verdict of every video from its scored faces; videos without a face stay, marked as such."""
    per_video = faces.groupBy("video_id").agg(
        F.count("*").alias("faces"), F.count_if("is_fake").alias("fake_frames"), F.avg("xception").alias("avg_xception"),
        F.avg("meso").alias("avg_meso"), F.avg("ensemble").alias("confidence"))
    rows = videos.join(per_video, "video_id", "left").fillna(0, ["faces", "fake_frames"]).fillna(0.0, ["confidence"])
    share = F.coalesce(F.try_divide(F.col("fake_frames"), F.col("faces")), F.lit(0.0))
    rated = rows.withColumns({"fake_share": share, "status": F.when(F.col("faces") == 0, "no_faces_detected").otherwise("completed")})
    rated = rated.withColumn("is_fake", F.col("fake_share") > frame_threshold)
    tally = F.concat(F.col("fake_frames"), F.lit("/"), F.col("faces"), F.lit(" frames ("), percent(F.col("fake_share")), F.lit(") classified as synthetic ("))
    limit = F.concat(percent(F.lit(frame_threshold)), F.lit(" threshold)"))
    return rated.withColumn("explanation", F.when(F.col("faces") == 0, "No faces detected in video for analysis.")
                            .when(F.col("is_fake"), F.concat(F.lit("DEEPFAKE DETECTED: "), tally, F.lit("exceeds "), limit))
                            .otherwise(F.concat(F.lit("AUTHENTIC: "), tally, F.lit("below "), limit)))


def first_faces(faces: DataFrame, k: int) -> DataFrame:
    """First k scored faces of every video, in frame order."""
    order = Window.partitionBy("video_id").orderBy("frame_idx", "face_idx")
    return faces.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def confidence_series(faces: DataFrame) -> DataFrame:
    """Three model confidences per frame, side by side."""
    return faces.groupBy("video_id", "frame_idx").agg(F.avg("xception").alias("xception"), F.avg("meso").alias("meso"), F.avg("ensemble").alias("ensemble"))


def confidence_summary(faces: DataFrame) -> DataFrame:
    return faces.groupBy("video_id").agg(F.count("*").alias("faces"), F.avg("ensemble").alias("avg_confidence"), F.max("ensemble").alias("max_confidence"),
                                         F.min("ensemble").alias("min_confidence"), F.stddev_pop("ensemble").alias("std_confidence"))


def face_statistics(faces: DataFrame) -> DataFrame:
    return faces.agg(
        F.count("*").alias("total_faces"), F.count_if("is_high_quality").alias("high_quality_faces"),
        F.coalesce(F.try_divide(F.count_if("is_high_quality"), F.count("*")), F.lit(0.0)).alias("quality_ratio"),
        F.avg("sharpness").alias("avg_sharpness"), F.avg("brightness").alias("avg_brightness"), F.avg("contrast").alias("avg_contrast"))


def face_table(frames: DataFrame, faces: DataFrame, frame_skip: int = 1) -> DataFrame:
    """Good faces of every `frame_skip`-th frame with the frame's time; `faces` carries the quality flag."""
    kept = frames.filter(F.col("frame_idx") % frame_skip == 0).select("video_id", "frame_idx", F.try_divide(F.col("frame_idx").cast("double"), "fps").alias("timestamp"))
    return faces.filter("is_high_quality").join(kept, ["video_id", "frame_idx"])


def batch_positions(rows: DataFrame, batch: str, order: str) -> DataFrame:
    """Position and share `file_index / total_files` of every row in its batch, by any order column."""
    placed = positions(rows, [batch], [order])
    return placed.withColumnsRenamed({"position": "file_index", "group_size": "total_files"}).withColumn(
        "progress", F.col("file_index") / F.col("total_files"))


def label_of_path(path: Column) -> Column:
    """`real` or `fake` from the folder names of a training video."""
    lowered = F.lower(path)
    return F.when(lowered.rlike("/(real|original)[^/]*/"), "real").when(lowered.rlike("/(fake|manipulated)[^/]*/"), "fake")
