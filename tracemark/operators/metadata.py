"""Embedded metadata of media files: authenticity, tag groups, and the image score built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemark.functions.text import percent

# Camera makers, marks of generation tools, and tags a camera writes.
CAMERA_BRANDS = ["Canon", "Nikon", "Sony", "Fujifilm", "Olympus", "Panasonic", "Leica", "Pentax", "Samsung", "LG", "Apple", "Google",
                 "OnePlus", "Huawei", "Xiaomi", "OPPO", "Vivo"]
AI_MARKS = ["DALL-E", "Midjourney", "Stable Diffusion", "StyleGAN", "BigGAN", "Adobe Firefly", "Runway", "Artbreeder", "DeepAI",
            "NightCafe", "Generated", "Synthetic", "AI", "Artificial"]
CAMERA_TAGS = ["DateTime", "DateTimeOriginal", "DateTimeDigitized", "Make", "Model", "Software", "GPS", "ExposureTime", "FNumber", "ISO",
               "Flash", "FocalLength", "WhiteBalance", "ColorSpace", "ExifVersion", "LensModel", "SerialNumber"]


def _any_tag(tags: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(n) for n in names]))


def authenticity(tags: Column) -> Column:
    """Score in [0, 1] from the presence of camera tags, less one half for any mark of a generation tool."""
    has_any = F.size(tags) > 0
    camera = _any_tag(tags, ["Make", "Model"])
    dated = _any_tag(tags, ["DateTime", "DateTimeOriginal"])
    technical = _any_tag(tags, ["ExposureTime", "FNumber", "ISO"])
    make = F.lower(F.trim(F.try_element_at(tags, F.lit("Make"))))
    brand = F.coalesce(reduce(Column.__or__, [make.contains(b.lower()) for b in CAMERA_BRANDS]), F.lit(False))
    known = F.size(F.array_intersect(F.map_keys(tags), F.array(*[F.lit(x) for x in CAMERA_TAGS])))
    marks = F.flatten(F.transform(F.map_entries(tags), lambda e: F.transform(
        F.filter(F.array(*[F.lit(m) for m in AI_MARKS]), lambda m: F.lower(e["value"]).contains(F.lower(m))),
        lambda m: F.concat(e["key"], F.lit(": "), m))))
    points = [(0.2, has_any), (0.2, camera), (0.15, dated), (0.2, technical), (0.15, brand), (0.1, known >= 5), (-0.5, F.size(marks) > 0)]
    score = reduce(Column.__add__, [F.when(test, w).otherwise(0.0) for w, test in points])
    return F.struct(
        has_any.alias("has_metadata"), camera.alias("has_camera_info"), dated.alias("has_datetime"), technical.alias("has_technical_data"),
        brand.alias("camera_brand_detected"), marks.alias("ai_indicators"), known.alias("authentic_fields_count"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("authenticity_score"))


def image_score(model: Column, spectral: Column, patch: Column, authentic: Column) -> Column:
    """Weighted generation score of an image; its maximum is 0.9."""
    return 0.35 * model + 0.2 * spectral + 0.2 * patch + 0.15 * (1 - authentic)


def explanation(score: Column, spectral: Column, patch: Column, meta: Column) -> Column:
    authentic = meta["authenticity_score"]
    marks = meta["ai_indicators"]
    tier = (F.when(score > 0.8, "High confidence that this image is AI-generated.")
            .when(score > 0.6, "Moderate confidence that this image is AI-generated.")
            .when(score > 0.4, "Some indicators suggest possible AI generation.")
            .otherwise("Low likelihood of AI generation - appears authentic."))
    note = lambda before, value: F.concat(F.lit(before), percent(value), F.lit(")."))
    return F.concat_ws(
        " ", tier,
        F.when(spectral > 0.6, note("StyleGAN artifacts detected (confidence: ", spectral)),
        F.when(patch > 0.6, note("DALL-E-style patterns detected (confidence: ", patch)),
        F.when(authentic > 0.7, note("Rich metadata suggests authentic camera capture (authenticity: ", authentic))
        .when(authentic > 0.4, note("Some authentic metadata present (authenticity: ", authentic))
        .when(~meta["has_metadata"], "No metadata found - suspicious for modern digital images.")
        .when(F.size(marks) > 0, F.concat(F.lit("AI generation indicators found in metadata: "), F.array_join(F.slice(marks, 1, 2), ", "), F.lit("."))))


def tag_categories(tags: Column) -> Column:
    """Tags grouped by the prefix of their name."""
    prefixes = {"exif": "EXIF", "gps": "GPS", "image": "Image", "thumbnail": "Thumbnail"}
    group = lambda prefix: F.map_filter(tags, lambda k, _: k.startswith(prefix))
    groups = [group(p).alias(n) for n, p in prefixes.items()]
    other = F.map_filter(tags, lambda k, _: ~reduce(Column.__or__, [k.startswith(p) for p in prefixes.values()]))
    return F.struct(*groups, other.alias("other"))
