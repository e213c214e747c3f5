"""Report rules over the result envelope: one row in, verdict, risk, findings and export fields out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemark.functions.text import percent

# Advice per risk level.
ADVICE = {
    "HIGH": [
        "Content should be flagged as potentially manipulated",
        "Additional verification through alternative detection methods recommended",
        "Consider forensic analysis of source metadata and compression artifacts",
    ],
    "MEDIUM": [
        "Content requires manual review by trained analyst",
        "Cross-reference with original source if available",
        "Apply additional detection algorithms for confirmation",
    ],
    "LOW": [
        "Monitor for additional suspicious indicators",
        "Document findings for future reference",
        "Consider batch analysis of related content",
    ],
    "MINIMAL": [
        "Content appears authentic based on current analysis",
        "Continue standard processing workflow",
        "Archive analysis results for audit trail",
    ],
}
# Metadata fields expected of a camera file, and software names that raise suspicion.
EXPECTED_METADATA = ["datetime", "camera", "software", "gps"]
SUSPICIOUS_SOFTWARE = ["photoshop", "gimp", "deepfake", "fakeapp"]

# Sentences of verdicts, findings and forensic indicators.
VERDICTS = {
    "synthetic": "SYNTHETIC/MANIPULATED CONTENT DETECTED",
    "duplicate": "DUPLICATE CONTENT DETECTED",
    "suspicious": "SUSPICIOUS CONTENT - REQUIRES REVIEW",
    "authentic": "AUTHENTIC CONTENT - NO MANIPULATION DETECTED",
}
INDICATORS = {
    "tampering": "Content manipulation detected",
    "metadata_anomaly": "Inconsistent metadata detected",
    "compression_anomaly": "Unusual compression patterns detected",
}

_flag = lambda c: F.coalesce(F.col(c), F.lit(False))
_number = lambda c: F.coalesce(F.col(c), F.lit(0))


def verdict() -> Column:
    return (
        F.when(_flag("is_fake") | _flag("is_synthetic"), VERDICTS["synthetic"])
        .when(_flag("is_duplicate"), VERDICTS["duplicate"])
        .when(_number("suspicious_indicators") > 0, VERDICTS["suspicious"])
        .otherwise(VERDICTS["authentic"])
    )


def overall_confidence(with_models: bool = False) -> Column:
    """Mean of the confidences present, 0 when there is none."""
    scores = F.array("confidence", "detection_confidence")
    if with_models:
        models = F.transform(F.map_values("model_predictions"), lambda p: p["confidence"])
        scores = F.concat(scores, F.coalesce(models, F.array().cast("array<double>")))
    present = F.array_compact(scores)
    return F.coalesce(F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, v: a + v), F.size(present)), F.lit(0.0))


def risk_level(confidence: Column) -> Column:
    return (
        F.when(_flag("is_fake") & (confidence > 0.8), "HIGH")
        .when(_flag("is_fake") & (confidence > 0.6), "MEDIUM")
        .when(_number("suspicious_indicators") > 0, "LOW")
        .otherwise("MINIMAL")
    )


def key_findings(with_models: bool = True) -> Column:
    findings = F.array_compact(F.array(
        F.when(_flag("is_fake"), F.concat(F.lit("AI-generated content detected with "), percent(_number("confidence")), F.lit(" confidence"))),
        F.when(_flag("deepfake_detected"), "Deepfake indicators found in facial analysis"),
        F.when(_flag("is_duplicate"), F.concat(F.lit("Content matches "), _number("duplicate_count"), F.lit(" existing files"))),
        F.when(_number("compression_artifacts") > 0.7, "High compression artifacts detected"),
        F.when(_flag("metadata_inconsistent"), "Metadata inconsistencies found"),
    ))
    if with_models:
        odd = F.map_filter("model_predictions", lambda _, p: p["anomaly_score"] > 0.5)
        names = F.transform(F.map_keys(odd), lambda m: F.concat(m, F.lit(" model detected anomalies")))
        findings = F.concat(findings, F.coalesce(names, F.array().cast("array<string>")))
    return F.when(F.size(findings) > 0, findings).otherwise(F.array(F.lit("No significant anomalies detected")))


def recommendations(risk: Column, short: bool = False) -> Column:
    """Advice by risk level, then the technical notes; the short form knows no LOW level and no notes."""
    lists = {r: F.array(*[F.lit(x) for x in lines]) for r, lines in ADVICE.items()}
    advice = reduce(lambda acc, r: acc.when(risk == r, lists[r]), ["HIGH", "MEDIUM"] if short else ["HIGH", "MEDIUM", "LOW"], F)
    advice = advice.otherwise(lists["MINIMAL"])
    if short:
        return advice
    notes = F.array_compact(F.array(
        F.when(_flag("low_resolution"), "Consider higher resolution analysis for improved accuracy"),
        F.when(_number("processing_time") > 30, "Long processing time detected - consider optimization"),
    ))
    return F.concat(advice, notes)


def metadata_integrity(metadata: Column) -> Column:
    keys = F.transform(F.map_keys(metadata), F.lower)
    named = lambda field: F.exists(keys, lambda k: k.contains(field)).cast("int")
    present = [named(field) for field in EXPECTED_METADATA]
    software = F.map_values(F.map_filter(metadata, lambda k, _: F.lower(k).contains("software")))
    bad = F.filter(software, lambda v: reduce(Column.__or__, [F.lower(v).contains(s) for s in SUSPICIOUS_SOFTWARE]))
    return F.struct(
        (F.size(metadata) > 0).alias("present"),
        (reduce(Column.__add__, present) >= 2).alias("complete"),
        (F.size(bad) == 0).alias("consistent"),
        F.transform(bad, lambda v: F.concat(F.lit("Suspicious software: "), v)).alias("suspicious_fields"),
    )


def quality_metrics(expected: tuple[str, ...] = ("confidence", "processing_time", "technical_details"), columns: list[str] | None = None) -> Column:
    """Share of expected fields present, data quality and speed class."""
    present = [F.col(c).isNotNull().cast("int") for c in expected if columns is None or c in columns]
    time = _number("processing_time")
    return F.struct(
        (reduce(Column.__add__, present, F.lit(0)) / len(expected)).alias("completeness"),
        F.when(F.col("error").isNotNull(), "poor").when(_flag("has_warnings"), "fair").otherwise("good").alias("data_quality"),
        F.when(time > 30, "slow").when(time < 2, "fast").otherwise("normal").alias("efficiency"),
    )


def batch_table(results: DataFrame, key: str, order: str, name: Column, rows: int = 20, name_chars: int = 20) -> DataFrame:
    """The lines of every batch's printed table: its first results, names cut to fit, flags in words, confidence with two decimals.

    The first rows of a batch are found by partial aggregation: a task keeps no more than `rows` of any batch.
    """
    word = lambda c: F.when(_flag(c), "Yes").otherwise("No")
    line = F.struct(F.col(order).alias("_order"), F.substring(F.coalesce(name, F.lit("Unknown")), 1, name_chars).alias("file_name"),
                    F.when(F.col("error").isNull(), "completed").otherwise("error").alias("status"), word("is_fake").alias("fake"), word("is_duplicate").alias("duplicate"),
                    F.format_string("%.2f", _number("confidence").cast("double")).alias("confidence"))
    parts = results.select(F.col(key).alias("_key"), line.alias("line"), F.spark_partition_id().alias("_part"))
    for keys in (["_key", "_part"], ["_key"]):  # first within each partition, then over the partitions' few
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("line._order"))
        parts = parts.withColumn("_place", place).filter(F.col("_place") <= rows)
    return parts.select(F.col("_key").alias(key), F.col("_place").alias("line_no"), "line.file_name", "line.status", "line.fake", "line.duplicate", "line.confidence")


def forensic_indicators() -> Column:
    entry = lambda kind, severity: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(INDICATORS[kind]).alias("description"))
    return F.array_compact(F.array(
        F.when(_flag("is_fake"), entry("tampering", "high")),
        F.when(_flag("metadata_inconsistent"), entry("metadata_anomaly", "medium")),
        F.when(_number("compression_artifacts") > 0.8, entry("compression_anomaly", "medium")),
    ))


def compliance(columns: list[str]) -> Column:
    """Custody and standard are constants; documentation needs the file and technical parts, integrity no error."""
    documented = [F.col(c).isNotNull() for c in ("file_info", "technical_details") if c in columns]
    complete = reduce(Column.__and__, documented) if len(documented) == 2 else F.lit(False)
    return F.struct(
        F.lit(True).alias("chain_of_custody"), F.lit("ISO_27037_compliant").alias("analysis_standards"),
        F.col("error").isNull().alias("data_integrity"), complete.alias("documentation_complete"))


def confidence_category(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").when(confidence.isNotNull(), "low")


def technical_indicators() -> Column:
    """Compression metric, metadata integrity and the score of every model, absent parts NULL."""
    return F.struct(
        F.col("compression_artifacts").alias("compression_metrics"),
        metadata_integrity(F.col("metadata")).alias("metadata_integrity"),
        F.transform_values("model_predictions", lambda _, p: p["confidence"]).alias("model_scores"))


def card_status() -> Column:
    return F.when(_flag("is_fake"), "SUSPICIOUS").when(_flag("is_duplicate"), "DUPLICATE").otherwise("AUTHENTIC")


def chart_series() -> Column:
    """Gauge value and the parallel arrays of model names and scores."""
    scored = F.map_filter("model_predictions", lambda _, p: p["confidence"].isNotNull())
    return F.struct(F.col("confidence").alias("gauge"), F.map_keys(scored).alias("models"),
                    F.transform(F.map_values(scored), lambda p: p["confidence"]).alias("scores"))


def executive_summary(results: DataFrame) -> DataFrame:
    """Verdict, confidence, risk, findings, indicators and advice of every result."""
    scored = results.withColumn("confidence_score", overall_confidence())
    rated = scored.withColumn("risk_level", risk_level(F.col("confidence_score")))
    return rated.select(
        "item_id", verdict().alias("overall_verdict"), "confidence_score", "risk_level", key_findings().alias("key_findings"),
        technical_indicators().alias("technical_indicators"), recommendations(F.col("risk_level")).alias("recommendations"))


def detailed_report(results: DataFrame) -> DataFrame:
    """Executive summary with quality, forensic, compliance and chart parts, in one pass over the results."""
    scored = results.withColumn("_conf", overall_confidence())
    rated = scored.withColumn("_risk", risk_level(F.col("_conf")))
    return rated.select(
        "item_id",
        F.struct(verdict().alias("overall_verdict"), F.col("_conf").alias("confidence_score"), F.col("_risk").alias("risk_level"),
                 key_findings().alias("key_findings"), recommendations(F.col("_risk")).alias("recommendations")).alias("executive_summary"),
        quality_metrics(columns=results.columns).alias("quality_metrics"),
        forensic_indicators().alias("forensic_indicators"),
        compliance(results.columns).alias("compliance_check"),
        confidence_category(F.col("confidence")).alias("confidence_category"),
        chart_series().alias("visualization_data"))


def summary_line(results: DataFrame, fields: list[str]) -> DataFrame:
    """`field: value` of every field present, joined by vertical bars."""
    parts = [F.concat(F.lit(f"{f}: "), F.col(f).cast("string")) for f in fields]
    return results.select("item_id", F.concat_ws(" | ", *parts).alias("summary"))


def export_summary_row(results: DataFrame) -> DataFrame:
    """Field count, presence flags, status and main values of every exported result."""
    filled = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in results.columns])
    return results.select(
        "item_id", filled.alias("total_fields"), F.col("confidence").isNotNull().alias("has_confidence_score"),
        F.col("model_predictions").isNotNull().alias("has_model_predictions"),
        F.when(F.col("error").isNull(), "completed").otherwise("error").alias("processing_status"),
        F.col("confidence").alias("primary_confidence"), F.col("processing_time").alias("processing_time_seconds"),
        F.col("is_fake").alias("manipulation_detected"))


# Export keys that are metrics or results whatever else they contain.
_METRICS = ["processing_time", "model_accuracy", "quality_score"]
_RESULTS = ["is_fake", "is_duplicate", "deepfake_detected"]


def route_keys(payload: Column) -> Column:
    """Split a flat map into scores, metrics, results and details by key."""
    is_score = lambda k: F.lower(k).contains("confidence")
    known = lambda k: is_score(k) | k.isin(_METRICS) | k.isin(_RESULTS)
    return F.struct(
        F.map_filter(payload, lambda k, _: is_score(k)).alias("scores"),
        F.map_filter(payload, lambda k, _: ~is_score(k) & k.isin(_METRICS)).alias("metrics"),
        F.map_filter(payload, lambda k, _: ~is_score(k) & k.isin(_RESULTS)).alias("results"),
        F.map_filter(payload, lambda k, _: ~known(k)).alias("details"))


def flatten(df: DataFrame, list_length: int = 5, sep: str = "_") -> DataFrame:
    """Nested columns as flat ones, names joined by `sep`; arrays give one column per index up to `list_length`,
    and the rest of a longer array as one JSON column, so that nothing is lost. Maps become JSON."""
    def walk(column: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind for c in walk(column.getField(f.name), f.dataType, f"{name}{sep}{f.name}")]
        if isinstance(kind, T.ArrayType):
            items = [c for i in range(list_length) for c in walk(F.get(column, F.lit(i)), kind.elementType, f"{name}{sep}{i}")]
            rest = F.when(F.size(column) > list_length, F.to_json(F.slice(column, list_length + 1, F.greatest(F.size(column), F.lit(1)))))
            return items + [rest.alias(f"{name}{sep}rest")]
        if isinstance(kind, T.MapType):
            return [F.to_json(column).alias(name)]
        return [column.alias(name)]

    return df.select(*[c for f in df.schema for c in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])
