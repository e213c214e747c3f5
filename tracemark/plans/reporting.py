"""Report queries over the result envelope."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemark.operators import metadata, reporting
from tracemark.plans.registry import query

_CONF = """(coalesce(confidence, 0) + coalesce(detection_confidence, 0))
           / (CAST(confidence IS NOT NULL AS INT) + CAST(detection_confidence IS NOT NULL AS INT))"""
_VERDICT = """CASE WHEN is_fake OR is_synthetic THEN 'SYNTHETIC/MANIPULATED CONTENT DETECTED' WHEN is_duplicate THEN 'DUPLICATE CONTENT DETECTED'
    WHEN suspicious_indicators > 0 THEN 'SUSPICIOUS CONTENT - REQUIRES REVIEW' ELSE 'AUTHENTIC CONTENT - NO MANIPULATION DETECTED' END"""
_RISK = """CASE WHEN is_fake AND {c} > 0.8 THEN 'HIGH' WHEN is_fake AND {c} > 0.6 THEN 'MEDIUM' WHEN suspicious_indicators > 0 THEN 'LOW' ELSE 'MINIMAL' END"""
_FINDINGS = """concat_ws('; ', CASE WHEN is_fake THEN 'AI-generated content detected with ' || printf('%.1f%%', round(confidence * 100, 1)) || ' confidence' END,
    CASE WHEN deepfake_detected THEN 'Deepfake indicators found in facial analysis' END,
    CASE WHEN is_duplicate THEN 'Content matches ' || duplicate_count || ' existing files' END,
    CASE WHEN compression_artifacts > 0.7 THEN 'High compression artifacts detected' END,
    CASE WHEN metadata_inconsistent THEN 'Metadata inconsistencies found' END,
    CASE WHEN xc_anom > 0.5 THEN 'xception model detected anomalies' END, CASE WHEN me_anom > 0.5 THEN 'meso model detected anomalies' END)"""


def _advice_sql(levels):
    whens = " ".join(f"WHEN '{r}' THEN '{'; '.join(reporting.ADVICE[r])}'" for r in levels)
    return f"CASE risk {whens} ELSE '{'; '.join(reporting.ADVICE['MINIMAL'])}' END"


_RATED = f"rated AS (SELECT *, {_CONF} AS conf, {_RISK.format(c=_CONF)} AS risk FROM result_envelope)"


@query("C01_verdict", f"SELECT item_id, {_VERDICT} AS verdict FROM result_envelope", ("result_envelope",))
def verdict(t):
    return t.result_envelope.select("item_id", reporting.verdict().alias("verdict"))


@query("C02_overall_confidence", f"""
    SELECT item_id, round({_CONF}, 6) AS confidence_score,
           round((coalesce(confidence, 0) + coalesce(detection_confidence, 0) + xc_conf + me_conf) /
                 (2 + CAST(confidence IS NOT NULL AS INT) + CAST(detection_confidence IS NOT NULL AS INT)), 6) AS with_models
    FROM result_envelope""", ("result_envelope",))
def overall_confidence(t):
    return t.result_envelope.select("item_id", F.round(reporting.overall_confidence(), 6).alias("confidence_score"),
                                    F.round(reporting.overall_confidence(with_models=True), 6).alias("with_models"))


@query("C03_risk_level", f"""
    SELECT item_id, {_RISK.format(c=_CONF)} AS risk_level, {_RISK.format(c='confidence')} AS risk_level_raw FROM result_envelope""", ("result_envelope",))
def risk_level(t):
    return t.result_envelope.select("item_id", reporting.risk_level(reporting.overall_confidence()).alias("risk_level"),
                                    reporting.risk_level(F.col("confidence")).alias("risk_level_raw"))


@query("C04_key_findings", f"""
    SELECT item_id, CASE WHEN f = '' THEN 'No significant anomalies detected' ELSE f END AS findings
    FROM (SELECT item_id, {_FINDINGS} AS f FROM result_envelope)""", ("result_envelope",))
def key_findings(t):
    return t.result_envelope.select("item_id", F.array_join(reporting.key_findings(), "; ").alias("findings"))


@query("C05_recommendations", f"""
    {_RATED}
    SELECT item_id, concat_ws('; ', {_advice_sql(['HIGH', 'MEDIUM', 'LOW'])},
        CASE WHEN low_resolution THEN 'Consider higher resolution analysis for improved accuracy' END,
        CASE WHEN processing_time > 30 THEN 'Long processing time detected - consider optimization' END) AS advice,
        {_advice_sql(['HIGH', 'MEDIUM'])} AS short_advice FROM rated""", ("result_envelope",))
def recommendations(t):
    risk = reporting.risk_level(reporting.overall_confidence())
    rated = t.result_envelope.withColumn("risk", risk)
    return rated.select("item_id", F.array_join(reporting.recommendations(F.col("risk")), "; ").alias("advice"),
                        F.array_join(reporting.recommendations(F.col("risk"), short=True), "; ").alias("short_advice"))


@query("C06_metadata_integrity", """
    SELECT item_id, (m_datetime IS NOT NULL OR m_make IS NOT NULL OR m_model IS NOT NULL OR m_software IS NOT NULL
                     OR m_gps IS NOT NULL OR m_iso IS NOT NULL OR m_fnumber IS NOT NULL) AS present,
           CAST(m_datetime IS NOT NULL AS INT) + CAST(m_software IS NOT NULL AS INT) + CAST(m_gps IS NOT NULL AS INT) >= 2 AS complete,
           coalesce(NOT contains(lower(m_software), 'gimp'), true) AS consistent,
           CASE WHEN contains(lower(m_software), 'gimp') THEN 'Suspicious software: ' || m_software ELSE '' END AS suspicious
    FROM result_envelope""", ("result_envelope",))
def metadata_integrity(t):
    rows = t.result_envelope.select("item_id", reporting.metadata_integrity(F.col("metadata")).alias("m"))
    return rows.select("item_id", "m.present", "m.complete", "m.consistent", F.array_join("m.suspicious_fields", ",").alias("suspicious"))


@query("C07_quality_metrics", """
    SELECT item_id, round((CAST(confidence IS NOT NULL AS INT) + CAST(processing_time IS NOT NULL AS INT)) / 3.0::DOUBLE, 6) AS completeness,
           CASE WHEN error IS NOT NULL THEN 'poor' WHEN has_warnings THEN 'fair' ELSE 'good' END AS data_quality,
           CASE WHEN processing_time > 30 THEN 'slow' WHEN processing_time < 2 THEN 'fast' ELSE 'normal' END AS efficiency
    FROM result_envelope""", ("result_envelope",))
def quality_metrics(t):
    rows = t.result_envelope.select("item_id", reporting.quality_metrics(columns=t.result_envelope.columns).alias("q"))
    return rows.select("item_id", F.round("q.completeness", 6).alias("completeness"), "q.data_quality", "q.efficiency")


@query("C08_forensic_indicators", """
    SELECT item_id, concat_ws(',', CASE WHEN is_fake THEN 'tampering:high' END, CASE WHEN metadata_inconsistent THEN 'metadata_anomaly:medium' END,
           CASE WHEN compression_artifacts > 0.8 THEN 'compression_anomaly:medium' END) AS indicators FROM result_envelope""", ("result_envelope",))
def forensic_indicators(t):
    names = F.transform(reporting.forensic_indicators(), lambda i: F.concat(i["type"], F.lit(":"), i["severity"]))
    return t.result_envelope.select("item_id", F.array_join(names, ",").alias("indicators"))


@query("C09_compliance", """
    SELECT item_id, true AS chain_of_custody, 'ISO_27037_compliant' AS analysis_standards, error IS NULL AS data_integrity,
           false AS documentation_complete FROM result_envelope""", ("result_envelope",))
def compliance(t):
    rows = t.result_envelope.select("item_id", reporting.compliance(t.result_envelope.columns).alias("c"))
    return rows.select("item_id", "c.*")


@query("C10_C13_category_and_card", """
    SELECT item_id, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.5 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' END AS category,
           CASE WHEN is_fake THEN 'SUSPICIOUS' WHEN is_duplicate THEN 'DUPLICATE' ELSE 'AUTHENTIC' END AS card FROM result_envelope""", ("result_envelope",))
def category_and_card(t):
    return t.result_envelope.select("item_id", reporting.confidence_category(F.col("confidence")).alias("category"), reporting.card_status().alias("card"))


@query("C11_technical_indicators", """
    SELECT item_id, compression_artifacts AS compression, coalesce(NOT contains(lower(m_software), 'gimp'), true) AS consistent,
           round(xc_conf, 6) AS xception, round(me_conf, 6) AS meso FROM result_envelope""", ("result_envelope",))
def technical_indicators(t):
    rows = t.result_envelope.select("item_id", reporting.technical_indicators().alias("i"))
    return rows.select("item_id", F.col("i.compression_metrics").alias("compression"), "i.metadata_integrity.consistent",
                       F.round(F.col("i.model_scores")["xception"], 6).alias("xception"), F.round(F.col("i.model_scores")["meso"], 6).alias("meso"))


@query("C12_executive_summary", f"""
    {_RATED}
    SELECT item_id, {_VERDICT} AS overall_verdict, round(conf, 6) AS confidence_score, risk AS risk_level,
           len(string_split({_advice_sql(['HIGH', 'MEDIUM', 'LOW'])}, '; ')) + CAST(low_resolution AS INT) + CAST(processing_time > 30 AS INT) AS n_advice
    FROM rated""", ("result_envelope",))
def executive_summary(t):
    return reporting.executive_summary(t.result_envelope).select(
        "item_id", "overall_verdict", F.round("confidence_score", 6).alias("confidence_score"), "risk_level", F.size("recommendations").alias("n_advice"))


@query("C12_detailed_report")
def detailed_report(t):
    return reporting.detailed_report(t.result_envelope).select("item_id", F.to_json(F.struct("*")).alias("report"))


@query("C12_summary_line", """
    SELECT item_id, concat_ws(' | ', 'detection_mode: ' || detection_mode, 'is_fake: ' || is_fake, 'duplicate_count: ' || duplicate_count,
                              'error: ' || error) AS summary FROM result_envelope""", ("result_envelope",))
def summary_line(t):
    return reporting.summary_line(t.result_envelope, ["detection_mode", "is_fake", "duplicate_count", "error"])


@query("C14_export_summary_rows", """
    SELECT item_id, 18 + CAST(detection_confidence IS NOT NULL AS INT) + CAST(error IS NOT NULL AS INT) AS total_fields,
           true AS has_confidence_score, true AS has_model_predictions,
           CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS processing_status, confidence AS primary_confidence,
           processing_time AS processing_time_seconds, is_fake AS manipulation_detected FROM result_envelope""", ("result_envelope",))
def export_summary_rows(t):
    return reporting.export_summary_row(t.result_envelope)


@query("C15_chart_series", """
    SELECT item_id, confidence AS gauge, 'xception,meso' AS models, round(xc_conf + me_conf, 6) AS score_sum FROM result_envelope""", ("result_envelope",))
def chart_series(t):
    rows = t.result_envelope.select("item_id", reporting.chart_series().alias("c"))
    return rows.select("item_id", "c.gauge", F.array_join("c.models", ",").alias("models"),
                       F.round(F.aggregate("c.scores", F.lit(0.0), lambda a, v: a + v), 6).alias("score_sum"))


@query("F13_route_keys", """
    SELECT event_id, 'detection_confidence' AS scores, 'processing_time' AS metrics, 'is_fake' AS results, 'k,user' AS details FROM events""")
def route_keys(t):
    payload = F.create_map(*[x for k, v in (("detection_confidence", F.col("value")), ("processing_time", F.col("value") / 10), ("is_fake", F.col("k")),
                                            ("k", F.col("k")), ("user", F.col("user_id"))) for x in (F.lit(k), v.cast("string"))])
    rows = t.events.select("event_id", reporting.route_keys(payload).alias("r"))
    return rows.select("event_id", *[F.array_join(F.array_sort(F.map_keys(f"r.{c}")), ",").alias(c) for c in ("scores", "metrics", "results", "details")])


@query("F14_flatten", """
    SELECT event_id, user_id AS info_user, event_type AS info_type, value AS scores_0, CAST(k AS DOUBLE) AS scores_1, CAST(NULL AS VARCHAR) AS scores_rest FROM ev""", ("ev",))
def flatten(t):
    nested = t.events.select("event_id", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")).alias("info"),
                             F.array("value", F.col("k").cast("double")).alias("scores"))
    return reporting.flatten(nested, list_length=2)


# ---- media metadata ------------------------------------------------------------------------------

_ANY = "(m_datetime IS NOT NULL OR m_make IS NOT NULL OR m_model IS NOT NULL OR m_software IS NOT NULL OR m_gps IS NOT NULL OR m_iso IS NOT NULL OR m_fnumber IS NOT NULL)"
_AUTH = f"""auth AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.2::DOUBLE * CAST({_ANY} AS INT) + 0.2::DOUBLE * CAST(m_make IS NOT NULL OR m_model IS NOT NULL AS INT)
    + 0.15::DOUBLE * CAST(m_datetime IS NOT NULL AS INT) + 0.2::DOUBLE * CAST(m_iso IS NOT NULL OR m_fnumber IS NOT NULL AS INT)
    + 0.15::DOUBLE * CAST(coalesce(contains(lower(m_make), 'nikon'), false) AS INT)
    + 0.1::DOUBLE * CAST(CAST(m_datetime IS NOT NULL AS INT) + CAST(m_make IS NOT NULL AS INT) + CAST(m_model IS NOT NULL AS INT)
        + CAST(m_software IS NOT NULL AS INT) + CAST(m_iso IS NOT NULL AS INT) + CAST(m_fnumber IS NOT NULL AS INT) >= 5 AS INT)
    - 0.5::DOUBLE * CAST(coalesce(contains(lower(m_software), 'midjourney'), false) AS INT))) AS authenticity FROM result_envelope)"""


@query("I14_metadata_authenticity", f"""
    {_AUTH}
    SELECT item_id, {_ANY} AS has_metadata, round(authenticity, 6) AS authenticity_score,
           CASE WHEN contains(lower(m_software), 'midjourney') THEN 'Software: Midjourney' ELSE '' END AS ai_indicators FROM auth""", ("result_envelope",))
def metadata_authenticity(t):
    rows = t.result_envelope.select("item_id", metadata.authenticity(F.col("metadata")).alias("a"))
    return rows.select("item_id", "a.has_metadata", F.round("a.authenticity_score", 6).alias("authenticity_score"),
                       F.array_join("a.ai_indicators", ",").alias("ai_indicators"))


_SCORE = "0.35::DOUBLE * confidence + 0.2::DOUBLE * xc_conf + 0.2::DOUBLE * me_conf + 0.15::DOUBLE * (1 - authenticity)"
_SCORED = f"{_AUTH}, scored AS (SELECT *, {_SCORE} AS score FROM auth)"


def _scored(t):
    models = F.col("model_predictions")
    rows = t.result_envelope.withColumn("meta", metadata.authenticity(F.col("metadata"))).withColumns(
        {"spectral": models["xception"]["confidence"], "patch": models["meso"]["confidence"]})
    return rows.withColumn("score", metadata.image_score(F.col("confidence"), F.col("spectral"), F.col("patch"), F.col("meta.authenticity_score")))


@query("I15_image_score", f"{_SCORED} SELECT item_id, round(score, 6) AS score, score > 0.5 AS is_ai_generated FROM scored", ("result_envelope",))
def image_score(t):
    return _scored(t).select("item_id", F.round("score", 6).alias("score"), (F.col("score") > 0.5).alias("is_ai_generated"))


@query("I16_explanation", f"""
    {_SCORED}
    SELECT item_id, concat_ws(' ', CASE WHEN score > 0.8 THEN 'High confidence that this image is AI-generated.'
            WHEN score > 0.6 THEN 'Moderate confidence that this image is AI-generated.'
            WHEN score > 0.4 THEN 'Some indicators suggest possible AI generation.' ELSE 'Low likelihood of AI generation - appears authentic.' END,
        CASE WHEN xc_conf > 0.6 THEN 'StyleGAN artifacts detected (confidence: ' || printf('%.1f%%', round(xc_conf * 100, 1)) || ').' END,
        CASE WHEN me_conf > 0.6 THEN 'DALL-E-style patterns detected (confidence: ' || printf('%.1f%%', round(me_conf * 100, 1)) || ').' END,
        CASE WHEN authenticity > 0.7 THEN 'Rich metadata suggests authentic camera capture (authenticity: ' || printf('%.1f%%', round(authenticity * 100, 1)) || ').'
             WHEN authenticity > 0.4 THEN 'Some authentic metadata present (authenticity: ' || printf('%.1f%%', round(authenticity * 100, 1)) || ').'
             WHEN NOT {_ANY} THEN 'No metadata found - suspicious for modern digital images.'
             WHEN contains(lower(m_software), 'midjourney') THEN 'AI generation indicators found in metadata: Software: Midjourney.' END) AS explanation
    FROM scored""", ("result_envelope",))
def explanation(t):
    return _scored(t).select("item_id", metadata.explanation(F.col("score"), F.col("spectral"), F.col("patch"), F.col("meta")).alias("explanation"))


@query("F18_exif_categories", """
    SELECT item_id, CAST(m_gps IS NOT NULL AS INT) AS gps,
           CAST(m_datetime IS NOT NULL AS INT) + CAST(m_make IS NOT NULL AS INT) + CAST(m_model IS NOT NULL AS INT) + CAST(m_software IS NOT NULL AS INT)
           + CAST(m_iso IS NOT NULL AS INT) + CAST(m_fnumber IS NOT NULL AS INT) AS other FROM result_envelope""", ("result_envelope",))
def exif_categories(t):
    rows = t.result_envelope.select("item_id", metadata.tag_categories(F.col("metadata")).alias("c"))
    return rows.select("item_id", F.size("c.gps").alias("gps"), F.size("c.other").alias("other"))


@query("L06_batch_table", """
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY item_id) AS line_no FROM result_envelope)
    SELECT job_id, line_no, substr('evidence ' || detection_mode || ' file ' || item_id, 1, 20) AS file_name, CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS status,
           CASE WHEN is_fake THEN 'Yes' ELSE 'No' END AS fake, CASE WHEN is_duplicate THEN 'Yes' ELSE 'No' END AS duplicate, printf('%.2f', confidence) AS confidence FROM r WHERE line_no <= 20""",
       ("result_envelope",))
def batch_table(t):
    name = F.concat(F.lit("evidence "), "detection_mode", F.lit(" file "), "item_id")
    return reporting.batch_table(t.result_envelope, "job_id", "item_id", name)
