"""Weighted text verdicts from classifier, fact, evidence and entity signals, one row per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a fact verdict as false; the two-signal verdict knows three more.
FALSE_WORDS = ["false", "pants on fire", "mostly false", "fake", "incorrect", "misleading", "fabricated", "unproven", "no evidence"]
MORE_FALSE_WORDS = ["misinformation", "disinformation", "debunked"]
# Signal weights and decision limits.
TWO_SIGNAL_WEIGHTS = {"bert": 0.65, "xgb": 0.35}
TWO_SIGNAL_LIMIT = 0.38
FIVE_SIGNAL_WEIGHTS = {"bert": 0.20, "xgb": 0.10, "fact": 0.35, "web": 0.15, "entity": 0.20}
FIVE_SIGNAL_LIMIT = 0.5
_PLACEHOLDERS = ["GOOGLE_API_KEY not set", "No match found"]


def rated_false(verdict: Column, words: list[str] = FALSE_WORDS) -> Column:
    lowered = F.lower(verdict)
    return F.coalesce(reduce(Column.__or__, [lowered.contains(w) for w in words]), F.lit(False))


def fact_signal(facts: DataFrame, strict: bool) -> DataFrame:
    """Fact hits and false ratings per document.

    A hit has a source other than the system itself; the strict form also wants a verdict that is no placeholder.
    """
    hit = F.coalesce((F.col("source") != "System") & (F.col("source") != ""), F.lit(False))
    if strict:
        hit &= F.coalesce(~F.col("verdict").isin(_PLACEHOLDERS), F.lit(False))
    words = FALSE_WORDS + (MORE_FALSE_WORDS if strict else [])
    return facts.groupBy("doc_id").agg(
        F.count_if(hit).alias("fact_hits"), F.count_if(hit & rated_false(F.col("verdict"), words)).alias("fact_false"))


def web_signal(web: DataFrame) -> DataFrame:
    """Searched claims, found sources, corroborated claims and mean suspicion (no match 1, three or more 0)."""
    suspicion = (3 - F.least(F.col("match_count"), F.lit(3))) / 3.0
    return web.groupBy("doc_id").agg(
        F.count("*").alias("web_claims"), F.sum("match_count").alias("web_sources"),
        F.count_if(F.col("match_count") > 0).alias("web_corroborated"), F.avg(suspicion).alias("web_score"))


def entity_signal(entities: DataFrame) -> DataFrame:
    return entities.groupBy("doc_id").agg(
        F.count_if("checked").alias("entity_checked"), F.count_if(F.col("checked") & F.col("order_mismatch")).alias("entity_mismatches"))


def _fake_score(label: str, confidence: str) -> Column:
    """Suspicion of one model; NULL at confidence 0, which only an empty text gets, so that it carries no signal."""
    score = F.when(F.col(label) == "Misleading", F.col(confidence)).otherwise(1.0 - F.col(confidence))
    return F.when(F.col(confidence) > 0, score)


def _rate(name: str, label: str, value: str) -> Column:
    return F.concat(F.lit(name + ": "), F.col(label), F.format_string(" (%.0f%% confidence)", F.bround(F.col(value) * 100, 0)))


def _weighted(parts: list[tuple[float | Column, Column | tuple[Column, Column]]]) -> tuple[Column, Column]:
    """Sum of weight times score and sum of weights over the signals that are not NULL.

    A share (part, whole) is weighted before it is divided: the other order gives another last bit, which shows where the mean lies halfway between two rounded values.
    """
    weight = lambda w: F.lit(w) if isinstance(w, float) else w
    term = lambda w, s: F.try_divide(weight(w) * s[0], s[1]) if isinstance(s, tuple) else weight(w) * s
    weighted = [(w, term(w, s)) for w, s in parts]
    score = reduce(Column.__add__, [F.coalesce(t, F.lit(0.0)) for _, t in weighted])
    used = reduce(Column.__add__, [F.when(t.isNotNull(), weight(w)).otherwise(0.0) for w, t in weighted])
    return score, used


def _decide(df: DataFrame, score: Column, used: Column, misleading) -> DataFrame:
    scored = df.withColumn("raw_score", F.coalesce(F.try_divide(score, used), F.lit(0.5)))
    label = F.when(misleading(F.col("raw_score")), "Misleading").otherwise("Genuine")
    labelled = scored.withColumn("label", label)
    return labelled.withColumn("confidence", F.when(F.col("label") == "Misleading", F.col("raw_score")).otherwise(1.0 - F.col("raw_score")))


def two_signal_verdict(scores: DataFrame, facts: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """Classifier and baseline, pushed up by fact records that call a claim false. Web hits are only reported: without them nothing else changes."""
    w = TWO_SIGNAL_WEIGHTS
    rows = scores.join(fact_signal(facts, strict=True), "doc_id", "left").fillna(0, ["fact_hits", "fact_false"])
    rows = rows.withColumns({"web_claims": F.lit(0), "web_sources": F.lit(0)}) if web is None else rows.join(web_signal(web), "doc_id", "left")
    boost = F.when(F.col("fact_false") > 0, F.least(F.lit(0.30), F.col("fact_false") * 0.15))
    score, used = _weighted([(w["bert"], _fake_score("bert_label", "bert_conf")), (w["xgb"], _fake_score("xgb_label", "xgb_prob")),
                             (boost, F.lit(1.0))])
    decided = _decide(rows, score, used, lambda s: s >= TWO_SIGNAL_LIMIT)
    hits, false = F.col("fact_hits"), F.col("fact_false")
    fact_line = (
        F.when(false > 0, F.format_string("Fact-check databases: %d/%d claim(s) explicitly rated false by credible sources", false, hits))
        .when(hits > 0, F.format_string("Fact-check databases: %d record(s) found, none explicitly rated false", hits))
        .otherwise("Fact-check databases: no records found"))
    web_line = F.when(F.col("web_claims") > 0, F.format_string("Live web search: %d source(s) found, not used in scoring", F.col("web_sources"))
                      ).otherwise("Live web search: no results retrieved")
    return decided.withColumn("reasoning", F.array_compact(F.array(
        _rate("BERT classifier", "bert_label", "bert_conf"), _rate("Baseline (XGBoost)", "xgb_label", "xgb_prob"), fact_line, web_line)))


def five_signal_verdict(scores: DataFrame, facts: DataFrame, web: DataFrame, entities: DataFrame) -> DataFrame:
    """Weighted mean of the signals present; a signal without data leaves both sums."""
    w = FIVE_SIGNAL_WEIGHTS
    rows = scores
    for signal in (fact_signal(facts, strict=False), web_signal(web), entity_signal(entities)):
        rows = rows.join(signal, "doc_id", "left")
    rows = rows.fillna(0, ["fact_hits", "fact_false", "web_claims", "entity_checked", "entity_mismatches"])
    share = lambda part, whole: (F.col(part).cast("double"), F.col(whole).cast("double"))
    score, used = _weighted([
        (w["bert"], _fake_score("bert_label", "bert_conf")), (w["xgb"], _fake_score("xgb_label", "xgb_prob")),
        (w["fact"], share("fact_false", "fact_hits")), (w["web"], F.col("web_score")), (w["entity"], share("entity_mismatches", "entity_checked"))])
    # nine digits: a tie is no more than one for the last bit of its sums
    decided = _decide(rows, score, used, lambda s: F.round(s, 9) > FIVE_SIGNAL_LIMIT)
    count = lambda c: F.col(c)
    fact_line = F.when(count("fact_hits") > 0, F.format_string(
        "Fact-check databases: %d/%d matched claim(s) rated false", count("fact_false"), count("fact_hits"))
    ).otherwise("Fact-check databases: no matching records found for any claim")
    web_line = F.when(count("web_claims") > 0, F.format_string(
        "Live web search: %d/%d claim(s) have current online corroboration (strength-weighted by match count)",
        count("web_corroborated"), count("web_claims"))).otherwise("Live web search: no claims were searched")
    entity_line = (
        F.when(count("entity_mismatches") > 0, F.format_string(
            "Entity-order check: %d/%d comparable claim(s) name entities in another order than the evidence", count("entity_mismatches"), count("entity_checked")))
        .when(count("entity_checked") > 0, F.format_string("Entity-order check: %d claim(s) compared, no swapped-entity contradictions detected", count("entity_checked")))
        .otherwise("Entity-order check: not enough named entities to evaluate"))
    return decided.withColumn("reasoning", F.array_compact(F.array(
        _rate("BERT classifier", "bert_label", "bert_conf"), _rate("Baseline (XGBoost)", "xgb_label", "xgb_prob"), fact_line, web_line, entity_line)))
