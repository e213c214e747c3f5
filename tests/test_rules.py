import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemark.functions import text as tx
from tracemark.operators import claims as cl
from tracemark.operators import models, reporting, stats
from tracemark.operators import verdict as vd
from tracemark.plans.text import _six


def one(df):
    return df.collect()[0]


def verdict_inputs(spark, facts, matches, entities=(), bert=("Misleading", 0.8), xgb=("Genuine", 0.6)):
    scores = spark.createDataFrame([(1, *bert, *xgb)], "doc_id long, bert_label string, bert_conf double, xgb_label string, xgb_prob double")
    f = spark.createDataFrame([(1, *x) for x in facts], "doc_id long, source string, verdict string")
    w = spark.createDataFrame([(1, m) for m in matches], "doc_id long, match_count long")
    e = spark.createDataFrame([(1, *x) for x in entities], "doc_id long, checked boolean, order_mismatch boolean")
    return scores, f, w, e


def test_two_signal_verdict(spark):
    scores, f, w, _ = verdict_inputs(spark, [("Desk", "Mostly False"), ("System", "False"), (None, "No match found")], [2, 0])
    r = one(vd.two_signal_verdict(scores, f, w))
    expected = (0.65 * 0.8 + 0.35 * 0.4 + 0.15) / 1.15
    assert math.isclose(r.raw_score, expected) and r.label == "Misleading" and math.isclose(r.confidence, expected)
    assert r.reasoning[0] == "BERT classifier: Misleading (80% confidence)" and "1/1" in r.reasoning[2]


def test_two_signal_verdict_without_baseline(spark):
    scores, f, w, _ = verdict_inputs(spark, [], [], xgb=(None, None), bert=("Genuine", 0.9))
    r = one(vd.two_signal_verdict(scores, f, w))
    assert math.isclose(r.raw_score, 0.1) and r.label == "Genuine" and math.isclose(r.confidence, 0.9) and len(r.reasoning) == 3


def test_empty_text_carries_no_signal(spark):
    scores, f, w, e = verdict_inputs(spark, [], [1], bert=("Genuine", 0.0), xgb=("Genuine", 0.0))
    assert one(vd.two_signal_verdict(scores, f, w)).raw_score == 0.5
    assert math.isclose(one(vd.five_signal_verdict(scores, f, w, e)).raw_score, 2 / 3)


def test_two_signal_boost_is_capped(spark):
    scores, f, w, _ = verdict_inputs(spark, [("A", "fake"), ("B", "debunked"), ("C", "false")], [], bert=("Genuine", 0.9), xgb=("Genuine", 0.9))
    assert math.isclose(one(vd.two_signal_verdict(scores, f, w)).raw_score, (0.1 + 0.3) / 1.3)


def test_five_signal_verdict(spark):
    scores, f, w, e = verdict_inputs(spark, [("Desk", "False"), ("Wire", "True"), ("System", "False")], [0, 1, 5], [(True, True), (True, False), (False, False)])
    r = one(vd.five_signal_verdict(scores, f, w, e))
    web = (1 + 2 / 3 + 0) / 3
    expected = 0.20 * 0.8 + 0.10 * 0.4 + 0.35 * 0.5 + 0.15 * web + 0.20 * 0.5
    assert math.isclose(r.raw_score, expected) and r.label == ("Misleading" if expected > 0.5 else "Genuine")


def test_absent_signals_leave_both_sums(spark):
    scores, f, w, e = verdict_inputs(spark, [(None, "No match found")], [], [(False, False)])
    r = one(vd.five_signal_verdict(scores, f, w, e))
    assert math.isclose(r.raw_score, (0.2 * 0.8 + 0.1 * 0.4) / 0.3)
    assert r.reasoning[-1] == "Entity-order check: not enough named entities to evaluate"


def test_halfway_mean_is_rounded_as_its_sql_does(spark):
    """Three of three facts rated false, one claim without a match: 0.35 * 3 / 3 is not 0.35 * (3 / 3) in its last bit."""
    facts = [("A", "false"), ("B", "false"), ("C", "false")]
    scores, f, w, e = verdict_inputs(spark, facts, [0], bert=("Genuine", 0.5), xgb=("Genuine", 0.5125))
    r = vd.five_signal_verdict(scores, f, w, e).select(F.round("raw_score", 6).alias("r"), "raw_score").first()
    assert r.raw_score == (0.2 * (1.0 - 0.5) + 0.1 * (1.0 - 0.5125) + 0.35 * 3 / 3 + 0.15 * 1.0) / (0.2 + 0.1 + 0.35 + 0.15) and r.r == 0.810937
    halfway = spark.createDataFrame([(0.5203125,), (0.8109375,)], "v double").select(_six("v"))
    assert [x.v for x in halfway.collect()] == [0.520312, 0.810938]


def test_two_signal_verdict_searches_nothing(spark, tables, monkeypatch):
    from tracemark.plans import text as plans

    scores, f, w, _ = verdict_inputs(spark, [("A", "fake")], [0, 2])
    with_web, without = one(vd.two_signal_verdict(scores, f, w)), one(vd.two_signal_verdict(scores, f))
    assert (with_web.raw_score, with_web.label, with_web.confidence) == (without.raw_score, without.label, without.confidence)
    monkeypatch.setattr(cl, "search_evidence", lambda *_: pytest.fail("evidence was searched"))
    assert plans.verdict_two(type(tables)(spark, tables.folder)).count() == tables.read("documents").count()


@pytest.mark.parametrize("claim,snippets,checked,mismatch", [
    (["A"], [["A", "B"]], False, False),
    (["A", "B"], [["B", "A"]], True, True),
    (["A", "B"], [["A", "C"], ["A", "X", "B"]], True, False),
    (["A", "B"], [["C"]], False, False),
    (["A", "B", "C"], [["C", "A"]], True, True),
    (["A", "B"], [], False, False),
])
def test_entity_order(spark, claim, snippets, checked, mismatch):
    claims = spark.createDataFrame([(1, claim)], "k long, entities array<string>")
    rows = spark.createDataFrame([(1, s) for s in snippets], "k long, snippet_entities array<string>")
    r = one(cl.check_entity_order(claims, rows, ["k"]))
    assert (r.checked, r.order_mismatch) == (checked, mismatch)


def test_entity_sequences(spark):
    rows = spark.createDataFrame([(1, "Red Star beat Team Alpha in Paris."), (2, "nothing here")], "k long, t string")
    names = spark.createDataFrame([("Red Star",), ("Paris",), ("Team Alpha",)], "name string")
    got = {r.k: r.entities for r in cl.entity_sequences(rows, ["k"], "t", names).collect()}
    assert got == {1: ["Red Star", "Team Alpha", "Paris"], 2: []}


def rank_by_hand(text, k=3):
    import re
    sents = [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]*", text) if len(s.split()) > 4]
    if not sents:
        return [text[:500]]
    if len(sents) <= k:
        return sents
    toks = [[w for w in re.findall(r"\w{2,}", s.lower()) if w not in tx.STOP_WORDS] for s in sents]
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    score = []
    for t in toks:
        v = [t.count(w) * (math.log((1 + len(sents)) / (1 + df[w])) + 1) for w in sorted(set(t))]
        score.append(round(sum(v) / math.sqrt(sum(x * x for x in v)), 9) if v else 0.0)
    order = sorted(range(len(sents)), key=lambda i: (-score[i], i))[:k]
    return [sents[i] for i in order]


def test_claim_ranking(spark, tables):
    docs = [(r.doc_id, r.text) for r in tables.read("documents").select("doc_id", "text").collect()]
    docs += [(10**6, "Short. Words only here."), (10**6 + 1, "  \n "), (10**6 + 2, "the of and to in. " * 5)]
    got = {}
    for r in cl.rank_claims(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "claim_no").collect():
        got.setdefault(r.doc_id, []).append(r.claim)
    assert got == {i: rank_by_hand(t) for i, t in docs if t.strip()}


def test_evidence_search_equals_brute_force(spark):
    common = "on the way to the old town"
    claims = [(i, 0, f"{common} we met number{i % 7} and number{i % 5} again") for i in range(12)]
    corpus = [(2, i, f"{common} we met number{i % 7} today") for i in range(12)] + [(1, 50 + i, f"and number{i} again it was") for i in range(3)]
    corpus += [(2, 100 + i, "completely different words in this one") for i in range(3)]
    c = spark.createDataFrame(claims, "doc_id long, claim_no int, claim string")
    d = spark.createDataFrame(corpus, "tier int, item_id long, body string")
    grams = lambda t: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)}
    df = {}
    for tier, _, body in corpus:
        for g in grams(body):
            df[(tier, g)] = df.get((tier, g), 0) + 1
    expected = set()
    for doc, no, claim in claims:
        hits = [(tier, min(df[(tier, g)] for g in grams(body) & grams(claim)), item) for tier, item, body in corpus
                if grams(body) & grams(claim) and not (tier == 2 and item == doc)]
        hits = sorted(h for h in hits if h[0] == min(x[0] for x in hits))[:4]
        expected |= {(doc, no, tier, item, n, i + 1) for i, (tier, n, item) in enumerate(hits)}
    got = {tuple(r) for r in cl.search_evidence(c, d, k=4).collect()}
    assert got == expected


def test_claims_are_ranked_without_a_shuffle_and_evidence_shuffles_each_side_once_by_phrase(spark, tables):
    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]

    claims = cl.rank_claims(tables.read("documents").select("doc_id", "text"))
    assert not exchanges(claims)
    searched = exchanges(cl.search_evidence(claims, tables.corpus))
    # wanted phrases, phrases of the corpus, phrases of the claims; then hits by claim and item, and by claim
    assert len([line for line in searched if "phrase" in line]) == 3 and len(searched) == 5


def test_ranking_of_few_and_no_sentences_and_other_stop_words(spark):
    docs = [(1, "One two three four five. Six seven eight nine ten."), (2, "no sentence here"), (3, None), (4, "a b c d e. " * 3 + "zz yy xx ww vv.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in cl.rank_claims(frame).collect())
    assert got == [(1, 0, "One two three four five."), (1, 1, "Six seven eight nine ten."), (2, 0, "no sentence here"),
                   (4, 0, "zz yy xx ww vv."), (4, 1, "a b c d e."), (4, 2, "a b c d e.")]
    assert cl.rank_claims(frame, k=1, stop_words=["zz", "yy", "xx", "ww", "vv"]).filter("doc_id = 4").first().claim == "a b c d e."


def test_ingest(spark):
    rows = [(1, "text", "  hello  "), (2, "youtube", "https://youtu.be/abcdefghijk"), (3, "youtube", "nope"), (4, "youtube", "zzzzzzzzzzz"), (5, "url", " u "), (6, "fax", "x")]
    asked = spark.createDataFrame(rows, "request_id long, source_type string, content string")
    texts = spark.createDataFrame([("abcdefghijk", "said it")], "video_id string, text string")
    got = {r.request_id: (r.text, r.error) for r in cl.ingest(asked, texts, allow_url=False).collect()}
    assert got[1] == ("hello", None) and got[2] == ("said it", None)
    assert got[3][1] == "Could not extract a video id" and got[4][1] == "No transcript for this video"
    assert got[5][1] == got[6][1] == "Unsupported source type"


def test_baseline_rule(spark):
    df = spark.createDataFrame([(0.9, "x"), (0.2, "x"), (0.52, "x"), (0.9, "  ")], "p double, t string")
    band = [tuple(r.r) for r in df.select(models.baseline_rule(F.col("p"), F.col("t"), True).alias("r")).collect()]
    assert band == [("Misleading", 0.9), ("Genuine", 0.8), ("Genuine", 0.5), ("Genuine", 0.0)]
    plain = one(df.filter("p = 0.52").select(models.baseline_rule(F.col("p"), F.col("t")).alias("r"))).r
    assert tuple(plain) == ("Misleading", 0.52)


def test_exact_median_in_a_crowded_group(spark):
    rng = np.random.default_rng(4)
    rows = [(0, float(v)) for v in rng.exponential(5, 5001)] + [(1, 2.0)] * 500 + [(2, 1.0), (2, 4.0)] + [(3, None)]
    got = {r.g: r.m for r in stats.exact_median(spark.createDataFrame(rows, "g long, v double"), "g", "v", "m", accuracy=100).collect()}
    assert got == {0: float(np.median([v for g, v in rows if g == 0])), 1: 2.0, 2: 2.5}


def test_batch_statistics_of_ten(spark):
    rows = [(1, i, 0.5 + 0.05 * i, i % 3 == 0, False, 1 + 0.2 * i, None) for i in range(10)] + [(1, 99, None, None, None, None, "ValueError")]
    df = spark.createDataFrame(rows, "job_id long, item_id long, confidence double, is_fake boolean, is_duplicate boolean, processing_time double, error string")
    r = one(stats.batch_statistics(df))
    assert (r.total_processed, r.successful, r.failed, r.fake_detected, r.authentic) == (11, 10, 1, 4, 6)
    values = [0.5 + 0.05 * i for i in range(10)]
    assert math.isclose(r.mean_confidence, np.mean(values)) and math.isclose(r.std_confidence, np.std(values)) and math.isclose(r.median_confidence, np.median(values))


def test_flatten_loses_nothing(spark):
    df = spark.createDataFrame([(1, (2, ["a", "b", "c"]), {"k": 1})], "id long, s struct<x:int,l:array<string>>, m map<string,int>")
    r = one(reporting.flatten(df, list_length=2)).asDict()
    assert r == {"id": 1, "s_x": 2, "s_l_0": "a", "s_l_1": "b", "s_l_rest": '["c"]', "m": '{"k":1}'}


def test_softmax_and_evaluation(spark):
    df = spark.createDataFrame([(0.0, 2.0, "t"), (2.0, 0.0, "t"), (0.0, 9.0, " ")], "g double, f double, t string")
    got = [(r.label, round(r.confidence, 4)) for r in models.softmax_label(df, F.col("g"), F.col("f"), F.col("t")).collect()]
    assert got == [("Misleading", 0.8808), ("Genuine", 0.8808), ("Genuine", 0.0)]
    pairs = spark.createDataFrame([("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2, "y string, p string")
    e = {r["class"]: r for r in models.evaluate(pairs, "y", "p").collect()}
    assert math.isclose(e["a"].recall, 0.75) and e["a"].precision == 1.0 and math.isclose(e["b"].precision, 2 / 3) and math.isclose(e["b"].accuracy, 5 / 6)


def test_running_totals_of_a_group_with_half_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v), int(c)) for g, v, c in zip(rng.choice([0, 0, 0, 1, 2], 900), rng.permutation(900) / 7, rng.integers(0, 9, 900))]
    from tracemark.operators.ranking import running_totals

    got = {(r.g, r.v): r.upto for r in running_totals(spark.createDataFrame(rows, "g long, v double, c long"), ["g"], ["v"], "c", "upto").collect()}
    assert got == {(g, v): sum(c2 for g2, v2, c2 in rows if g2 == g and v2 <= v) for g, v, _ in rows}


def test_trained_baseline_separates(spark):
    rows = [(i, f"shock secret miracle cure number {i}", 1) for i in range(40)] + [(100 + i, f"council approves budget report {i}", 0) for i in range(40)]
    data = spark.createDataFrame(rows, "id long, text string, label int")
    split = models.stratified_split(data, "id", "label")
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {(0, "train"): 34, (0, "test"): 6, (1, "train"): 34, (1, "test"): 6}
    model = models.train_baseline(split.filter("split = 'train'"), max_features=200, trees=3, depth=2)
    got = models.predict_baseline(model, split.filter("split = 'test'").select("id", "label", "text")).collect()
    assert all((r.predicted == "Misleading") == (r.label == 1) for r in got)


def test_registered_baseline_is_the_full_model(spark, tables, monkeypatch):
    from tracemark.plans.models import baseline_predictions

    fit, used = models.train_baseline, {}

    def quick(training, **settings):
        used.update(settings)
        return fit(training, **{**settings, "trees": 1, "depth": 1})

    monkeypatch.setattr(models, "train_baseline", quick)
    assert baseline_predictions(tables).count() > 0
    stages = models.baseline_pipeline(**used).getStages()
    assert (stages[4].getVocabSize(), stages[-1].getMaxIter(), stages[-1].getMaxDepth()) == (20_000, 200, 6)
    common = " ".join(f"filler{i}" for i in range(1100))  # with its pairs more than 2,000 terms commoner than the telling ones
    rows = [(f"{common} {'miracle' if i % 2 else 'council'}", i % 2) for i in range(40)]
    data = spark.createDataFrame(rows, "text string, label int")
    got = models.predict_baseline(quick(data, **used), data).collect()
    assert sum((r.predicted == "Misleading") == (r.label == 1) for r in got) >= 38


def test_attribution_finds_the_telling_word(spark):
    docs = spark.createDataFrame([(1, "the miracle report is here"), (2, "")], "doc_id long, text string")
    weights = spark.createDataFrame([("miracle", 3.0), ("report", -1.0)], "word string, weight double")
    got = models.attribute_tokens(docs, weights, top=2).orderBy("rank").collect()
    assert [r.word for r in got] == ["miracle", "report"] and got[0].weight > 0 > got[1].weight


def test_lists_of_claims_and_evidence_are_made_once(spark, tables):
    """An inner explode makes its list twice, once to tell empty ones: the plan of the claims had the sentence scores twice."""
    from tracemark.operators import claims

    docs = tables.read("documents").select("doc_id", "text")
    plan = claims.rank_claims(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " . "), (4, "one two three four five. six"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.claim_no, r.claim) for r in claims.rank_claims(odd).collect()) == [(0, 0, "a b c d e"), (3, 0, " . "), (4, 0, "one two three four five.")]


@pytest.mark.parametrize("most, chunk", [(30, 15), (13, 12)])
def test_phrases_no_claim_has_are_dropped_before_the_shuffle(spark, monkeypatch, most, chunk):
    """Every wanted phrase stays, nearly all others go; with a table too small for the phrases more stay, none is lost."""
    from tracemark.operators import claims

    monkeypatch.setattr(claims, "LEADING_BITS", most)
    monkeypatch.setattr(claims, "CHUNK_BITS", chunk)
    wanted = spark.range(3000).select(F.xxhash64("id").alias("phrase"))
    leading, bits = claims.phrase_bits(wanted)
    assert leading == min(15, most) and len(bits) == 1 << leading - 3
    lists = spark.range(100).select(F.lit(1).alias("tier"), F.col("id").alias("item_id"), F.when(F.col("id") != 7, F.transform(F.sequence(F.col("id") * 60, F.col("id") * 60 + 59), lambda i: F.xxhash64(i))).alias("phrases"))
    left = [tuple(r) for r in claims.perhaps_wanted(lists, leading, spark.sparkContext.broadcast(bits)).collect()]
    hashes = {r.phrase for r in wanted.where("id < 420 or id >= 480").collect()}
    assert hashes <= {p for *_, p in left} and len(left) < 4500 and len(set(left)) == len(left)
    leading, bits = claims.phrase_bits(wanted.where("false"))
    assert not bits.any() and claims.perhaps_wanted(lists, leading, spark.sparkContext.broadcast(bits)).count() == 0
