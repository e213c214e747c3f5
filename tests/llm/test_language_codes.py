import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracemark.llm import language_codes

from .conftest import make


def corpus(prose, n=160):
    return [(i, prose(lang), lang) for i, lang in zip(range(n), itertools.cycle(["en", "de", "fr", "es"]))]


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = language_codes.codewords(n)
        assert code.shape[0] == n and (abs(code.sum(axis=0)) < n).all()
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        assert least >= (1 << n - 2 if n <= 6 else 6)


def test_held_out_accuracy(spark, prose):
    rows = corpus(prose)
    docs = make(spark, rows)
    model = language_codes.fit(docs.where("doc_id % 3 <> 1"))
    found = {r["doc_id"]: r for r in docs.select("doc_id", language_codes.predictor(model)(F.col("text")).alias("p")).select("doc_id", "p.*").collect()}
    held = [(found[i]["lang_pred"], lang) for i, _, lang in rows if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_other_columns_are_no_input(spark, prose):
    docs = make(spark, corpus(prose, 60))
    model = language_codes.fit(docs)
    p = language_codes.predictor(model)(F.col("text")).alias("p")
    a = docs.select("doc_id", p).collect()
    b = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 0).select("doc_id", p).collect()
    assert sorted(a) == sorted(b)


def test_edges(spark, prose, edges, nothing):
    model = language_codes.fit(make(spark, corpus(prose)))
    found = edges.select("doc_id", "text", language_codes.predictor(model)(F.col("text")).alias("p")).select("doc_id", "text", "p.*").collect()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or (r["score"] == 0 and not r["ambiguous"])
    kept = language_codes.keep_known(edges, model)
    assert kept.columns == edges.columns and {1, 2, 3, 12}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language_codes.keep_known(nothing, model).count() == 0


def test_few_languages(spark, nothing, prose):
    none = language_codes.fit(nothing)
    docs = make(spark, [(1, "words", "en"), (2, "", "en")])
    assert [r["p"]["lang_pred"] for r in docs.select(language_codes.predictor(none)(F.col("text")).alias("p")).collect()] == ["und", "und"]
    one = language_codes.fit(docs)
    assert [(r["p"]["lang_pred"], r["p"]["ambiguous"]) for r in docs.select(language_codes.predictor(one)(F.col("text")).alias("p")).collect()] == [("en", False), ("und", False)]


def test_undecided_text_is_flagged():
    code = language_codes.codewords(4)
    model = language_codes.Model(["a", "b", "c", "d"], code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    p, order = language_codes.decode(model, np.stack([np.zeros(code.shape[1]), 5.0 * code[2]]))
    assert np.allclose(p[0], 0.25) and order[0, 0] == 0 and order[1, 0] == 2 and p[1].max() > 0.9


def test_fold(spark):
    from tracemark.llm.common import id_remainder

    rows = spark.range(200).select("id", id_remainder("id", 3).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)
