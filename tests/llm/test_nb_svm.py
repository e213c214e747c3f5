import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracemark.llm import nb_svm

from .conftest import make


def labelled(prose, n=240):
    rng, rows = random.Random(9), []
    for i in range(n):
        lang = rng.choice(["en", "de", "fr", "es"])
        t = prose(lang, rng.randint(15, 60))
        bad = i % 4 == 0
        if bad:
            kind = rng.randrange(4)
            w = t.split()
            t = t.upper().replace(" ", "!! ") if kind == 0 else " | ".join(w) if kind == 1 else " ".join(x + "###" for x in w) if kind == 2 else " ".join(x for x in w[:6] for _ in range(8))
        rows.append((i, t, lang, 0 if bad else 1))
    return rows


def test_held_out(spark, prose):
    rows = labelled(prose)
    docs = make(spark, [r[:3] for r in rows])
    labels = spark.createDataFrame([(r[0], r[3], None) for r in rows if r[0] % 5], "doc_id long, quality int, text string")
    model = nb_svm.fit(docs, labels)
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", nb_svm.scorer(model)(F.col("text")).alias("s")).collect()}
    held = [(found[r[0]], r[3]) for r in rows if r[0] % 5 == 0]
    assert np.mean([(s >= nb_svm.THRESHOLD) == (y == 1) for s, y in held]) > 0.9
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_edges(spark, prose, edges, nothing):
    rows = labelled(prose, 80)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = nb_svm.fit(make(spark, [r[:3] for r in rows]), labels)
    found = edges.select("text", nb_svm.scorer(model)(F.col("text")).alias("s")).collect()
    assert len(found) == edges.count() and all(0 <= r["s"] <= 1 for r in found)
    assert len({r["s"] for r in found if not r["text"]}) == 1
    assert nothing.select(nb_svm.scorer(model)(F.col("text"))).count() == 0


def test_one_class_or_none(spark, nothing):
    docs = make(spark, [(1, "a text", None), (2, "b text", None)])
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert nb_svm.fit(docs, labels).constant == 1.0
    assert nb_svm.fit(nothing, labels).constant == 0.5
    assert nb_svm.fit(docs, labels.where("false")).constant == 0.5


def test_features_are_sets():
    sets = list(nb_svm.row_features(pa.array(["abab", "abab abab", "", "é"])))
    assert all(len(s) == len(set(s.tolist())) for s in sets) and len(sets[2]) == 0
    # a, b, ab, ba, aba, bab, abab
    assert len(sets[0]) == 7 and set(sets[0].tolist()) <= set(sets[1].tolist())


def test_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 500, 20), [600 + label, 700]])) for label in rng.integers(0, 2, 200)]
    labels = np.array([int(601 in r) for r in rows])
    model = nb_svm.train_model(rows, labels)
    margin = [model.weight[r].sum() / np.sqrt(model.square[r].sum()) + model.bias for r in rows]
    assert ((np.array(margin) > 0) == (labels > 0)).mean() > 0.98
