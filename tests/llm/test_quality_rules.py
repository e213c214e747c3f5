import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracemark.llm import quality_rules
from tracemark.llm.quality_rules import BAD, GOOD, NONE

from .conftest import EDGES, WORD, make
from .test_nb_svm import labelled


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_equal_brute_force(spark, edges):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "c ", " ", "\n", "\t", "#", "Long ", "\x0b", " ", "é"]) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    for df, given in ((make(spark, rows), rows), (edges, EDGES)):
        got = quality_rules.judged(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        assert sorted(map(tuple, got), key=str) == sorted(((i, *base(t)) for i, t, _ in given), key=str)


def test_junk_goes_and_clean_texts_stay(spark, prose):
    rows = labelled(prose, 200)
    found = {r["doc_id"]: r for r in quality_rules.judged(make(spark, [r[:3] for r in rows])).collect()}
    clean = [found[r[0]]["kept"] for r in rows if r[3]]
    junk = [found[r[0]]["kept"] for r in rows if not r[3]]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1
    assert all(not r["kept"] for r in found.values() if r["base_failed"]) and all(0 <= r["posterior"] <= 1 for r in found.values())


def test_estimation_equals_brute_force(spark):
    rng = random.Random(6)
    rules = ["a", "b", "c"]
    rows = Counter()
    for _ in range(600):
        good = rng.random() < 0.7
        rows[tuple((GOOD if good else BAD) if rng.random() < p else NONE if rng.random() < 0.6 else (BAD if good else GOOD) for p in (0.8, 0.6, 0.5))] += 1
    model = quality_rules.fit(spark.createDataFrame([(*k, n) for k, n in rows.items()], "a int, b int, c int, n long"), rules, rounds=15)
    start = quality_rules._started(rules)
    want = start
    for _ in range(15):
        q = {}
        for k in rows:
            good, bad = math.log(want["prior"]), math.log(1 - want["prior"])
            for r, v in zip(rules, k):
                if v == NONE:
                    continue
                good, bad = good + math.log(want["rules"][r]["good"][v]), bad + math.log(want["rules"][r]["bad"][v])
            q[k] = 1 / (1 + math.exp(bad - good))
        n, up = sum(rows.values()), sum(c * q[k] for k, c in rows.items())
        new = {"prior": (up + 1) / (n + 2), "rules": {}}
        for i, r in enumerate(rules):
            share = lambda side, v, w, total: (sum(c * w(k) for k, c in rows.items() if k[i] == v) + quality_rules.PRIOR * start["rules"][r][side][v]) / (total + quality_rules.PRIOR)  # noqa: E731, B023
            new["rules"][r] = {"good": {v: share("good", v, q.get, up) for v in (BAD, NONE, GOOD)}, "bad": {v: share("bad", v, lambda k: 1 - q[k], n - up) for v in (BAD, NONE, GOOD)}}
        want = new
    assert math.isclose(model["prior"], want["prior"], rel_tol=1e-6)
    for r in rules:
        for side in ("good", "bad"):
            for v in (BAD, NONE, GOOD):
                assert math.isclose(model["rules"][r][side][v], want["rules"][r][side][v], rel_tol=1e-6)


def test_edges(spark, edges, nothing):
    assert quality_rules.judged(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0
    kept = quality_rules.keep_good(edges)
    assert kept.columns == edges.columns and {1, 2, 3, 4, 9, 11}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_no_python_in_the_plan(spark, edges):
    plan = quality_rules.judged(edges)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_unanimous_votes(spark):
    model = quality_rules._started(["a", "b"])
    row = spark.range(1).select(quality_rules.posterior(model, {"a": F.lit(GOOD), "b": F.lit(GOOD)}).alias("up"), quality_rules.posterior(model, {"a": F.lit(BAD), "b": F.lit(BAD)}).alias("down")).first()
    assert row["up"] > 0.9 > 0.2 > row["down"]
