import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that carry names which the operators use inside.
CLASHES = "cls long, label string, kept boolean, hi long, lo long, s string, key string, n_tokens string, lang_pred string, posterior string, unit string, start string"


def make(spark, rows, clash=True):
    """Documents (doc_id, text, lang, source, n_chars) with clashing columns beside them."""
    full = [(i, t, lang, "src", None if t is None else len(t), *((None,) * 12)) for i, t, lang in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)
    return df if clash else df.select("doc_id", "text", "lang", "source", "n_chars")


EDGES = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, "Two words", "de"), (6, "naïve café — 日本語 \U0001f600 <|x|> a\x00b", None),
    (7, "the same text again and again", "en"), (8, "the same text again and again", "en"), (8, "the same text again and again", "en"), (None, "no id here at all", "fr"),
    (9, "long " * 30_000, "en"), (10, "x" * 120_000, None), (11, "\n".join(["a line that comes back."] * 40), "en"), (12, "### $$$ ***", None),
]


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words of four languages, the same on every run."""
    rng = random.Random(3)
    parts = {"en": ["the", "er", "ing", "th", "ou", "ly", "wh"], "de": ["sch", "ung", "keit", "ä", "der", "pf"], "fr": ["eau", "é", "que", "oi", "le", "ç"], "es": ["ción", "ñ", "ado", "mente", "ll", "os"]}

    def text(lang, words=60):
        out = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
        return " ".join(" ".join(out[i : i + 12]).capitalize() + "." for i in range(0, words, 12))

    return text
