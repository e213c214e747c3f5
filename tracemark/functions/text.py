"""Column builders for text: normalisation, sentences, words, video ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]+[.!?]*"
NON_WORD = r"[^\p{L}\p{N}]+"

# Function words left out of claim scoring; pass another list to replace it.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both "
    "but by can could did do does down during each few for from had has have he her here him his how i if in into "
    "is it its just me more most my no nor not now of off on once only or other our out over own same she should "
    "so some such than that the their them then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with would you your"
).split()


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """Spark strings are already valid UTF-8, so only the surrounding whitespace goes."""
    return strip(text)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(F.split(strip(text), r"\s+"))


def sentences(text: Column, min_words: int = 5) -> Column:
    """Stripped sentences that hold at least `min_words` whitespace-separated words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), 0), strip)
    return F.filter(found, lambda s: n_words(s) >= min_words)


def shingles(tokens: Column, offsets: tuple[int, ...]) -> Column:
    """Words at the given offsets from every start position, joined by a space.

    A text too short for one shingle gives all its words as a single feature.
    """
    count = F.size(tokens) - max(offsets)
    column = lambda o: F.slice(tokens, F.lit(o + 1), F.greatest(count, F.lit(0)))
    grams = column(offsets[0])
    for o in offsets[1:]:
        grams = F.zip_with(grams, column(o), lambda x, y: F.concat_ws(" ", x, y))
    return F.when(count > 0, grams).otherwise(F.array(F.array_join(tokens, " ")))


def youtube_id(raw: Column) -> Column:
    """Eleven-character video id of a watch, short or embed address, or of a bare id."""
    ident = "([A-Za-z0-9_-]{11})"
    patterns = (
        rf"[?&]v={ident}",
        rf"youtu\.be/{ident}",
        rf"youtube\.com/embed/{ident}",
        rf"^{ident}$",
    )
    return F.coalesce(*[F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in patterns])


def percent(value: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", value * 100)
