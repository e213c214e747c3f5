"""Quality rules joined by weak supervision.

Each rule votes good, bad or abstains. How often it votes what in good and in bad documents is not set by hand: expectation-maximisation finds
it from the agreement of the rules over the whole corpus, and a document is kept if the posterior probability of being good, given all
its votes, reaches `KEEP`. Only the counts of vote patterns (at most 3 to the number of rules) enter the estimation. Built-in functions only.

Edge cases: null and empty texts have no words, fail the base rules and are not kept. Documents whose rules all abstain get the estimated share of
good documents. An empty table gives an empty result. Repeated rows are judged one by one, other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import texts
from tracemark.session import materialise

KEEP = 0.5
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ROUNDS = 25
#: Weight of the prior in counted documents: a rule is expected to vote on the right side.
PRIOR = 4.0

SPACES = r"[\x20\x09-\x0D]"
GOOD, BAD, NONE = 1, -1, 0


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs again: windows sorted by hash, repeated ones sorted by place, overlaps counted once."""

    def count(ordered: Column) -> Column:
        size = F.size(ordered)
        again = F.filter(ordered, lambda e, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == e["h"])) | ((i < size - 1) & (F.get(ordered, i + 1)["h"] == e["h"])))
        places = F.sort_array(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(unique, F.lit(0)).otherwise(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), count))


def _word_stats(words: Column) -> Column:
    n = F.size(words)
    window = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    doubled = F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(words, i) == F.get(words, i - 1)))).otherwise(0)
    plain = F.size(F.filter(words, lambda w: w.rlike(r"^[\p{L}'’-]+[.,;:?]?$") & ~w.rlike(r"^\p{Lu}{2,}")))
    return F.struct(n.alias("n_words"), let(hashes, _covered).alias("n_repeat_words"), doubled.alias("n_doubled"), plain.alias("n_plain"),
                    F.size(F.array_distinct(words)).alias("n_distinct"))


def _line_stats(lines: Column) -> Column:
    return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
                    F.size(F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}][.?!:;\"”»)]+" + SPACES + "*$"))).alias("n_ended"))


def statistics(text: Column) -> Column:
    """Struct of all counts that rules look at."""
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    by_word, by_line = let(words, _word_stats), let(lines, _line_stats)
    both = F.struct(by_word.alias("w"), by_line.alias("l"), kept(SPACES + "+").alias("word_chars"), kept(r"[^#*$%&|<>]+").alias("n_symbols"),
                    kept(r"\P{L}+").alias("n_letters"), kept(r"\P{Lu}+").alias("n_upper"), kept(r"[^!]+").alias("n_exclaims"))
    return let(both, lambda s: F.struct(*(s["w"][c].cast("long").alias(c) for c in ("n_words", "n_repeat_words", "n_doubled", "n_plain", "n_distinct")),
                                        *(s["l"][c].cast("long").alias(c) for c in ("n_lines", "n_dup_lines", "n_ended")),
                                        *(s[c].cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_letters", "n_upper", "n_exclaims"))))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _vote(bad: Column, good: Column | None = None) -> Column:
    rest = F.when(good, GOOD).otherwise(NONE) if good is not None else F.lit(NONE)
    return F.coalesce(F.when(bad, BAD).otherwise(rest), F.lit(NONE)).cast("tinyint")


def votes(s: Column) -> dict[str, Column]:
    """Name of each rule and its vote. Rules that only know faults abstain where they find none; what
    may happen once in a short clean text has to come back to count."""
    return {
        "symbols": _vote(s["n_symbols"] > 0.04 * s["word_chars"]),
        "capitals": _vote(s["n_upper"] > 0.4 * s["n_letters"]),
        "shouting": _vote((s["n_exclaims"] >= 3) & (s["n_exclaims"] > 0.15 * s["n_words"])),
        "doubled_words": _vote((s["n_doubled"] >= 3) & (s["n_doubled"] > 0.05 * s["n_words"])),
        "repeated_windows": _vote(s["n_repeat_words"] > 0.15 * s["n_words"]),
        "repeated_lines": _vote((s["n_dup_lines"] >= 2) & (s["n_dup_lines"] > 0.3 * s["n_lines"])),
        "plain_words": _vote(s["n_plain"] < 0.75 * s["n_words"], s["n_plain"] >= 0.93 * s["n_words"]),
        "letters": _vote(s["n_letters"] < 0.75 * s["word_chars"], s["n_letters"] >= 0.9 * s["word_chars"]),
        "ended_lines": _vote(s["n_ended"] < 0.1 * s["n_lines"], s["n_ended"] >= 0.6 * s["n_lines"]),
    }


RULES = ["symbols", "capitals", "shouting", "doubled_words", "repeated_windows", "repeated_lines", "plain_words", "letters", "ended_lines"]


def posterior(model: dict, vote: dict[str, Column]) -> Column:
    """Probability of a good document, given the votes. A rule that abstains has no say."""
    logit = F.lit(math.log(model["prior"]) - math.log1p(-model["prior"]))
    for rule, column in vote.items():
        p = model["rules"][rule]
        weight = {v: math.log(p["good"][v]) - math.log(p["bad"][v]) for v in (BAD, GOOD)}
        logit = logit + F.when(column == BAD, weight[BAD]).when(column == GOOD, weight[GOOD]).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def _started(rules: list[str]) -> dict:
    """Start of the estimation: a fault is named six times as often in bad documents, praise three times as often in good ones."""
    good = {BAD: 0.03, NONE: 0.37, GOOD: 0.6}
    bad = {BAD: 0.3, NONE: 0.5, GOOD: 0.2}
    return {"prior": 0.8, "rules": {r: {"good": dict(good), "bad": dict(bad)} for r in rules}}


def fit(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over counted vote patterns (columns `rules` and `n`)."""
    model = _started(rules)
    start = _started(rules)
    for _ in range(rounds):
        q = posterior(model, {r: F.col(r) for r in rules})
        sums = [F.sum(F.col("n") * F.col("q")).alias("good"), F.sum("n").alias("all")]
        for i, r in enumerate(rules):
            for v in (BAD, NONE, GOOD):
                hit = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(hit * F.col("q")).alias(f"g{i}_{v}"), F.sum(hit).alias(f"a{i}_{v}")]
        row = patterns.withColumn("q", q).agg(*sums).first()
        if not row["all"]:
            return model
        n_good, n_bad = row["good"], row["all"] - row["good"]
        model = {"prior": min(max((n_good + 1) / (row["all"] + 2), 0.01), 0.99), "rules": {}}
        for i, r in enumerate(rules):
            model["rules"][r] = {
                "good": {v: (row[f"g{i}_{v}"] + PRIOR * start["rules"][r]["good"][v]) / (n_good + PRIOR) for v in (BAD, NONE, GOOD)},
                "bad": {v: (row[f"a{i}_{v}"] - row[f"g{i}_{v}"] + PRIOR * start["rules"][r]["bad"][v]) / (n_bad + PRIOR) for v in (BAD, NONE, GOOD)},
            }
    return model


def vote_patterns(counted: DataFrame, stats: str) -> DataFrame:
    named = counted.select(*(v.alias(r) for r, v in votes(F.col(stats)).items()))
    return materialise(named.groupBy(*RULES).agg(F.count("*").alias("n")), "vote-patterns")


def judged(docs: DataFrame) -> DataFrame:
    """`doc_id`, the counts, `base_failed`, the vote of each rule, `posterior` and `kept` per document."""
    counted = materialise(texts(docs).select("doc_id", statistics(F.col("text")).alias("s")), "statistics")
    model = fit(vote_patterns(counted, "s"), RULES)
    vote = votes(F.col("s"))
    out = counted.select("doc_id", "s.*", base_failed(F.col("s")).alias("base_failed"), F.struct(*(v.alias(r) for r, v in vote.items())).alias("votes"), posterior(model, vote).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that are kept. Counts are stored beside the rows, so nothing is joined."""
    name = "_statistics"
    while name in docs.columns:
        name += "_"
    counted = materialise(docs.withColumn(name, statistics(F.coalesce(F.col("text"), F.lit("")))), "with-statistics")
    model = fit(vote_patterns(counted, name), RULES)
    s = F.col(name)
    return counted.where(~base_failed(s) & (posterior(model, votes(s)) >= KEEP)).drop(name)
