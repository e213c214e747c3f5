"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit of the codewords one binary classifier over hashed character n-grams tells languages with a 1
from those with a 0: the log ratio of the n-gram's share on either side, averaged over the n-grams of a text. Decoding adds, for every
language, the logistic loss of each margin against the bit wanted, weighted by how often the bit's classifier was right on that
language in training; the codeword with the least loss wins. The score is the softmax over negative losses, and a text is
flagged ambiguous when the runner-up is close.

Training reads a sample of at most about `SAMPLE_ROWS` labelled rows, shared evenly by the languages and picked by a hash of the id;
prediction reads nothing but the text, as a whole.

Edge cases: null texts and texts without a letter are `und` with score 0 and not ambiguous; rows with a null language or id are not learnt from. With one language
known every text with letters gets it; with none every text is `und`. Equal losses go to the first language in alphabetical order.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import SLICE_BYTES, slices, utf8

SAMPLE_ROWS = 20_000
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Bits of a codeword when there are too many languages for all splits.
MANY_BITS = 31
AMBIGUOUS = 0.6
RESULT = "lang_pred string, score double, ambiguous boolean, runner_up string"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets + 1 x bits; the last row is for places that are no n-gram
    scale: np.ndarray  # bits
    trust: np.ndarray  # languages x bits, rows sum to 1


def codewords(n: int) -> np.ndarray:
    """-1/1 matrix, one row a language: all splits up to six languages, else the best of many random matrices by least distance."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [(1, *c) for c in itertools.product((-1, 1), repeat=n - 1) if -1 in c]
        return np.array(columns, np.int8).T
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.int8), (n, MANY_BITS))
        least = min(int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(n), 2)) if (abs(code.sum(axis=0)) < n).all() else -1
        if least > most:
            best, most = code, least
    return best


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets per character and n (`BUCKETS` where there is no n-gram), the rows' first characters, and which rows have letters."""
    data, offsets = utf8(pc.utf8_lower(column))
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = heads[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letter = _letters()[points] if len(points) else np.zeros(0, bool)
    symbol = np.where(letter, points, 0).astype(np.uint32)
    n = len(symbol)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # characters from here to the end of the row
    out = np.full((len(GRAMS), n), BUCKETS, np.int32)
    rolled, some = np.zeros(n, np.uint32), np.zeros(n, bool)
    for k in range(max(GRAMS)):
        rolled[: n - k] = rolled[: n - k] * np.uint32(0x01000193) + symbol[k:] + np.uint32(1)
        some[: n - k] |= letter[k:]
        if k + 1 in GRAMS:
            hashed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)
            ok = some & (left > k)
            out[GRAMS.index(k + 1)][ok] = hashed[ok]
    rows = np.add.reduceat(letter, np.minimum(at[:-1], max(n - 1, 0))) > 0 if n else np.zeros(len(column), bool)
    return out, at, rows & (np.diff(at) > 0)


def margins(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio per row and bit, and which rows have letters."""
    buckets, at, has = gram_buckets(column)
    total = np.zeros((len(column), weights.shape[1]))
    counts = np.zeros(len(column))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        for row in buckets:
            total[full] += np.add.reduceat(weights[row], at[full], axis=0)
            counts[full] += np.add.reduceat((row < BUCKETS).astype(np.int64), at[full])
    return total / np.maximum(counts, 1)[:, None], has


def _sample(docs: DataFrame, rows: int) -> tuple[DataFrame, list[str]]:
    known = docs.where("doc_id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    share = F.coalesce(*(F.when(F.col("lang") == name, min(1.0, rows / len(languages) / n)) for name, n in counts.items()), F.lit(0.0)) if counts else F.lit(0.0)
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    return known.where(place < share).select("lang", "text"), languages


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from `doc_id`, `text` and `lang` of the given rows."""
    sample, languages = _sample(docs, sample_rows)
    code = codewords(len(languages))
    empty = Model(languages, code, np.zeros((BUCKETS + 1, code.shape[1]), np.float32), np.ones(code.shape[1]), np.full(code.shape, 1 / max(code.shape[1], 1)))
    if len(languages) < 2:
        return empty

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            buckets, at, _ = gram_buckets(part.column("text"))
            row_of = np.repeat(np.arange(part.num_rows), np.diff(at))
            names = np.array(part.column("lang").to_pylist())
            for name in set(names.tolist()):
                mine = (names == name)[row_of]
                found.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                for row in buckets:
                    found[name] += np.bincount(row[mine], minlength=BUCKETS + 1)
        for name, n in found.items():
            there = np.flatnonzero(n[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(n[there])], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    shares = np.full((len(languages), BUCKETS), 0.5)
    for i, name in enumerate(languages):
        mine = counted[counted["lang"] == name]
        shares[i, mine["bucket"].to_numpy()] += mine["n"].to_numpy()
    shares /= shares.sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    for j in range(code.shape[1]):
        weights[:BUCKETS, j] = np.log(shares[code[:, j] > 0].mean(axis=0)) - np.log(shares[code[:, j] < 0].mean(axis=0))

    def tried(batches):
        for part in slices(batches, "text"):
            f, has = margins(part.column("text"), weights)
            names = part.column("lang").to_pylist()
            for i in np.flatnonzero(has):
                want = code[languages.index(names[i])]
                yield pa.RecordBatch.from_arrays([pa.array([names[i]]), pa.array([(want * f[i]).tolist()], pa.list_(pa.float64()))], ["lang", "m"])

    bits = range(code.shape[1])
    sums = sample.mapInArrow(tried, "lang string, m array<double>").groupBy("lang").agg(
        F.count("*").alias("n"), *(F.sum((F.col("m")[j] > 0).cast("int")).alias(f"ok{j}") for j in bits), *(F.sum(F.abs(F.col("m")[j])).alias(f"abs{j}") for j in bits)).collect()
    n, size, trust = 0, np.zeros(len(bits)), np.ones(code.shape)
    for r in sums:
        n += r["n"]
        size += [r[f"abs{j}"] for j in bits]
        trust[languages.index(r["lang"])] = [(r[f"ok{j}"] + 1) / (r["n"] + 2) for j in bits]
    scale = 4.0 / np.maximum(size / max(n, 1), 1e-6)
    return Model(languages, code, weights, scale, trust / trust.sum(axis=1, keepdims=True))


def decode(model: Model, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of margins to the probabilities and the order of the languages."""
    scaled = f * model.scale
    loss = np.stack([(np.logaddexp(0, -scaled * model.code[i]) * model.trust[i]).sum(axis=1) for i in range(len(model.languages))], axis=1)
    p = np.exp(-3 * (loss - loss.min(axis=1, keepdims=True)))
    return p / p.sum(axis=1, keepdims=True), np.argsort(loss, axis=1, kind="stable")


def predictor(model: Model):
    """Column function: text to a struct of `RESULT`."""
    names = [*model.languages]

    def predict(column: pa.Array) -> pa.Array:
        parts = [_predict(part.column(0)) for part in slices(iter([pa.RecordBatch.from_arrays([column.fill_null("")], ["text"])]), "text", SLICE_BYTES // 2)]
        return pa.concat_arrays(parts) if parts else _predict(pa.array([], pa.string()))

    def _predict(column: pa.Array) -> pa.Array:
        n = len(column)
        if not names or not n:
            best, score, close, second = ["und"] * n, np.zeros(n), np.zeros(n, bool), [None] * n
        else:
            f, has = margins(column, model.weights)
            p, order = decode(model, f)
            score = np.where(has, np.take_along_axis(p, order[:, :1], 1)[:, 0], 0.0)
            close = has & (score < AMBIGUOUS) & (len(names) > 1)
            best = [names[k] if ok else "und" for k, ok in zip(order[:, 0], has)]
            second = [names[k] if ok and len(names) > 1 else None for k, ok in zip(order[:, min(1, len(names) - 1)], has)]
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_()), pa.array(second, pa.string())],
                                          ["lang_pred", "score", "ambiguous", "runner_up"])

    return F.arrow_udf(predict, RESULT)


def identified(docs: DataFrame, model: Model, text: Column | None = None) -> Column:
    return predictor(model)(F.col("text") if text is None else text)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose language is found. Texts without a letter go, and ambiguous ones whose best language has less than
    half of the probability."""
    name = "_language"
    while name in docs.columns:
        name += "_"
    found = F.col(name)
    return docs.withColumn(name, predictor(model)(F.col("text"))).where((found["lang_pred"] != "und") & (found["score"] >= 0.5)).drop(name)
