"""Quality scores by naive-Bayes support vectors.

A text is the set of its n-grams: byte n-grams up to four, triples of word shapes, and marks of repetition (a word equal to one of the three before it,
with the share of such words in steps of a power of two). Each indicator is scaled by its log-count ratio between the classes and the vector brought to unit
length; dual coordinate descent then fits a linear hinge-loss model. Margins become probabilities by a logistic curve that is fitted on
the part of the sample which the support vectors have not seen.

Training reads at most `SAMPLE_ROWS` labelled rows, those with the smallest hashes of their ids; that bound also limits what the driver holds. Scores
use the text alone, as a whole.

Edge cases: null and empty texts are scored by the bias alone. Rows with a null label, id or text are not learnt from; without both classes
among the labels every score is the share of label 1 (0.5 without labels). Labels that repeat count once per distinct label. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm.common import SLICE_BYTES, slices, utf8, words

SAMPLE_ROWS = 6_000
HASH_BITS = 16
#: Buckets of bytes, pairs, hashed triples and fours, hashed shapes, marks of repetition.
_STARTS = np.cumsum([0, 256, 1 << 16, 1 << HASH_BITS, 1 << HASH_BITS, 1 << 12, 64])
FEATURES = int(_STARTS[-1])
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 12
THRESHOLD = 0.3


@dataclass
class Model:
    weight: np.ndarray  # log-count ratio times weight of the hinge model, by bucket
    square: np.ndarray  # squared log-count ratio by bucket
    bias: float
    slope: float
    shift: float
    constant: float | None = None


_CLASS = np.zeros(256, np.uint8)  # of bytes: 0 other, 1 lower case, 2 capital, 3 digit, 4 full stop and the like
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 1, 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number below 64 per word: the classes of its first, second and last byte."""
    kind = _CLASS[data].astype(np.int64)
    second = np.minimum(starts + 1, ends - 1)
    return (kind[starts] * 5 + kind[second]) % 13 * 5 + kind[ends - 1]


def row_features(column: pa.Array):
    """Per row the distinct buckets of its n-grams."""
    data, offsets = utf8(column)
    n = len(data)
    code = data.astype(np.int64)
    grams = np.full((4, n), -1, np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    grams[0] = code
    rolled = code.astype(np.uint32)
    for k in range(1, 4):
        rolled = rolled[: n - k] * np.uint32(0x01000193) + code[k:].astype(np.uint32) if n > k else rolled[:0]
        if k == 1:
            found = code[:-1] * 256 + code[1:]
        else:
            found = (((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)
        grams[k, : n - k] = np.where(left[: n - k] > k, _STARTS[k] + found, -1)
    starts, ends, row = words(data, offsets)
    shape = _shapes(data, starts, ends) if len(starts) else starts
    first = np.searchsorted(row, np.arange(len(column) + 1))
    lengths = ends - starts
    prefix = np.concatenate([[0], np.cumsum((code + 7) * (code + 131) % 1009)])
    sums = (prefix[ends] - prefix[starts]) * 64 + lengths  # equal for equal words
    stamp = np.zeros(FEATURES, np.int32)
    for i in range(len(column)):
        a, b = first[i], first[i + 1]
        mine = [grams[:, offsets[i] : offsets[i + 1]].ravel()]
        s = shape[a:b]
        if len(s) > 2:
            mine.append(_STARTS[4] + ((s[:-2] * 65 + s[1:-1]) * 65 + s[2:]) * 40503 % 4096)
        w, marks = sums[a:b], []
        for back in (1, 2, 3):
            same = int((w[back:] == w[:-back]).sum()) if len(w) > back else 0
            if same:
                marks.append(_STARTS[5] + back * 16 + min(15, int(15 + np.log2(same / len(w)))) if same * 32768 > len(w) else _STARTS[5] + back * 16)
        mine.append(np.array(marks, np.int64))
        idx = np.concatenate(mine)
        idx = idx[idx >= 0]
        stamp[idx] = np.arange(len(idx))
        yield idx[stamp[idx] == np.arange(len(idx))]


def train_model(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Model:
    """Fit on bucket sets and 0/1 labels."""
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(order) // 4] if len(order) >= 40 else order
    learnt = order[len(order) // 4 :] if len(order) >= 40 else order
    if labels[learnt].min() == labels[learnt].max():
        learnt = order
    counts = np.full((2, FEATURES), SMOOTHING)
    for i in learnt:
        counts[labels[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    square = ratio**2
    scaled = [ratio[r] / max(np.sqrt(square[r].sum()), 1e-9) for r in rows]
    y = np.where(labels > 0, 1.0, -1.0)
    share = (y[learnt] > 0).mean()
    cost = {1.0: PENALTY * 0.5 / share, -1.0: PENALTY * 0.5 / (1 - share)}
    w, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(learnt):
            x, r = scaled[i], rows[i]
            gradient = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1.0), 0.0), 4 * cost[y[i]])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                alpha[i] = new
    margin = np.array([w[rows[i]] @ scaled[i] + bias for i in held])
    slope, shift = _logistic(margin, labels[held])
    return Model(w * ratio, square, bias, slope, shift)


def _logistic(margin: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with targets drawn in a little."""
    up, down = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - target) + np.array([1e-3 * beta[0], 0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from `labels` (`doc_id` and the label column) and the texts of these ids in `docs`."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "label").limit(sample_rows)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")

    def features(batches):
        for part in slices(batches, "text"):
            sets = list(row_features(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([s.astype(np.int32) for s in sets], pa.list_(pa.int32()))], ["doc_id", "label", "buckets"])

    got = rows.mapInArrow(features, "doc_id long, label int, buckets array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    flat = got.column("buckets").combine_chunks()
    return train_model([np.asarray(flat[i].values) for i in range(len(flat))], got.column("label").to_numpy())


def scorer(model: Model):
    """Column function: text to the probability of label 1."""
    weight, square = model.weight.astype(np.float64), model.square.astype(np.float64)

    def score(column: pa.Array) -> pa.Array:
        out = []
        if model.constant is not None:
            return pa.array(np.full(len(column), model.constant))
        for part in slices(iter([pa.RecordBatch.from_arrays([column.fill_null("")], ["text"])]), "text", SLICE_BYTES):
            for idx in row_features(part.column(0)):
                out.append(weight[idx].sum() / max(np.sqrt(square[idx].sum()), 1e-9))
        z = model.slope * (np.array(out, np.float64) + model.bias) + model.shift
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.arrow_udf(score, "double")
