"""Text models: classifier labels, the trained baseline, splits, evaluation, token attribution."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.functions import text as tx
from tracemark.operators.boosting import BoostedTrees
from tracemark.operators.ranking import positions
from tracemark.session import materialise


def softmax_label(rows: DataFrame, genuine: Column, misleading: Column, text: Column | None = None) -> DataFrame:
    """Label and confidence from two logits; an empty text is Genuine with confidence 0."""
    p_fake = 1.0 / (1.0 + F.exp(genuine - misleading))
    empty = F.lit(False) if text is None else F.trim(text) == ""
    return rows.withColumn("_p", p_fake).withColumns({
        "label": F.when(~empty & (F.col("_p") > 0.5), "Misleading").otherwise("Genuine"),
        "confidence": F.when(empty, 0.0).otherwise(F.greatest(F.col("_p"), 1.0 - F.col("_p"))),
    }).drop("_p")


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.85, seed: int = 42) -> DataFrame:
    """`train` or `test` per row: the first `share` of each label in the order of a digest of key and seed."""
    drawn = rows.withColumn("_draw", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    placed = positions(drawn, [label], ["_draw"])
    cut = F.ceil(F.round(F.col("group_size") * share, 6))
    return placed.withColumn("split", F.when(F.col("position") <= cut, "train").otherwise("test")).drop("_draw", "position", "group_size")


def split_videos(videos: DataFrame, key: str, val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole videos into `train` and `val`."""
    halves = stratified_split(videos.withColumn("_all", F.lit(1)), key, "_all", 1 - val_share, seed)
    return halves.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train")).drop("_all")


def baseline_pipeline(max_features: int = 20_000, trees: int = 200, depth: int = 6, stop_words: list[str] | None = None) -> Pipeline:
    """Counts of words and word pairs, then boosted trees. Inverse document frequencies would scale each feature as a whole, which trees don't see."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=list(tx.STOP_WORDS if stop_words is None else stop_words)),
        NGram(inputCol="_words", outputCol="_pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="features", vocabSize=max_features),
        BoostedTrees(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth),
    ])


def train_baseline(training: DataFrame, **settings) -> PipelineModel:
    return baseline_pipeline(**settings).fit(training.select("text", F.col("label").cast("double").alias("label")))


def baseline_scorer(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """Adds `score`, the model's probability of Misleading for `text`."""
    return lambda rows: model.transform(rows).select(*rows.columns, vector_to_array("probability").getItem(1).alias("score"))


def baseline_rule(p_misleading: Column, text: Column, undecided_band: bool = False) -> Column:
    """Label and probability of the likelier class; empty texts are Genuine with 0, a near tie Genuine with 0.5."""
    fake = p_misleading > 0.5
    label = F.when(fake, "Misleading").otherwise("Genuine")
    probability = F.greatest(p_misleading, 1.0 - p_misleading)
    if undecided_band:
        near = (p_misleading > 0.45) & (p_misleading < 0.55)
        label, probability = F.when(near, "Genuine").otherwise(label), F.when(near, 0.5).otherwise(probability)
    empty = tx.strip(F.coalesce(text, F.lit(""))) == ""
    return F.struct(F.when(empty, "Genuine").otherwise(label).alias("label"), F.when(empty, 0.0).otherwise(probability).alias("probability"))


def predict_baseline(model: PipelineModel, rows: DataFrame, undecided_band: bool = False) -> DataFrame:
    """`rows` (…, text) with the predicted label and probability."""
    scored = baseline_scorer(model)(rows)
    return scored.withColumn("_r", baseline_rule(F.col("score"), F.col("text"), undecided_band)).select(
        *rows.columns, F.col("_r.label").alias("predicted"), F.col("_r.probability").alias("probability"))


def evaluate(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class, with the overall accuracy on each row."""
    cells = rows.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select("n", F.explode(F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
    )).alias("s")).select("s.*")
    per_class = sides.groupBy("class").agg(F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    everything = Window.partitionBy(F.lit(1))
    accuracy = F.sum("hit").over(everything) / F.sum("support").over(everything)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    rated = per_class.withColumns({"precision": ratio("hit", "claimed"), "recall": ratio("hit", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rated.withColumns({"f1": f1, "accuracy": accuracy}).select("class", "precision", "recall", "f1", "support", "accuracy")


def token_weights(training: DataFrame, max_features: int | None = None) -> DataFrame:
    """Log-odds of the words between misleading and genuine texts: a linear token model (word, weight).

    All words count; `max_features` keeps the commonest ones only.
    """
    seen = training.select("label", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word"))
    counts = seen.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("fake"), F.count_if(F.col("label") == 0).alias("real"))
    if max_features is not None:
        counts = counts.orderBy(F.desc(F.col("fake") + F.col("real")), "word").limit(max_features)
    return counts.select("word", F.log((F.col("fake") + 1.0) / (F.col("real") + 1.0)).alias("weight"))


def attribute_tokens(docs: DataFrame, weights: DataFrame, samples: int = 300, top: int = 10, seed: int = 42) -> DataFrame:
    """The `top` words that move the score of each text most, from random word removals and a local linear fit.

    Word weights are joined in Spark; each text then carries its distinct words and their contributions, so a
    task fits one text at a time whatever the size of the corpus.
    """
    words = docs.select("doc_id", F.explode(tx.words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    parts = words.join(weights, "word", "left").select("doc_id", "word", (F.col("n") * F.coalesce("weight", F.lit(0.0))).alias("part"))
    packed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "part"))).alias("w")).select(
        "doc_id", F.transform("w", lambda e: e["word"]).alias("words"), F.transform("w", lambda e: e["part"]).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, names, contributions in batch.itertuples(index=False):
                fit = np.round(_local_fit(np.asarray(contributions), samples, [seed, int(doc_id) & 0x7FFFFFFF]), 9)
                best = np.lexsort((np.arange(len(names)), -np.abs(fit)))[:top]
                out += [(doc_id, n + 1, names[i], float(fit[i])) for n, i in enumerate(best)]
            yield pd.DataFrame(out, columns=["doc_id", "rank", "word", "weight"])

    return packed.mapInPandas(run, "doc_id long, rank int, word string, weight double")


WORD = re.compile(r"\w+")


def _masks(doc_id: int, words: int, samples: int, seed: int) -> np.ndarray:
    """Which words each sample keeps: all of them in the first, a random number of them in the others."""
    rng = np.random.default_rng([seed, doc_id & 0x7FFFFFFFFFFFFFFF])
    masks = np.ones((samples, words), bool)
    for row in masks[1:]:
        row[rng.permutation(words)[: rng.integers(1, words + 1)]] = False
    return masks


def masked_texts(docs: DataFrame, samples: int = 300, seed: int = 42) -> DataFrame:
    """`doc_id`, `sample`, `text`: each text with random words removed, all occurrences of a word together; sample 0 is the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                spans = [m.span() for m in WORD.finditer(text)]
                words = {w: i for i, w in enumerate(dict.fromkeys(text[a:b] for a, b in spans))}
                if not words:
                    continue
                of = np.array([words[text[a:b]] for a, b in spans])
                cuts = [0, *(c for span in spans for c in span), len(text)]
                parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]  # gap, word, gap, word, …, gap
                rows = []
                for mask in _masks(doc_id, len(words), samples, seed):
                    kept = parts.copy()
                    for i in np.flatnonzero(~mask[of]).tolist():
                        kept[2 * i + 1] = ""
                    rows.append("".join(kept))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * samples, pa.int64()), pa.array(range(samples), pa.int32()), pa.array(rows, pa.string())], ["doc_id", "sample", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, sample int, text string")


def explain_model(docs: DataFrame, scorer: Callable[[DataFrame], DataFrame], samples: int = 300, top: int = 10, seed: int = 42) -> DataFrame:
    """The `top` words of each text that move a model's score most: doc_id, rank, word, weight.

    `scorer` adds `score` to rows with `text`, as `baseline_scorer` does. The masked texts are rows, scored like any other rows; only their scores, `samples` numbers a text, come
    back to it, and the weighted ridge fit is solved from normal equations in the smaller of words and samples. Ids must be unique and not null. Texts without words have no rows.
    """
    texts = materialise(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "explained")
    scored = scorer(masked_texts(texts, samples, seed)).select("doc_id", "sample", "score")
    per_doc = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sample", "score"))).alias("s"))
    joined = texts.join(materialise(per_doc.select("doc_id", F.transform("s", lambda e: e["score"]).alias("scores")), "mask-scores"), "doc_id")

    def fit(ids: pa.Array, texts: pa.Array, scores: pa.Array) -> pa.Array:
        out = []
        for doc_id, text, y in zip(ids.to_pylist(), texts.to_pylist(), scores.to_pylist()):
            words = list(dict.fromkeys(WORD.findall(text)))
            weight = np.round(_ridge(_masks(doc_id, len(words), samples, seed).astype(float), np.array(y)), 9)
            best = np.lexsort((np.arange(len(words)), -np.abs(weight)))[:top]
            out.append([{"rank": n + 1, "word": words[i], "weight": float(weight[i])} for n, i in enumerate(best)])
        return pa.array(out, pa.list_(pa.struct([("rank", pa.int32()), ("word", pa.string()), ("weight", pa.float64())])))

    found = F.arrow_udf(fit, "array<struct<rank: int, word: string, weight: double>>")("doc_id", "text", "scores")
    return joined.select("doc_id", F.inline(found))


def _local_fit(parts: np.ndarray, samples: int, seed: list[int]) -> np.ndarray:
    """Ridge coefficients of the score over random word masks, nearer masks weighing more."""
    masks = (np.random.default_rng(seed).random((samples, len(parts))) < 0.5).astype(float)
    masks[0] = 1
    return _ridge(masks, 1 / (1 + np.exp(-np.clip(masks @ parts, -50, 50))))


def _ridge(masks: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Ridge coefficients of scores over masks, each weighed by its nearness to the full text."""
    samples, words = masks.shape
    distance = 1 - np.sqrt(masks.mean(axis=1))
    weight = np.exp(-(distance**2) / 0.25**2)
    near = np.sqrt(weight)
    x = (masks - weight @ masks / weight.sum()) * near[:, None]
    y = (score - weight @ score / weight.sum()) * near
    if words < samples:
        return np.linalg.solve(x.T @ x + np.eye(words), x.T @ y)
    return x.T @ np.linalg.solve(x @ x.T + np.eye(samples), y)
