"""Packing into optimal length buckets.

Sequences longer than `MAX_LENGTH` tokens are cut into pieces of that length, the last one shorter. From the global histogram of piece lengths (at most
`MAX_LENGTH` numbers) dynamic programming picks the `BUCKETS` boundaries that leave the least padding. Inside a bucket, pieces are put in an
order given by a hash of id and piece, and cut into batches that fill the token budget once padded to the bucket's boundary.

Places in a bucket come from counts of blocks of the order, so a bucket with most of the rows is numbered by many tasks.

Edge cases: null and empty texts are the end token alone, one piece of length 1. Lengths below 1 or null count as 1. Rows with equal ids are packed
one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemark.llm.tokens import token_counts
from tracemark.session import materialise

MAX_LENGTH = 2048
BUCKETS = 16
BATCH_TOKENS = 65_536


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS, max_length: int = MAX_LENGTH) -> list[int]:
    """At most `buckets` ascending lengths, the last the largest one, with the least total padding."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return [max_length]
    counts = np.array([histogram[k] for k in lengths], np.float64)
    number, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    n = len(lengths)
    # cost[i, j]: padding of the lengths i to j - 1 in one bucket
    cost = np.concatenate([[0], lengths])[None, :] * (number[None, :] - number[:, None]) - (tokens[None, :] - tokens[:, None])
    cost[np.tril_indices(n + 1)] = np.inf
    best, choice = cost[0].copy(), [np.zeros(n + 1, np.int64)]
    best[0] = np.inf
    for _ in range(min(buckets, n) - 1):
        through = best[:, None] + cost
        choice.append(np.argmin(through, axis=0))
        best = through[choice[-1], np.arange(n + 1)]
    out, j = [], n
    for picked in reversed(choice):
        out.append(int(lengths[j - 1]))
        j = int(picked[j])
    return out[::-1]


def places(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Add `place`, the row's number from 0 among the rows of `key` in the order given; no task numbers a whole key."""
    block = F.spark_partition_id().alias("_block")
    stored = materialise(rows.repartitionByRange(*order).select("*", block), "ordered")
    inside = Window.partitionBy("_block", key).orderBy(*order)
    counts = stored.groupBy(key, "_block").agg(F.count("*").alias("_n"))  # blocks times keys
    before = counts.select(key, "_block", (F.sum("_n").over(Window.partitionBy(key).orderBy("_block")) - F.col("_n")).alias("_before"))
    numbered = stored.withColumn("_inside", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(F.broadcast(before), [key, "_block"]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def pieces(lengths: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """`doc_id`, `piece`, `start` and `length` of every cut of sequences (`doc_id`, `n_tokens`)."""
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(1)), F.lit(1)).cast("long")
    cut = lengths.select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {max_length}"))).alias("piece"))
    start = F.col("piece") * max_length
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_length)).alias("length"))


def pack(lengths: DataFrame, buckets: int = BUCKETS, max_length: int = MAX_LENGTH, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Per piece `doc_id`, `piece`, `start`, `length`, its `bucket`, `padded_length`, `batch` (numbered inside the bucket) and `slot` in the batch."""
    rows = materialise(pieces(lengths, max_length), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    tops = boundaries(histogram, buckets, max_length)
    bucket = F.coalesce(*(F.when(F.col("length") <= top, i) for i, top in enumerate(tops)))
    padded = F.get(F.array(*map(F.lit, tops)), F.col("bucket")).cast("long")
    keyed = rows.withColumn("bucket", bucket).withColumn("padded_length", padded).withColumn("mixed", F.xxhash64("doc_id", "piece"))
    per_batch = F.greatest(F.expr(f"{batch_tokens} div padded_length"), F.lit(1))
    numbered = places(keyed, "bucket", "mixed", "doc_id", "piece").withColumn("fits", per_batch)
    return numbered.select("doc_id", "piece", "start", "length", "bucket", "padded_length", F.expr("place div fits").alias("batch"), (F.col("place") % F.col("fits")).alias("slot"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **limits: int) -> DataFrame:
    return pack(token_counts(docs, tokenizer), **limits)
