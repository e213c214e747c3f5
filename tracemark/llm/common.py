"""Shared pieces of the training-data operators: input columns, Arrow batches in bounded slices, byte-level kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; its arrays take about 60 times as much. One longer document is one slice.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` alone (a null text is empty); other columns can't clash with those of an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_remainder(column: str, divisor: int):
    """crc32 of the id's decimal text, modulo `divisor`: the folds of the labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose text stays near `budget` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the rows' offsets in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The base of the rolling hash, or its inverse, to the powers 0 to n - 1."""
    key = "inverse" if inverse else "base"
    if len(_POWERS.get(key, ())) < n:
        factors = np.full(max(n, SLICE_BYTES + 65536), _BASE_INVERSE if inverse else _BASE)
        factors[0] = 1
        _POWERS[key] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[key][:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from differences of one running polynomial sum."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words `[^\\x20\\x09-\\x0D]+` of each row."""
    solid = ~SPACE[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[offsets] = True  # a row's edge ends a word as white space does
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | inner[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | inner[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
