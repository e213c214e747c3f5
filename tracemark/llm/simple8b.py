"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its top four bits and as many values as fit at the selector's width; the first two selectors stand for runs of
zeros. A value of 60 bits or more is written as the escape, all ones in a word of its own, and stands in full in the block's escape list.

A block holds whole documents, closed once it has `BLOCK_IDS` ids, and carries its own counts, checksum and the documents' lengths (Simple-8b too),
so blocks decode apart from each other, each with a few vector operations a selector. A file set is a Parquet folder with one row per
block: shard, block, ids before it in its shard, document ids, lengths and payload. Shards are ranges of the document id.

Edge cases: null and empty texts are the end id alone. Null ids come first. Rows with equal ids follow each other in the order of their texts. An
empty table is a folder without blocks. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemark.llm.common import texts
from tracemark.llm.tokens import default_tokenizer, encoded

BLOCK_IDS = 32_768
END_ID = 0
#: Values per word and bits per value, by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = (1 << 60) - 1
_HEAD = struct.Struct("<4sIIII")
_MAGIC = b"S8B1"
BLOCKS = "shard int, block int, before long, n_ids long, doc_ids array<long>, lengths binary, payload binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers below 2^64 to a self-contained block."""
    values = values.astype(np.uint64)
    n = len(values)
    large = values >= ESCAPE
    escapes = values[large]
    padded = np.zeros(n + 240, np.uint64)
    padded[:n] = np.where(large, np.uint64(ESCAPE), values)
    chosen = np.full(n, len(SELECTORS) - 1, np.uint8)
    open_ = np.ones(n, bool)
    for s, (count, bits) in enumerate(SELECTORS[:-1]):
        wide = np.cumsum(padded >> np.uint64(bits) != 0, dtype=np.int64) if bits else np.cumsum(padded != 0, dtype=np.int64)
        before = np.concatenate([[0], wide[: n - 1]]) if n else wide[:0]
        fits = open_ & (wide[count - 1 : count - 1 + n] == before)
        chosen[fits] = s
        open_ &= ~fits
    at, places, step = 0, [], [count for count, _ in SELECTORS]
    pick = chosen.tobytes()
    while at < n:
        places.append(at)
        at += step[pick[at]]
    places = np.array(places, np.int64)
    used = chosen[places] if n else chosen
    words = used.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        if not bits:
            continue
        mine = np.flatnonzero(used == s)
        for j in range(count if len(mine) else 0):
            words[mine] |= padded[places[mine] + j] << np.uint64(j * bits)
    body = words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()
    return _HEAD.pack(_MAGIC, n, len(words), len(escapes), zlib.crc32(body)) + body


def unpack(block: bytes) -> np.ndarray:
    """The integers of a block."""
    magic, n, n_words, n_escapes, crc = _HEAD.unpack_from(block)
    if magic != _MAGIC or len(block) != _HEAD.size + 8 * (n_words + n_escapes) or zlib.crc32(memoryview(block)[_HEAD.size :]) != crc:
        raise ValueError("damaged block")
    words = np.frombuffer(block, "<u8", n_words, _HEAD.size)
    used = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[used]
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1] if n else 0, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(used == s) if bits else ()
        if not len(mine):
            continue
        at, mask = ends[mine] - count, np.uint64((1 << bits) - 1)
        for j in range(count):
            out[at + j] = (words[mine] >> np.uint64(j * bits)) & mask
    out = out[:n]
    if n_escapes:
        out[out == ESCAPE] = np.frombuffer(block, "<u8", n_escapes, _HEAD.size + 8 * n_words)
    return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Encode all texts and write them to `path` in ascending order of `doc_id`."""
    tokenizer = tokenizer or default_tokenizer()
    ordered = texts(docs).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        block, before, ids, parts, sizes, shard = 0, 0, [], [], [], 0

        def close():
            flat = np.concatenate(parts)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "before": before, "n_ids": len(flat), "doc_ids": ids, "lengths": pack(np.array(sizes)), "payload": pack(flat)}],
                schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                                  ("lengths", pa.binary()), ("payload", pa.binary())]))

        held = 0
        for part, flat, bounds in encoded(batches, tokenizer):
            shard = part.column("shard")[0].as_py()
            for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                mine = flat[bounds[i] : bounds[i + 1]]
                ids.append(doc_id)
                parts += [mine, np.array([END_ID], np.uint32)]
                sizes.append(len(mine) + 1)
                held += len(mine) + 1
                if held >= BLOCK_IDS:
                    yield close()
                    block, before, held, ids, parts, sizes = block + 1, before + held, 0, [], [], []
        if ids:
            yield close()

    ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(run, BLOCKS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files `doc_id`, `start` (ids of all documents before it) and its `ids` as little-endian unsigned 32-bit integers."""
    return _documents(spark, path, digest=False)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and `ids_crc32` per document, decoded from the files."""
    return _documents(spark, path, digest=True)


def _documents(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per shard, as many as the writer had tasks
    offsets = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    rows = blocks.join(F.broadcast(offsets), "shard").select((F.col("shard_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")
    schema = "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids binary")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                start, doc_ids, lengths, payload = (batch.column(i)[row].as_py() for i in range(4))
                sizes = unpack(lengths).astype(np.int64)
                flat = memoryview(unpack(payload).astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                texts_ = [flat[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
                last = [pa.array(sizes), pa.array([zlib.crc32(x) for x in texts_], pa.int64())] if digest else [pa.array([bytes(x) for x in texts_], pa.binary())]
                names = ["n_tokens", "ids_crc32"] if digest else ["ids"]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), *last], ["doc_id", "start", *names])

    return rows.mapInArrow(run, schema)
