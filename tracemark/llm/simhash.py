"""SimHash fingerprints of 128 bits and the search for fingerprints within a Hamming radius.

Terms are the lower-cased words and pairs of neighbouring words of a text, pairs with `PAIR_WEIGHT` times the weight (they tell word orders apart; the
more they weigh, the more bits one changed word moves). Each term's hash votes with its weight
for or against every bit; the majority decides, ties go to 0. The share of unequal bits estimates the angle between the
texts' term vectors, and `likeness` is the cosine of that angle, 0 at the least.

The search cuts fingerprints into m blocks. Of a pair within radius r some choice of t blocks differs in few bits, in none if t = m - r, so one table per
choice, keyed by the bits of its blocks brought to the front, finds everything when a query asks for all keys within those few bits of its own. m and t are picked by cost.
Equal fingerprints are one row in the tables, and a pair found by several tables is counted in the first only.

`RADIUS` comes from measured distances: of edited copies of the texts of the tables (words replaced, dropped, inserted, the end cut) that keep a shingle
similarity of 0.75 or more, 95 % lie within it.

Edge cases: null and empty texts, and texts without a word, have fingerprint 0; equal texts have equal fingerprints. Null ids come last in the descending order, rows
with equal ids in the order of their texts. With one document it is its own next one. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemark.llm.common import LOWER, mix, slices, span_hashes, texts, utf8, words
from tracemark.session import materialise

BITS = 128
PAIR_WEIGHT = 0.5
RADIUS = 12
#: Most keys that one query asks for.
MOST_KEYS = 20_000
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints(column: pa.Array) -> np.ndarray:
    """Two 64-bit words per row."""
    n = len(column)
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    pair = np.flatnonzero(row[1:] == row[:-1])
    pairs = mix(hashes[pair] * np.uint64(0xD6E8FEB86659FD93) + hashes[pair + 1])
    rows = np.concatenate([row, row[pair]])
    terms = np.concatenate([hashes, pairs])
    weight = np.concatenate([np.ones(len(hashes)), np.full(len(pairs), PAIR_WEIGHT)])
    total = np.bincount(rows, weight, n)[:, None]
    halves = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        by_byte = mix(terms ^ np.uint64(salt)).astype(">u8").view(np.uint8).reshape(-1, 8)
        votes = [np.bincount(rows * 256 + by_byte[:, b], weight, n * 256).reshape(n, 256) @ _BIT_OF_BYTE for b in range(8)]
        on = (2 * np.concatenate(votes, axis=1) > total) & (total > 0)
        halves.append(np.packbits(on, axis=1).view(">u8").astype(np.uint64)[:, 0])
    return np.stack(halves, axis=1)


def hamming(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Estimated cosine of two fingerprints, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(math.pi / BITS) * hamming(a, b)))


def text_of(a: tuple[str, str]) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(F.col(c)), 16, "0")) for c in a))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """`doc_id` and the words `hi`, `lo` of each text's fingerprint."""

    def run(batches):
        for part in slices(batches, "text", 1 << 19):
            fp = fingerprints(part.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.ascontiguousarray(fp[:, 0])), pa.array(np.ascontiguousarray(fp[:, 1]))], ["doc_id", "hi", "lo"])

    return texts(docs).mapInArrow(run, "doc_id long, hi long, lo long")


_COMPARED = ("shard int, kind int, doc_id long, text string, n_chars long, edited_sha256 string, hi long, lo long, edited_hi long, edited_lo long, next_hi long, next_lo long")
_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                     *((c, pa.int64()) for c in ("hi", "lo", "edited_hi", "edited_lo", "next_hi", "next_lo"))])
_DONE, _HEAD, _TAIL = 0, 1, 2


def edit(text: str, following: str) -> str:
    """The last third of the code points gives way to as many of the next text's first."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compared(shard: int, doc_ids: list, body: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edit(t, f) for t, f in zip(body, following)]
    own, edited, after = (fingerprints(pa.array(x, pa.string())).view(np.int64) for x in (body, changed, following))
    n = len(body)
    columns = [pa.array([shard] * n, pa.int32()), pa.array([_DONE] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.nulls(n, pa.string()), pa.array(map(len, body), pa.int64()),
               pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed])]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(x[:, k])) for x in (own, edited, after) for k in (0, 1))], schema=_SCHEMA)


def _border(shard: int, kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    row = {"shard": shard, "kind": kind, "doc_id": doc_id, "text": text}
    return pa.RecordBatch.from_pylist([{**dict.fromkeys(_SCHEMA.names), **row}], schema=_SCHEMA)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Per document, in descending order of the id, its fingerprint, that of its edited text and that of the next document.

    Texts are ranged by id once; a task compares neighbours as they stream by. Its first and last row go out as they are, and the last row of each range
    then meets the first one of the next, one row per task.
    """
    order = F.col("doc_id").desc_nulls_last()
    ordered = texts(docs).repartitionByRange(order).sortWithinPartitions(order, "text").withColumn("shard", F.spark_partition_id())

    def run(batches):
        last, shard = None, 0
        for part in slices(batches, "text", 1 << 19):
            shard = part.column("shard")[0].as_py()
            ids, body = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            if last is None:
                yield _border(shard, _HEAD, ids[0], body[0])
            else:
                ids, body = [last[0], *ids], [last[1], *body]
            last = ids[-1], body[-1]
            if len(ids) > 1:
                yield _compared(shard, ids[:-1], body[:-1], body[1:])
        if last is not None:
            yield _border(shard, _TAIL, *last)

    stored = materialise(ordered.mapInArrow(run, _COMPARED), "compared")
    heads = stored.where(f"kind = {_HEAD}").select("shard", F.col("text").alias("following"))
    everything = Window.orderBy("shard")  # one row per task of the step before
    follows = heads.select("shard").select("shard", F.coalesce(F.lead("shard").over(everything), F.first("shard").over(everything)).alias("next_shard"))
    tails = stored.where(f"kind = {_TAIL}").select("shard", "doc_id", "text")
    pairs = tails.join(F.broadcast(follows), "shard").join(heads.withColumnRenamed("shard", "next_shard"), "next_shard").select("shard", "doc_id", "text", "following")

    def close(batches):
        for part in slices(batches, "text", 1 << 19):
            yield _compared(0, part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("following").to_pylist())

    wanted = [c for c in _SCHEMA.names if c not in ("shard", "kind", "text")]
    return stored.where(f"kind = {_DONE}").select(*wanted).unionByName(pairs.mapInArrow(close, _COMPARED).select(*wanted))


@dataclass(frozen=True)
class Table:
    """One table: the bits of its blocks, and how many of them may differ."""

    bits: tuple[int, ...]
    differ: int

    @property
    def masks(self) -> tuple[int, int]:
        return _words(self.bits)

    @property
    def flips(self) -> list[tuple[int, int]]:
        """What to flip in the two words of a query, one entry per key that it asks for."""
        return [_words(places) for n in range(self.differ + 1) for places in itertools.combinations(self.bits, n)]

    @property
    def keys(self) -> int:
        return sum(math.comb(len(self.bits), n) for n in range(self.differ + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _words(places) -> tuple[int, int]:
    """The `hi` and `lo` words with these bits (0 to 63 in `hi`) set."""
    return tuple(_signed(sum(1 << (p - base) for p in places if base <= p < base + 64)) for base in (0, 64))


def block_plan(rows: int, queries: int, radius: int) -> list[Table]:
    """The cheapest tables that miss no pair within the radius: cost is the keys stored and asked for, plus the pairs that meet by chance at a tenth each."""
    plans = []
    for m in range(1, 2 * radius + 3):
        cuts = [BITS * i // m for i in range(m + 1)]
        blocks = [tuple(range(a, b)) for a, b in zip(cuts, cuts[1:])]
        least, more = divmod(radius, m)
        for t in range(1, m + 1):
            if math.comb(m, t) > 64:
                continue
            # bits spread evenly are the worst case: `more` blocks have one more than the others
            differ = t * least + max(0, t - (m - more))
            choices = itertools.combinations(range(m), t)
            # of single blocks, some of the first `more` + 1 keeps within `least` bits or some other one within one bit less
            allowed = [(c, differ if t > 1 else least if c[0] <= more else least - 1) for c in choices]
            tables = [Table(tuple(b for i in c for b in blocks[i]), d) for c, d in allowed if d >= 0]
            if sum(x.keys for x in tables) <= MOST_KEYS:
                met = sum(x.keys / 2.0 ** len(x.bits) for x in tables) * rows * queries
                plans.append((rows * len(tables) + queries * sum(x.keys for x in tables) + met / 10, m, t, tables))
    return min(plans, key=lambda p: p[:3])[3]


def near_counts(queries: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`hi`, `lo` of each distinct query fingerprint and `n_near`, how many `rows` have a fingerprint within the radius."""
    stored = materialise(rows.groupBy("hi", "lo").agg(F.count("*").alias("n")), "fingerprints")
    asked = materialise(queries.select("hi", "lo").distinct(), "queries")
    plan = block_plan(stored.count(), asked.count(), radius)

    def own(table: Table) -> list[Column]:
        return [F.col(c).bitwiseAND(F.lit(mask)) for c, mask in zip(("hi", "lo"), table.masks)]

    def wanted(t: int, table: Table) -> Column:
        flips = np.array(table.flips, np.int64).reshape(-1, 2)
        hi, lo = own(table)
        keys = F.zip_with(F.lit(flips[:, 0].copy()), F.lit(flips[:, 1].copy()), lambda x, y: F.struct(x.bitwiseXOR(hi).alias("k_hi"), y.bitwiseXOR(lo).alias("k_lo")))
        return F.struct(F.lit(t).alias("t"), keys.alias("keys"))

    listed = F.array(*(F.struct(F.lit(t).alias("t"), *(c.alias(k) for c, k in zip(own(x), ("k_hi", "k_lo")))) for t, x in enumerate(plan)))
    kept = stored.select("hi", "lo", "n", F.explode(listed).alias("at")).select("hi", "lo", "n", "at.*")
    probes = asked.select("hi", "lo", F.explode(F.array(*(wanted(t, x) for t, x in enumerate(plan)))).alias("at"))
    probes = probes.select("hi", "lo", "at.t", F.explode("at.keys").alias("key")).select("hi", "lo", "t", "key.*")
    # keys multiply the rows, which a broadcast chosen by the size before would not see
    a, b = probes.hint("merge").alias("q"), kept.alias("r")
    unequal = [F.col(f"q.{c}").bitwiseXOR(F.col(f"r.{c}")) for c in ("hi", "lo")]
    bits = lambda masks: F.bit_count(unequal[0].bitwiseAND(F.lit(masks[0]))) + F.bit_count(unequal[1].bitwiseAND(F.lit(masks[1])))
    met = bits((-1, -1)) <= radius
    for t, x in enumerate(plan[:-1]):  # the first table that finds the pair
        met &= (F.col("q.t") <= t) | (bits(x.masks) > x.differ)
    for c in ("t", "k_hi", "k_lo"):
        met &= F.col(f"q.{c}") == F.col(f"r.{c}")
    return a.join(b, met).groupBy(F.col("q.hi").alias("hi"), F.col("q.lo").alias("lo")).agg(F.sum("r.n").alias("n_near"))
