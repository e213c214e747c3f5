"""Column builders for digests, fingerprint distances and similarity scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemark.functions.minima import fingerprints

HASH_CHARS = 16

# Largest character distance that still counts as a duplicate, and the order in which
# fingerprint types are compared (an earlier type wins a tie).
DEFAULT_THRESHOLDS = {"dhash": 5, "ahash": 8, "phash": 10, "whash": 8}

# One set bit per hex digit of a packed 64-bit hash.
_DIGIT_BITS = 0x1111111111111111


def digest(content: Column, algorithm: str) -> Column:
    """Hex digest of a binary or string column."""
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm == "sha256":
        return F.sha2(content, 256)
    if algorithm == "sha512":
        return F.sha2(content, 512)
    if algorithm == "crc32":
        return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")
    raise ValueError(f"unknown digest {algorithm}")


def pack(hex_hash: Column) -> Column:
    """Sixteen hex digits as one signed 64-bit integer."""
    return F.conv(hex_hash, 16, -10).cast("bigint")


def bit_distance(a: Column, b: Column) -> Column:
    """Differing bits of two packed hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def differing_digits(a: Column, b: Column) -> Column:
    """Packed mask with one bit for each hex digit in which the hashes differ."""
    x = a.bitwiseXOR(b)
    folded = x
    for n in (1, 2, 3):
        folded = folded.bitwiseOR(F.shiftrightunsigned(x, n))
    return folded.bitwiseAND(F.lit(_DIGIT_BITS))


def digit_distance(a: Column, b: Column) -> Column:
    """Differing hex digits of two packed hashes."""
    return F.bit_count(differing_digits(a, b))


def char_distance(a: Column, b: Column) -> Column:
    """Differing characters of two strings of any equal length; NULL when the lengths differ."""
    flags = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(flags, F.lit(0), lambda acc, v: acc + v))


def similarity(distance: Column, length: Column | int = HASH_CHARS) -> Column:
    """Score in [0, 1] of a distance between hashes of `length` hex characters, four bits each."""
    size = F.lit(length) if isinstance(length, int) else length
    return F.coalesce(1.0 - F.try_divide(distance.cast("double"), size * 4), F.lit(0.0))


def confidence_tier(distance: Column) -> Column:
    return F.when(distance <= 2, "high").when(distance <= 5, "medium").otherwise("low")


def bit_threshold(min_similarity: Column | float) -> Column:
    """Largest bit distance whose 64-bit similarity reaches `min_similarity`."""
    s = F.lit(min_similarity) if isinstance(min_similarity, float) else min_similarity
    return F.floor((1.0 - s) * 64).cast("int")


def cache_key(*parts: Column) -> Column:
    """md5 of the arguments joined by a vertical bar; a missing argument reads `None`."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def expires_at(stored: Column, hours: int = 24) -> Column:
    return stored + F.make_interval(hours=F.lit(hours))


def word_fingerprints(words: Column, offsets: dict[str, tuple[int, ...]]) -> Column:
    """Struct of sixteen-digit similarity fingerprints of a word list, a field for the shingles at each entry's offsets (`text.shingles`).

    The first digit of a feature's md5 picks one of sixteen slots and the smallest digest of a slot gives, with its last digit, the
    slot's digit. An empty slot takes a digit of the overall smallest digest, so that tiny inputs keep distinct
    fingerprints. The digests of an Arrow batch are computed together: built-in string functions took many times as long.
    """

    def run(column: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([fingerprints(column, o) for o in offsets.values()], names=list(offsets))

    return F.arrow_udf(run, ", ".join(f"{name} string" for name in offsets))(words)


def word_fingerprint(words: Column, offsets: tuple[int, ...]) -> Column:
    """One fingerprint of `word_fingerprints`."""
    return word_fingerprints(words, {"h": offsets})["h"]
