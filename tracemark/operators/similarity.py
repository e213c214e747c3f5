"""Duplicate search over fingerprint tables.

Copies are never paired with each other: files with the same fingerprints form one class, named by its
smallest file id, and only classes meet in the pair search. The class table keeps every file, so pair
counts of files follow from the class sizes, and a group of copies costs as many rows as it has members.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.functions import hashing
from tracemark.operators.blocking import near_pairs
from tracemark.operators.cells import all_near_pairs
from tracemark.session import materialise

FINGERPRINTS = tuple(hashing.DEFAULT_THRESHOLDS)


def exact_copies(hashes: DataFrame, hash_type: str = "sha256") -> DataFrame:
    """Files whose digest occurs more than once, each with the first file of its group and the group size."""
    typed = hashes.filter(F.col("hash_type") == hash_type).select("file_id", "hash_value")
    groups = typed.groupBy("hash_value").agg(F.min("file_id").alias("original_id"), F.count("*").alias("copies"))
    repeated = materialise(groups.filter(F.col("copies") > 1), "copies")
    return typed.join(repeated, "hash_value").select("file_id", "original_id", "copies", "hash_value")


def exact_matches(hashes: DataFrame, probes: DataFrame, hash_type: str = "sha256") -> DataFrame:
    """Files that hold the same digest as a probe file, the probe itself left out: score 1, distance 0.

    One row per probe and digest group: the group is named by its first file and carries the number of
    matching files, so that popular content costs one row per probe.
    """
    typed = hashes.filter(F.col("hash_type") == hash_type).select("file_id", "hash_value")
    groups = typed.groupBy("hash_value").agg(F.min("file_id").alias("first_id"), F.count("*").alias("copies"))
    asked = typed.join(probes.select("file_id").distinct(), "file_id", "left_semi")
    return asked.join(materialise(groups.filter(F.col("copies") > 1), "copies"), "hash_value").select(
        F.col("file_id").alias("probe_id"),
        "first_id",
        (F.col("copies") - 1).alias("matches"),
        F.lit(1.0).alias("similarity"),
        F.lit(0).alias("distance"),
    )


def similar_to_hash(wide: DataFrame, target: str, hash_type: str, threshold: int = 5, unit: str = "char",
                    include_identical: bool = True) -> DataFrame:
    """Rows within `threshold` of one hash, nearest first: a single filter over the table."""
    stored = F.col(hash_type)
    if unit == "bit":
        distance = hashing.bit_distance(hashing.pack(stored), hashing.pack(F.lit(target)))
    else:
        distance = hashing.char_distance(stored, F.lit(target))
    hits = wide.withColumn("distance", distance).filter(F.col("distance") <= threshold)
    if not include_identical:
        hits = hits.filter(stored != target)
    return hits.orderBy("distance", "file_id")


def similar_by_bits(hashes: DataFrame, probes: DataFrame, rows: int, threshold: int = 5,
                    include_identical: bool = True) -> DataFrame:
    """Stored hashes within `threshold` bits of probe hashes; both sides (id, h) with packed distinct hashes."""
    pairs = near_pairs(hashes, threshold, rows, probes=probes, unit="bit")
    if not include_identical:
        pairs = pairs.filter(F.col("distance") > 0)
    return pairs.select(
        F.col("a").alias("probe_id"), F.col("b").alias("match_id"), "distance", hashing.similarity(F.col("distance")).alias("similarity"))


def distinct_hashes(wide: DataFrame, hash_type: str) -> DataFrame:
    """Distinct values of one fingerprint: (id, h, copies) with id the smallest file id."""
    return wide.groupBy(hashing.pack(F.col(hash_type)).alias("h")).agg(
        F.min("file_id").alias("id"), F.count("*").alias("copies")
    )


def fingerprint_classes(wide: DataFrame) -> DataFrame:
    """Distinct fingerprint quadruples with packed hashes, class id and number of files."""
    packed = wide.select("file_id", *[hashing.pack(F.col(t)).alias(t) for t in FINGERPRINTS])
    return packed.groupBy(*FINGERPRINTS).agg(F.min("file_id").alias("class_id"), F.count("*").alias("copies"))


def class_members(wide: DataFrame) -> DataFrame:
    """Every file with the class it belongs to."""
    first = wide.groupBy(*FINGERPRINTS).agg(F.min("file_id").alias("class_id"), F.count("*").alias("copies"))
    return wide.join(materialise(first, "classes"), list(FINGERPRINTS)).select("file_id", "class_id", "copies")


def best_pairs(classes: DataFrame, rows: int, thresholds: dict[str, int] | None = None, unit: str = "bit") -> DataFrame:
    """Pairs of fingerprint classes within the limit of some fingerprint type, with the nearest type and the numbers of files.

    Limits and distances are bits, or hex digits with `unit` char. Ties go to the earlier type of `FINGERPRINTS`. Classes that share a value are at distance 0.
    """
    limits = thresholds or hashing.DEFAULT_THRESHOLDS
    pairs = all_near_pairs(classes.withColumnRenamed("class_id", "id"), {t: limits[t] for t in FINGERPRINTS}, rows, unit)
    names = F.array(*[F.lit(t) for t in FINGERPRINTS])
    distance = F.col("distance")
    return pairs.select(
        "a", "b", F.get(names, F.col("type")).alias("hash_type"), distance.alias("distance"),
        hashing.similarity(distance).alias("similarity"), hashing.confidence_tier(distance).alias("confidence"), "copies_a", "copies_b",
    )


def all_duplicates(wide: DataFrame, rows: int, thresholds: dict[str, int] | None = None, unit: str = "bit") -> DataFrame:
    """All near-duplicate pairs between fingerprint classes, with the number of files on each side."""
    return best_pairs(materialise(fingerprint_classes(wide), "classes"), rows, thresholds, unit)


def duplicate_breakdown(wide: DataFrame, rows: int, unit: str = "bit") -> DataFrame:
    """Pairs of files per confidence tier and fingerprint type, tiers without pairs included.

    Copies inside a class match in every type at distance 0 and count as first-type, high-confidence pairs.
    """
    classes = materialise(fingerprint_classes(wide), "classes")
    between = best_pairs(classes, rows, unit=unit).select(
        "confidence", "hash_type", (F.col("copies_a") * F.col("copies_b")).alias("pairs")
    )
    n = F.col("copies")
    within = classes.filter(n > 1).select(
        F.lit("high").alias("confidence"), F.lit(FINGERPRINTS[0]).alias("hash_type"),
        F.floor(n * (n - 1) / 2).alias("pairs"),
    )
    spark = wide.sparkSession
    grid = spark.createDataFrame(
        [(c, t, 0) for c in ("high", "medium", "low") for t in FINGERPRINTS], "confidence string, hash_type string, pairs long"
    )
    return between.unionByName(within).unionByName(grid).groupBy("confidence", "hash_type").agg(F.sum("pairs").alias("pairs"))


def similar_pairs_per_type(wide: DataFrame, rows: int, min_similarity: float = 0.8,
                           types: tuple[str, ...] = ("phash", "ahash", "dhash"), unit: str = "bit") -> DataFrame:
    """Ordered pairs of distinct hash values per type whose similarity reaches the limit, both directions.

    The score divides a distance in bits by the number of bits. With `unit` char it divides a distance in digits by
    the number of bits all the same, so a similarity of 0.8 allows 12 of 16 digits.
    """
    limit = int((1 - min_similarity) * 4 * hashing.HASH_CHARS + 1e-9)
    found = []
    for hash_type in types:
        sized = all_near_pairs(distinct_hashes(wide, hash_type), {"h": limit}, rows, unit)
        score = hashing.similarity(F.col("distance")).alias("similarity")
        both = F.explode(F.array(
            F.struct(F.col("a").alias("file_a"), F.col("b").alias("file_b"), F.col("copies_a"), F.col("copies_b")),
            F.struct(F.col("b").alias("file_a"), F.col("a").alias("file_b"), F.col("copies_b").alias("copies_a"),
                     F.col("copies_a").alias("copies_b")),
        )).alias("p")
        found.append(sized.select(F.lit(hash_type).alias("hash_type"), score, both).select("hash_type", "similarity", "p.*"))
    return reduce(DataFrame.unionByName, found)


def pair_score(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Mean bit similarity over the fingerprints present on both sides, 0 when there is none."""
    parts = F.array_compact(F.array(*[
        1 - hashing.bit_distance(hashing.pack(left[t]), hashing.pack(right[t])) / 64.0 for t in left
    ]))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(total, F.size(parts)), F.lit(0.0))


def score_requests(requests: DataFrame, wide: DataFrame, cached: DataFrame) -> DataFrame:
    """Answer (file1_id, file2_id) requests from a score cache in either orientation, compute the rest.

    `cached` is keyed by the unordered pair (low, high). The result says where each score came from and
    `cached = false` rows are what has to be stored.
    """
    keyed = requests.select(
        "file1_id", "file2_id",
        F.least("file1_id", "file2_id").alias("low"), F.greatest("file1_id", "file2_id").alias("high"),
    )
    known = cached.select("low", "high", F.col("similarity").alias("stored"))
    looked_up = keyed.join(known, ["low", "high"], "left")
    hits = looked_up.filter(F.col("stored").isNotNull()).select("file1_id", "file2_id", F.col("stored").alias("similarity"), F.lit(True).alias("cached"))
    misses = looked_up.filter(F.col("stored").isNull()).select("file1_id", "file2_id")
    side = lambda n: wide.select(F.col("file_id").alias(f"file{n}_id"), F.col("phash").alias(f"p{n}"), F.col("ahash").alias(f"a{n}"))
    fresh = misses.join(side(1), "file1_id", "left").join(side(2), "file2_id", "left").select(
        "file1_id", "file2_id",
        pair_score({"p": F.col("p1"), "a": F.col("a1")}, {"p": F.col("p2"), "a": F.col("a2")}).alias("similarity"),
        F.lit(False).alias("cached"),
    )
    return hits.unionByName(fresh)


def other_sides(comparisons: DataFrame, min_similarity: float = 0.5, comparison_type: str | None = None,
                algorithm: str | None = None) -> DataFrame:
    """Both readings of stored comparisons: for every file its similar files with their score."""
    kept = comparisons.filter(F.col("similarity_score") >= min_similarity)
    if comparison_type:
        kept = kept.filter(F.col("comparison_type") == comparison_type)
    if algorithm:
        kept = kept.filter(F.col("algorithm") == algorithm)
    turned = F.explode(F.array(
        F.struct(F.col("file1_id").alias("file_id"), F.col("file2_id").alias("similar_id")),
        F.struct(F.col("file2_id").alias("file_id"), F.col("file1_id").alias("similar_id")),
    )).alias("p")
    return kept.select(turned, "similarity_score", "comparison_type", "algorithm").select(
        "p.file_id", "p.similar_id", "similarity_score", "comparison_type", "algorithm"
    )


def attach_files(matches: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Add path, size and status of the matched file; matches of unknown files are dropped."""
    info = files.select(F.col("file_id").alias(key), "file_path", "file_size", "status")
    return matches.join(info, key)


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each unordered pair once, smaller id first, self-pairs removed."""
    ordered = pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    return ordered.distinct()
