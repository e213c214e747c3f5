"""Duplicate search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemark.functions import hashing
from tracemark.operators import similarity as sim
from tracemark.plans.registry import query
from tracemark.session import materialise

_CLASSES = """classes AS (SELECT dhash, ahash, phash, whash, min(file_id) AS class_id, count(*) AS copies
                          FROM media_hashes_wide GROUP BY ALL)"""
_BEST = """best AS (
    SELECT a, b, copies_a, copies_b, hash_type, distance FROM (
        SELECT a, b, copies_a, copies_b, hash_type, distance,
               row_number() OVER (PARTITION BY a, b ORDER BY distance, ord) AS rn
        FROM (SELECT a, b, copies_a, copies_b, unnest([
                  {'hash_type': 'dhash', 'distance': dd, 'ord': 0, 'lim': 5}, {'hash_type': 'ahash', 'distance': da, 'ord': 1, 'lim': 8},
                  {'hash_type': 'phash', 'distance': dp, 'ord': 2, 'lim': 10}, {'hash_type': 'whash', 'distance': dw, 'ord': 3, 'lim': 8}
              ], recursive := true) FROM pairs)
        WHERE distance <= lim) WHERE rn = 1)"""


def _rows(t):
    return t.read("documents").count()


@query("J01_exact_duplicates", """
    g AS (SELECT hash_value, min(file_id) AS original_id, count(*) AS copies FROM media_hashes
          WHERE hash_type = 'sha256' GROUP BY 1 HAVING count(*) > 1)
    SELECT m.file_id, g.original_id, g.copies, m.hash_value FROM media_hashes m JOIN g ON m.hash_value = g.hash_value
    WHERE m.hash_type = 'sha256'""", ("media_hashes",))
def exact_duplicates(t):
    return sim.exact_copies(t.crypto_hashes)


@query("J01_exact_matches_of_queue", """
    m AS (SELECT file_id, hash_value FROM media_hashes WHERE hash_type = 'sha256')
    SELECT p.file_id AS probe_id, min(o.file_id) AS first_id, count(*) - 1 AS matches, 1.0::DOUBLE AS similarity, 0 AS distance
    FROM m p JOIN m o ON p.hash_value = o.hash_value
    WHERE p.file_id IN (SELECT doc_id FROM labels) GROUP BY p.file_id HAVING count(*) > 1""", ("media_hashes",))
def exact_matches(t):
    queue = t.read("labels").select(F.col("doc_id").alias("file_id"))
    return sim.exact_matches(t.crypto_hashes, queue)


@query("J02_perceptual_matches_of_queue", """
    v AS (SELECT phash, min(file_id) AS id FROM media_hashes_wide GROUP BY 1),
    q AS (SELECT phash, min(file_id) AS id FROM media_hashes_wide WHERE file_id IN (SELECT doc_id FROM labels) GROUP BY 1),
    d AS (SELECT q.id AS probe_id, v.id AS match_id,
                 bit_count(xor(('0x' || q.phash)::UBIGINT, ('0x' || v.phash)::UBIGINT)) AS distance FROM q, v)
    SELECT probe_id, match_id, distance, round(1 - distance / 64.0::DOUBLE, 6) AS similarity FROM d WHERE distance <= 12""",
    ("media_hashes_wide",))
def perceptual_matches(t):
    wide = t.fingerprints("phash")
    queue = wide.join(t.read("labels").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi")
    stored = sim.distinct_hashes(wide, "phash").select("id", "h")
    probes = sim.distinct_hashes(queue, "phash").select("id", "h")
    hits = sim.similar_by_bits(stored, probes, _rows(t), threshold=12)
    return hits.withColumn("similarity", F.round("similarity", 6))


@query("J03_similar_to_newest", """
    tgt AS (SELECT ahash FROM media_hashes_wide ORDER BY file_id DESC LIMIT 1)
    SELECT file_id, hamming(m.ahash, tgt.ahash) AS distance FROM media_hashes_wide m, tgt
    WHERE hamming(m.ahash, tgt.ahash) <= 12""", ("media_hashes_wide",))
def similar_to_newest(t):
    wide = t.fingerprints("ahash")
    target = wide.orderBy(F.desc("file_id")).first()["ahash"]
    return sim.similar_to_hash(wide, target, "ahash", threshold=12).select("file_id", "distance")


def _bits(hash_type: str, a: str = "x", b: str = "y") -> str:
    return f"bit_count(xor(('0x' || {a}.{hash_type})::UBIGINT, ('0x' || {b}.{hash_type})::UBIGINT))"


_BIT_DISTANCES = f"{_bits('dhash')} AS dd, {_bits('ahash')} AS da, {_bits('phash')} AS dp, {_bits('whash')} AS dw"
_DIGIT_DISTANCES = """hamming(x.dhash, y.dhash) AS dd, hamming(x.ahash, y.ahash) AS da,
                     hamming(x.phash, y.phash) AS dp, hamming(x.whash, y.whash) AS dw"""


def _all_pairs_sql(distances: str) -> str:
    return f"""
    {_CLASSES},
    pairs AS (SELECT x.class_id AS a, y.class_id AS b, x.copies AS copies_a, y.copies AS copies_b, {distances}
              FROM classes x JOIN classes y ON x.class_id < y.class_id),
    {_BEST}
    SELECT a, b, copies_a, copies_b, hash_type, distance, round(1 - distance / 64.0::DOUBLE, 6) AS similarity,
           CASE WHEN distance <= 2 THEN 'high' WHEN distance <= 5 THEN 'medium' ELSE 'low' END AS confidence
    FROM best"""


@query("J04_all_pairs_duplicates", _all_pairs_sql(_BIT_DISTANCES), ("media_hashes_wide",))
def all_pairs(t):
    pairs = sim.all_duplicates(t.media_hashes_wide, _rows(t))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("J04_all_pairs_by_digits", _all_pairs_sql(_DIGIT_DISTANCES), ("media_hashes_wide",))
def all_pairs_by_digits(t):
    pairs = sim.all_duplicates(t.media_hashes_wide, _rows(t), unit="char")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("J04_fingerprint_members", f"""
    {_CLASSES}
    SELECT file_id, class_id, copies FROM media_hashes_wide JOIN classes USING (dhash, ahash, phash, whash)""",
    ("media_hashes_wide",))
def members(t):
    return sim.class_members(t.media_hashes_wide)


def _pairs_per_type_sql(distance: str) -> str:
    return f"""
    v AS (SELECT hash_type, hash_value, min(file_id) AS id, count(*) AS copies FROM media_hashes
          WHERE hash_type IN ('phash', 'ahash', 'dhash') GROUP BY 1, 2)
    SELECT x.hash_type, x.id AS file_a, y.id AS file_b, x.copies AS copies_a, y.copies AS copies_b,
           round(1 - {distance} / 64.0::DOUBLE, 6) AS similarity
    FROM v x JOIN v y ON x.hash_type = y.hash_type AND x.id <> y.id
    WHERE 1 - {distance} / 64.0::DOUBLE >= 0.8"""


@query("J05_similar_pairs_per_type", _pairs_per_type_sql(_bits("hash_value")), ("media_hashes",))
def pairs_per_type(t):
    pairs = sim.similar_pairs_per_type(t.fingerprints("phash", "ahash", "dhash"), _rows(t))
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("J05_similar_pairs_by_digits", _pairs_per_type_sql("hamming(x.hash_value, y.hash_value)"), ("media_hashes",))
def pairs_by_digits(t):
    pairs = sim.similar_pairs_per_type(t.fingerprints("phash", "ahash", "dhash"), _rows(t), unit="char")
    return pairs.withColumn("similarity", F.round("similarity", 6))


_REQUESTS = """
    latest AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents),
    requests AS (SELECT doc_id AS file1_id, (doc_id * 7 + 3) % (hi + 1) AS file2_id FROM documents, latest)"""


def _requests(t):
    """Every file compared with one other file, spread over the whole table."""
    docs = t.read("documents").select("doc_id")
    top = docs.agg(F.max("doc_id")).first()[0]
    return docs.select(F.col("doc_id").alias("file1_id"), ((F.col("doc_id") * 7 + 3) % (top + 1)).alias("file2_id"))


_SCORE = """(64 - bit_count(xor(('0x' || x.phash)::UBIGINT, ('0x' || y.phash)::UBIGINT))
           + 64 - bit_count(xor(('0x' || x.ahash)::UBIGINT, ('0x' || y.ahash)::UBIGINT))) / 128.0::DOUBLE"""


@query("J06_pair_scores", f"""
    {_REQUESTS}
    SELECT file1_id, file2_id, round({_SCORE}, 6) AS similarity FROM requests
    JOIN media_hashes_wide x ON x.file_id = file1_id JOIN media_hashes_wide y ON y.file_id = file2_id""",
    ("media_hashes_wide",))
def pair_scores(t):
    wide = t.fingerprints("phash", "ahash")
    side = lambda n: wide.select(
        F.col("file_id").alias(f"file{n}_id"), F.col("phash").alias(f"p{n}"), F.col("ahash").alias(f"a{n}"))
    score = sim.pair_score({"p": F.col("p1"), "a": F.col("a1")}, {"p": F.col("p2"), "a": F.col("a2")})
    joined = _requests(t).join(side(1), "file1_id").join(side(2), "file2_id")
    return joined.select("file1_id", "file2_id", F.round(score, 6).alias("similarity"))


@query("J07_compare_with_cache", f"""
    {_REQUESTS},
    cache AS (SELECT least(user_id, event_id) AS low, greatest(user_id, event_id) AS high, max(value) / 500 AS similarity
              FROM events WHERE user_id <> event_id GROUP BY 1, 2)
    SELECT file1_id, file2_id, round(coalesce(c.similarity, {_SCORE}), 6) AS similarity, c.low IS NOT NULL AS cached
    FROM requests
    LEFT JOIN cache c ON c.low = least(file1_id, file2_id) AND c.high = greatest(file1_id, file2_id)
    JOIN media_hashes_wide x ON x.file_id = file1_id JOIN media_hashes_wide y ON y.file_id = file2_id""",
    ("media_hashes_wide",))
def compare_with_cache(t):
    e = t.read("events").filter("user_id <> event_id")
    cache = e.groupBy(F.least("user_id", "event_id").alias("low"), F.greatest("user_id", "event_id").alias("high")).agg(
        (F.max("value") / 500).alias("similarity"))
    answers = sim.score_requests(_requests(t), t.fingerprints("phash", "ahash"), materialise(cache, "scores"))
    return answers.withColumn("similarity", F.round("similarity", 6))


def _comparisons(t):
    """Stored comparisons: one row per event, between its user's file and the file it touched."""
    return t.events.select(
        F.col("user_id").alias("file1_id"), (F.col("event_id") + 1000).alias("file2_id"),
        F.col("event_type").alias("comparison_type"), (F.col("k") / 100.0).alias("similarity_score"),
        F.when(F.col("k") % 2 == 0, "phash").otherwise("ahash").alias("algorithm"),
    )


_COMPARISONS = """cmp AS (SELECT user_id AS file1_id, event_id + 1000 AS file2_id, event_type AS comparison_type,
    k / 100.0::DOUBLE AS similarity_score, CASE WHEN k % 2 = 0 THEN 'phash' ELSE 'ahash' END AS algorithm FROM ev)"""


@query("J08_similar_files", f"""
    {_COMPARISONS}
    SELECT file1_id AS file_id, file2_id AS similar_id, similarity_score, comparison_type, algorithm FROM cmp
    WHERE similarity_score >= 0.5 AND algorithm = 'phash'
    UNION ALL
    SELECT file2_id, file1_id, similarity_score, comparison_type, algorithm FROM cmp
    WHERE similarity_score >= 0.5 AND algorithm = 'phash'""", ("ev",))
def similar_files(t):
    return sim.other_sides(_comparisons(t), 0.5, algorithm="phash")


@query("J09_matches_with_files", f"""
    {_COMPARISONS},
    m AS (SELECT file1_id AS file_id, file2_id AS similar_id, similarity_score FROM cmp WHERE similarity_score >= 0.9
          UNION ALL SELECT file2_id, file1_id, similarity_score FROM cmp WHERE similarity_score >= 0.9)
    SELECT m.file_id, similar_id, similarity_score, f.file_path, f.file_size, f.status
    FROM m JOIN media_files f ON f.file_id = m.similar_id""", ("ev", "media_files"))
def matches_with_files(t):
    matches = sim.other_sides(_comparisons(t), 0.9).select("file_id", "similar_id", "similarity_score")
    return sim.attach_files(matches, t.media_files, "similar_id")


def _breakdown_sql(distances: str) -> str:
    return f"""
    pairs AS (SELECT x.file_id AS a, y.file_id AS b, 1 AS copies_a, 1 AS copies_b, {distances}
              FROM media_hashes_wide x JOIN media_hashes_wide y ON x.file_id < y.file_id),
    {_BEST},
    grid AS (SELECT * FROM (VALUES ('high'), ('medium'), ('low')) c(confidence),
                           (VALUES ('dhash'), ('ahash'), ('phash'), ('whash')) h(hash_type)),
    n AS (SELECT CASE WHEN distance <= 2 THEN 'high' WHEN distance <= 5 THEN 'medium' ELSE 'low' END AS confidence,
                 hash_type, count(*) AS pairs FROM best GROUP BY 1, 2)
    SELECT confidence, hash_type, CAST(coalesce(n.pairs, 0) AS BIGINT) AS pairs
    FROM grid LEFT JOIN n USING (confidence, hash_type)"""


@query("A07_duplicate_breakdown", _breakdown_sql(_BIT_DISTANCES), ("media_hashes_wide",))
def duplicate_breakdown(t):
    return sim.duplicate_breakdown(t.media_hashes_wide, _rows(t))


@query("A07_breakdown_by_digits", _breakdown_sql(_DIGIT_DISTANCES), ("media_hashes_wide",))
def breakdown_by_digits(t):
    return sim.duplicate_breakdown(t.media_hashes_wide, _rows(t), unit="char")


@query("U06_unordered_pairs", """
    SELECT DISTINCT least(user_id, k) AS low, greatest(user_id, k) AS high FROM ev WHERE user_id <> k""", ("ev",))
def unordered_pairs(t):
    return sim.canonical_pairs(t.events.select("user_id", F.col("k").cast("long").alias("k")), "user_id", "k")


@query("U07_hashes_of_file", """
    SELECT file_id, string_agg(hash_type || '=' || hash_value, ',' ORDER BY hash_type) AS hashes
    FROM media_hashes GROUP BY 1""", ("media_hashes",))
def hashes_of_file(t):
    grouped = t.media_hashes.groupBy("file_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("hash_type", "hash_value")))).alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return grouped.select("file_id", F.array_join(entries, ",").alias("hashes"))


@query("F02_F05_distance_functions", f"""
    {_REQUESTS}
    SELECT file1_id, file2_id, hamming(x.dhash, y.dhash) AS char_distance,
           bit_count(xor(('0x' || x.dhash)::UBIGINT, ('0x' || y.dhash)::UBIGINT)) AS bit_distance,
           round(1 - hamming(x.dhash, y.dhash) / 64.0::DOUBLE, 6) AS similarity,
           CASE WHEN hamming(x.dhash, y.dhash) <= 2 THEN 'high' WHEN hamming(x.dhash, y.dhash) <= 5 THEN 'medium' ELSE 'low' END AS tier
    FROM requests JOIN media_hashes_wide x ON x.file_id = file1_id JOIN media_hashes_wide y ON y.file_id = file2_id""",
    ("media_hashes_wide",))
def distance_functions(t):
    wide = t.fingerprints("dhash")
    side = lambda n: wide.select(F.col("file_id").alias(f"file{n}_id"), F.col("dhash").alias(f"h{n}"))
    joined = _requests(t).join(side(1), "file1_id").join(side(2), "file2_id")
    chars = hashing.char_distance(F.col("h1"), F.col("h2"))
    return joined.select(
        "file1_id", "file2_id", chars.alias("char_distance"),
        hashing.bit_distance(hashing.pack(F.col("h1")), hashing.pack(F.col("h2"))).alias("bit_distance"),
        F.round(hashing.similarity(chars, F.length("h1")), 6).alias("similarity"),
        hashing.confidence_tier(chars).alias("tier"),
    )
