import random

import pytest
from pyspark.sql import functions as F

from tracemark.functions import hashing
from tracemark.operators import similarity as sim
from tracemark.operators.blocking import BlockPlan, WordPlan, _runs, near_pairs, plan_blocks, plan_words

DIGITS = "0123456789abcdef"


def char_distance(a, b):
    return sum(x != y for x, y in zip(a, b))


def mutate(rng, h, n):
    h = list(h)
    for i in rng.sample(range(16), n):
        h[i] = rng.choice([c for c in DIGITS if c != h[i]])
    return "".join(h)


def hashes(seed=1, families=12, random_rows=60):
    """Random hashes, families of near copies, and one crowd of copies holding a third of all rows."""
    rng = random.Random(seed)
    rows = ["".join(rng.choices(DIGITS, k=16)) for _ in range(random_rows)]
    for _ in range(families):
        base = "".join(rng.choices(DIGITS, k=16))
        rows += [base] + [mutate(rng, base, n) for n in (1, 2, 4, 6, 8, 10, 12)]
    crowd = mutate(rng, rows[0], 3)
    rows += [mutate(rng, crowd, 1) for _ in range(len(rows) // 2)]
    return sorted(set(rows))


def frame(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id long, hex string")
    return df.select("id", hashing.pack(F.col("hex")).alias("h"))


@pytest.mark.parametrize("k", [0, 1, 2, 5, 8, 10, 12])
@pytest.mark.parametrize("rows,tile", [(100, 10**6), (10**9, 10**12), (10**6, 5)])
def test_near_pairs_equal_brute_force(spark, k, rows, tile):
    values = hashes()
    expected = {(a, b, char_distance(values[a], values[b])) for a in range(len(values)) for b in range(a + 1, len(values))
                if char_distance(values[a], values[b]) <= k}
    if rows == 10**9 and k > 5:
        rows = 10**4  # the plan for a billion rows explodes thousands of keys per hash
    found = [(r.a, r.b, r.distance) for r in near_pairs(frame(spark, values), k, rows, tile_rows=tile).collect()]
    assert len(found) == len(set(found))
    assert set(found) == expected


def test_probe_join_equals_brute_force(spark):
    values = hashes(3)
    stored, probes = frame(spark, values), frame(spark, values).filter("id % 3 = 0")
    expected = {(a, b) for a in range(0, len(values), 3) for b in range(len(values)) if char_distance(values[a], values[b]) <= 5}
    for rows, tile in ((100, 10**6), (10**6, 4)):
        found = [(r.a, r.b) for r in near_pairs(stored, 5, rows, probes=probes, tile_rows=tile).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def bit_distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def flipped(rng, h, n):
    return f"{int(h, 16) ^ sum(1 << i for i in rng.sample(range(64), n)):016x}"


def bit_families(seed):
    rng = random.Random(seed)
    rows = ["".join(rng.choices(DIGITS, k=16)) for _ in range(40)]
    for base in rows[:12]:
        rows += [flipped(rng, base, n) for n in (1, 2, 4, 5, 8, 9, 10, 12, 13)]
    crowd = flipped(rng, rows[0], 3)
    return sorted(set(rows + [flipped(rng, crowd, 1) for _ in range(60)] + ["0" * 16, "f" * 16]))


@pytest.mark.parametrize("k", [0, 1, 3, 5, 8, 10, 12])
@pytest.mark.parametrize("rows,tile", [(100, 10**6), (10**6, 5), (10**4, 10**12)])
def test_pairs_by_bits_equal_brute_force(spark, k, rows, tile):
    values = bit_families(2)
    expected = {(a, b, bit_distance(values[a], values[b])) for a in range(len(values)) for b in range(a + 1, len(values)) if bit_distance(values[a], values[b]) <= k}
    found = [(r.a, r.b, r.distance) for r in near_pairs(frame(spark, values), k, rows, tile_rows=tile, unit="bit").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_probes_by_bits_equal_brute_force(spark):
    values = bit_families(5)
    stored, probes = frame(spark, values), frame(spark, values).filter("id % 3 = 0")
    expected = {(a, b) for a in range(0, len(values), 3) for b in range(len(values)) if bit_distance(values[a], values[b]) <= 6}
    for rows, tile, probe_rows in ((100, 10**6, None), (10**6, 4, None), (10**6, 4, 10)):
        found = [(r.a, r.b) for r in near_pairs(stored, 6, rows, probes=probes, tile_rows=tile, probe_rows=probe_rows, unit="bit").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_every_pair_within_bits_is_near_in_a_word():
    rng = random.Random(8)
    for k in range(0, 20):
        for words in range(1, 17):
            plan = WordPlan(k, words)
            assert sum(width for _, width in plan.bounds) == 64
            for _ in range(30):
                x = sum(1 << i for i in rng.sample(range(64), k))
                assert any((x >> low & (1 << width) - 1).bit_count() <= radius for (low, width), radius in zip(plan.bounds, plan.radii))
    assert plan_words(10, 10**4).words > plan_words(10, 10**9).words
    with pytest.raises(ValueError):
        plan_words(64, 10)


def test_classes_that_share_a_value_are_paired(spark):
    z = "0" * 16
    rows = [(1, z, "1" * 16, "f" * 16, "f" * 16), (2, z, "e" * 16, "0f" * 8, "1" * 16), (3, "f" * 16, "7" * 16, "c3" * 8, "3c" * 8)]
    found = [(r.a, r.b, r.hash_type, r.distance, r.copies_a, r.copies_b) for r in sim.all_duplicates(wide(spark, rows), 3).collect()]
    assert found == [(1, 2, "dhash", 0, 1, 1)]


def test_larger_tables_get_more_selective_plans():
    small, large = plan_blocks(5, 10**4), plan_blocks(5, 10**10)
    assert small.subset < large.subset
    for k in range(16):
        plan = plan_blocks(k, 10**6)
        assert plan.subset >= 1 and sum(len(r) for r in plan.runs) == 16
    with pytest.raises(ValueError):
        plan_blocks(16, 10)


def test_every_pair_within_limit_shares_a_key():
    rng = random.Random(5)
    for k in (2, 5, 8, 10, 12):
        for count in range(1, 16 - k + 1):
            plan = BlockPlan(k, _runs(count), -(-(16 - k) // count))
            if not plan.keys:
                continue
            for _ in range(50):
                same = set(rng.sample(range(16), 16 - k))
                assert any(set(s) <= same for _, s in plan.keys)


def wide(spark, rows):
    return spark.createDataFrame(rows, "file_id long, dhash string, ahash string, phash string, whash string")


def test_all_duplicates_collapse_copies_and_keep_the_nearest_type(spark):
    z, y = "0" * 16, "f" * 16
    rows = [(i, z, z, z, z) for i in range(50)]
    rows += [(100, "1" + "0" * 15, "11" + "0" * 14, z, z), (101, y, "1" * 6 + "0" * 10, "2" * 7 + "0" * 9, "3" * 6 + "0" * 10), (102, y, y, y, y)]
    df = wide(spark, rows)
    found = {(r.a, r.b): (r.hash_type, r.distance, r.confidence, r.copies_a) for r in sim.all_duplicates(df, 53, unit="char").collect()}
    assert found[(0, 100)] == ("phash", 0, "high", 50)
    assert found[(0, 101)] == ("ahash", 6, "low", 50)
    assert found[(101, 102)][0] == "dhash"
    breakdown = {(r.confidence, r.hash_type): r.pairs for r in sim.duplicate_breakdown(df, 53, unit="char").collect()}
    assert breakdown[("high", "dhash")] == 50 * 49 // 2 + 1 and breakdown[("high", "phash")] == 50
    assert len(breakdown) == 12


def test_lookup_by_hash(spark):
    rows = [(1, "1" * 16), (2, "1" * 15 + "0"), (3, "a" * 16), (4, "1" * 8)]
    df = spark.createDataFrame(rows, "file_id long, dhash string")
    assert [r.file_id for r in sim.similar_to_hash(df, "1" * 16, "dhash", 5).collect()] == [1, 2]
    assert [r.file_id for r in sim.similar_to_hash(df, "1" * 16, "dhash", 5, include_identical=False).collect()] == [2]
    assert [(r.file_id, r.distance) for r in sim.similar_to_hash(df.filter("file_id < 4"), "1" * 16, "dhash", 5, unit="bit").collect()] == [(1, 0), (2, 1)]


def test_distances_and_scores(spark):
    rows = [("a" * 16, "a" * 16), ("a" * 16, "b" * 16), ("a" * 16, "a" * 15 + "b"), ("a" * 16, "a" * 8)]
    df = spark.createDataFrame(rows, "a string, b string")
    d = hashing.char_distance(F.col("a"), F.col("b"))
    got = df.select(d.alias("d"), hashing.similarity(d, F.length("a")).alias("s"), hashing.confidence_tier(d).alias("t")).collect()
    assert [r.d for r in got] == [0, 16, 1, None]
    assert [r.s for r in got] == [1.0, 0.75, 1 - 1 / 64, 0.0]
    assert [r.t for r in got[:3]] == ["high", "low", "high"]
    score = sim.pair_score({"p": F.lit("f" * 16), "a": F.lit(None).cast("string")}, {"p": F.lit("f" * 15 + "e"), "a": F.lit("0" * 16)})
    assert df.select(score.alias("s")).first().s == 1 - 1 / 64
    assert df.select(hashing.bit_threshold(0.9).alias("a"), hashing.bit_threshold(0.75).alias("b")).first()[:] == (6, 16)


def test_cached_pairs_answer_in_both_orders(spark):
    files = wide(spark, [(1, *["0" * 16] * 4), (2, *["0" * 15 + "1"] * 4), (3, *["f" * 16] * 4)])
    cached = spark.createDataFrame([(1, 2, 0.85)], "low long, high long, similarity double")
    asked = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "file1_id long, file2_id long")
    got = {(r.file1_id, r.file2_id): (r.similarity, r.cached) for r in sim.score_requests(asked, files, cached).collect()}
    assert got == {(1, 2): (0.85, True), (2, 1): (0.85, True), (1, 3): (0.0, False)}
