import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracemark.functions import hashing
from tracemark.streaming import cache, jobs
from tracemark.streaming.registry import UploadRegistry, watch_uploads
from tracemark.streaming.runs import KeyedRuns
from tracemark.streaming.upserts import UpsertTable, watch_changes

SCHEMA = "file_id long, sha256 string, phash string"


def uploads():
    rng = random.Random(9)
    digits = "0123456789abcdef"
    rows, base = [], ["".join(rng.choices(digits, k=16)) for _ in range(6)]
    for i in range(60):
        h = list(rng.choice(base))
        for p in rng.sample(range(16), rng.choice([0, 0, 1, 3, 7])):
            h[p] = rng.choice(digits)
        rows.append((i, f"s{''.join(h)}", "".join(h)))
    return rows


def by_hand(rows, limit=4):
    out = {}
    for i, s, h in rows:
        earlier = [j for j, s2, h2 in rows if j < i and (s2 == s or sum(a != b for a, b in zip(h, h2)) <= limit)]
        out[i] = (bool(earlier), min(earlier) if earlier else None)
    return out


def run(spark, folder, batches):
    registry = UploadRegistry(spark, str(folder))
    for epoch, rows in enumerate(batches):
        registry.process(spark.createDataFrame(rows, SCHEMA), epoch)
    return {r.file_id: (r.is_duplicate, r.original_id) for r in registry.verdicts().collect()}, {r.sha256 for r in registry.contents().collect()}


def test_registry_does_not_depend_on_the_batches(spark, tmp_path):
    rows = uploads()
    whole, contents = run(spark, tmp_path / "one", [rows])
    cut, contents_cut = run(spark, tmp_path / "many", [rows[:7], rows[7:30], rows[30:]])
    assert whole == cut == by_hand(rows) and contents == contents_cut


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = uploads()
    first, _ = run(spark, tmp_path, [rows[:30], rows[30:]])
    registry = UploadRegistry(spark, str(tmp_path))
    registry.process(spark.createDataFrame(rows[30:], SCHEMA), 1)
    assert {r.file_id: (r.is_duplicate, r.original_id) for r in registry.verdicts().collect()} == first


def test_streamed_uploads(spark, tmp_path):
    rows = uploads()
    source = str(tmp_path / "in")
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    registry = UploadRegistry(spark, str(tmp_path / "state"))
    watch_uploads(spark.readStream.schema(SCHEMA).parquet(source), registry, str(tmp_path / "cp")).awaitTermination()
    assert {r.file_id: (r.is_duplicate, r.original_id) for r in registry.verdicts().collect()} == by_hand(rows)


def test_registry_across_merged_runs(spark, tmp_path):
    """One upload a batch, two runs a level, slots of a few rows: the same verdicts."""
    rows = uploads()[:26]
    registry = UploadRegistry(spark, str(tmp_path), fan=3, slot_rows=40)
    for epoch in range(9):
        registry.process(spark.createDataFrame(rows[3 * epoch : 3 * epoch + 3], SCHEMA), epoch)
    assert {r.file_id: (r.is_duplicate, r.original_id) for r in registry.verdicts().collect()} == by_hand(rows)


def test_live_runs_cover_all_batches_once():
    runs = KeyedRuns(None, "", "", (), fan=3)
    for before in range(60):
        covered = [b for level, index in runs.live(before) for b in range(index * 3**level, (index + 1) * 3**level)]
        assert covered == list(range(before)) and all(len([r for r in runs.live(before) if r[0] == level]) < 3 for level in range(4))


def test_rows_read_do_not_grow_with_the_history(spark, tmp_path):
    def history(name, rows):
        runs = KeyedRuns(spark, str(tmp_path / name), "k long, v long", ("k",), fan=4, slot_rows=50)
        for batch in range(8):
            part = spark.range(batch * rows // 8, (batch + 1) * rows // 8).selectExpr("id as k", "id * 2 as v")
            runs.put(part, batch)
        return runs

    wanted = spark.createDataFrame([(5,), (777,), (-1,)], "k long")
    read = {}
    for rows in (1600, 25_600):
        found = history(f"h{rows}", rows).lookup(8, wanted)
        read[rows] = found.count()
        assert {(r.k, r.v) for r in found.join(wanted, "k", "left_semi").collect()} == {(5, 10), (777, 1554)}
    assert read[25_600] <= 1.5 * read[1600] < 25_600 / 10


def changes():
    rng = random.Random(12)
    return [(rng.choice([None, *range(9)]), rng.choice([None, *range(200)]), f"v{i}") for i in range(120)]


def newest_by_hand(batches):
    out = {}
    for b, rows in enumerate(batches):
        for k, version, v in rows:
            rank = (version is not None, version or 0, b, v)
            if k not in out or rank > out[k][0]:
                out[k] = (rank, (k, version, v))
    return {row for _, row in out.values()}


def test_upserts_keep_the_newest_row_of_every_key(spark, tmp_path):
    schema, rows = "k long, version long, v string", changes()
    for name, cuts in (("one", [0]), ("many", [0, 5, 6, 30, 31, 60, 90, 110])):
        batches = [rows[a:b] for a, b in zip(cuts, [*cuts[1:], len(rows)])]
        table = UpsertTable(spark, str(tmp_path / name), schema, ("k",), "version", fan=2, slot_rows=3)
        for epoch, part in enumerate(batches):
            table.process(spark.createDataFrame(part, schema), epoch)
        assert {tuple(r) for r in table.rows(len(batches)).collect()} == newest_by_hand(batches)
        told = {r.outcome: r.n for r in table.outcomes().groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
        assert told["inserted"] == len({k for k, *_ in rows})
        if name == "many":
            table.process(spark.createDataFrame(batches[-1], schema), len(batches) - 1)
            assert {tuple(r) for r in table.rows(len(batches)).collect()} == newest_by_hand(batches)
            assert told["replaced"] + told["outdated"] + told["inserted"] == sum(len({k for k, *_ in b}) for b in batches)


def test_streamed_upserts(spark, tmp_path):
    schema, rows = "k long, version long, v string", [(i % 5, i, f"v{i}") for i in range(40)]
    source = str(tmp_path / "in")
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    table = UpsertTable(spark, str(tmp_path / "t"), schema, ("k",), "version")
    watch_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), table, str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in table.rows(2).collect()} == set(rows[-5:])


def stored_by_hand(rows, hours=24):
    out, expires = [], {}
    for t, k in sorted((t, k) for k, t in rows):
        if k not in expires or t >= expires[k]:
            out.append((k, t))
            expires[k] = t + timedelta(hours=hours)
    return sorted(out)


def test_cache_entries_do_not_depend_on_the_batches(spark, tmp_path):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(rng.choice("aaaabc"), start + timedelta(minutes=rng.randrange(60 * 24 * 12))) for _ in range(300)]
    rows += [("d", start), ("d", start + timedelta(hours=24)), ("d", start + timedelta(hours=24)), ("d", start + timedelta(hours=47, minutes=59)), ("d", start + timedelta(days=9))]
    rows.sort(key=lambda r: r[1])
    for name, cuts in (("one", [0]), ("many", [0, 3, 40, 41, 150, 290])):
        source, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            part = [(k, str(t)) for k, t in rows[a:b]]
            spark.createDataFrame(part, "k string, t string").select(F.col("k").alias("cache_key"), F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
            stream = cache.entries(spark.readStream.schema("cache_key string, ts timestamp").parquet(source)).writeStream.format("parquet").option("path", out)
            stream.option("checkpointLocation", str(tmp_path / name / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(out).select("cache_key", F.col("stored_at").cast("string").alias("t")).collect()
        assert sorted((r.cache_key, datetime.fromisoformat(r.t)) for r in got) == stored_by_hand(rows), name


def test_job_counters_follow_the_stream(spark, tmp_path):
    schema = "job_id long, error string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, None), (1, "x")], [(1, None), (2, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.keep_counters(spark.readStream.schema(schema).parquet(source), folder, str(tmp_path / "cp")).awaitTermination()
    got = {r.job_id: (r.processed, r.completed, r.failed) for r in jobs.current_counters(spark.read.parquet(folder)).collect()}
    assert got == {1: (3, 2, 1), 2: (1, 1, 0)}


def test_expiry_hours(spark):
    r = spark.range(1).select(hashing.expires_at(F.lit("2024-01-01").cast("timestamp"), 168).cast("string").alias("t")).first()
    assert r.t == "2024-01-08 00:00:00"


def test_tables_in_folders_are_streamed_whole(spark, tmp_path):
    from tracemark.plans import load_all
    from tracemark.plans.registry import runnable

    load_all()
    for table in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in ("R01_upload_check", "R03_job_counters"):
        expected = sorted(map(tuple, runnable(name)(spark, "/root/testdata/sf0.001").collect()))
        assert expected and sorted(map(tuple, runnable(name)(spark, str(tmp_path)).collect())) == expected
