import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracemark.operators import cache, catalog, hooks
from tracemark.operators import pixels as px
from tracemark.sources import files, sinks


def png(width, height, grey):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + bytes([grey(x, y) for x in range(width)]) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("media")
    (base / "sub").mkdir()
    (base / "a.png").write_bytes(png(16, 16, lambda x, y: x * 10))
    (base / "sub" / "b.png").write_bytes(png(16, 16, lambda x, y: x * 10))
    (base / "bad.png").write_bytes(b"not a picture")
    (base / "fake.jpg").write_bytes(png(4, 4, lambda x, y: 9))
    (base / "empty.mp4").write_bytes(b"")
    (base / "notes.txt").write_text("ignored")
    return str(base)


def test_scan_and_validation(spark, folder):
    listing = files.scan_directory(spark, folder)
    names = {r.filename: r for r in files.register_files(listing).collect()}
    assert set(names) == {"a.png", "b.png", "bad.png", "fake.jpg"}
    assert names["a.png"].file_type == "image" and names["fake.jpg"].mime_type == "image/jpeg"
    assert files.scan_directory(spark, folder, recursive=False).count() == 3
    expected = listing.select("file_path").unionByName(spark.createDataFrame([(f"{folder}/empty.mp4",)], "file_path string"))
    images = files.read_images(spark, folder).filter(F.col("file_path").rlike("[.](png|jpg)$"))
    checks = {r.file_path.rsplit("/", 1)[1]: r for r in files.validate_files(listing, images, expected).collect()}
    assert checks["a.png"].corruption_check == "passed" and checks["a.png"].format_matches_extension
    assert checks["bad.png"].corruption_check == "failed" and checks["bad.png"].format_matches_extension is None
    assert checks["fake.jpg"].format_matches_extension is False
    assert not checks["empty.mp4"].exists and not checks["empty.mp4"].file_size_valid and checks["empty.mp4"].corruption_check == "unknown"
    known = listing.filter(F.col("file_path").endswith("a.png"))
    assert files.scan_outcome(listing, known).first().asDict() == {"total_found": 4, "skipped": 1, "success": 3}
    meta = {r.file_path.rsplit("/", 1)[1]: r for r in files.comprehensive_metadata(listing, images).collect()}
    assert meta["a.png"].hashes.sha256 == meta["b.png"].hashes.sha256 and meta["a.png"].technical_data.width == 16


def test_picture_hashes_from_files(spark, folder):
    images = files.read_images(spark, folder)
    got = {r.file_path.rsplit("/", 1)[1]: r for r in px.with_features(images, "hashes", ["file_path"]).collect()}
    assert "bad.png" not in got and got["a.png"].dhash == got["b.png"].dhash == "ff" * 8


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Title,Body,n\nHello,"World, all",1\n,,2\n,only body,3\n')
    got = [r.text for r in files.read_labelled_csv(spark, str(tmp_path / "x.csv")).orderBy("n").collect()]
    assert got == ["Hello. World, all", ".", ". only body"]
    with pytest.raises(ValueError):
        files.labelled_texts(spark.createDataFrame([(1,)], "n int"))


def test_training_signature(spark, tmp_path):
    data = tmp_path / "train"
    data.mkdir()
    (data / "a.csv").write_text("text\nx\n")
    stored = spark.createDataFrame(files.source_signature(spark, str(data)).collect(), files.source_signature(spark, str(data)).schema)
    assert not files.needs_training(files.source_signature(spark, str(data)), stored)
    (data / "b.csv").write_text("text\ny\n")
    assert files.needs_training(files.source_signature(spark, str(data)), stored)


def test_sinks(spark, tables, tmp_path):
    results = tables.result_envelope.limit(40).cache()
    out = str(tmp_path)
    sinks.export_json(results, f"{out}/json")
    docs = [json.loads(r.value) for r in spark.read.text(f"{out}/json").collect()]
    assert len(docs) == 40 and "confidence" in docs[0]["technical_analysis"]["scores"] and docs[0]["export_info"]["format"] == "json"
    sinks.export_csv(results, f"{out}/csv")
    assert spark.read.option("header", True).csv(f"{out}/csv").count() == 40
    sinks.export_xml(results, f"{out}/xml")
    assert spark.read.format("xml").option("rowTag", "Data").load(f"{out}/xml").count() == 40
    sinks.export_text(results.limit(1), f"{out}/txt")
    lines = "\n".join(r.value for r in spark.read.text(f"{out}/txt").collect())
    assert "MEDIA FORENSICS TECHNICAL ANALYSIS REPORT" in lines and "confidence: " in lines and "  xception: " in lines
    for name in sinks.export_sheets(results, f"{out}/book"):
        assert spark.read.parquet(f"{out}/book/{name}").count() > 0
    for name in sinks.export_batch_sheets(results, f"{out}/batch"):
        assert spark.read.parquet(f"{out}/batch/{name}").count() > 0
    for fmt in ("json", "csv", "xml", "txt"):
        sinks.export_batch(results, f"{out}/all-{fmt}", fmt)
        assert spark.read.json(f"{out}/all-{fmt}/summary").first().total_processed == 40
    assert spark.read.json(f"{out}/all-json/results").filter("status = 'error'").count() == results.filter("error is not null").count()
    sinks.export_hashes(tables.media_hashes_wide, f"{out}/hashes")
    assert spark.read.json(f"{out}/hashes/info").first().total_files == tables.media_hashes_wide.count()


def test_jobs_are_appended(spark, tmp_path):
    jobs = spark.createDataFrame([("hash", 1, "{}"), ("detect", 2, "{}")], "job_type string, file_id long, parameters string")
    for _ in range(2):
        sinks.append_jobs(jobs, str(tmp_path / "jobs"))
    rows = spark.read.parquet(str(tmp_path / "jobs"))
    assert rows.count() == 4 and rows.select("job_id").distinct().count() == 2 and rows.filter("status = 'pending'").count() == 4
    sinks.write_split_dataset(spark.createDataFrame([(1, "train", "real"), (2, "val", "fake")], "v long, split string, label string"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, version int")
    once = catalog.upsert(old, new, ["id"], "version")
    twice = catalog.upsert(once, new, ["id"], "version")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "d", 2), (3, "e", 1)]


def test_upload_messages(spark):
    df = spark.createDataFrame([("a.jpg", 90 * 1024 * 1024), ("b.exe", 200 * 1024 * 1024)], "file_path string, file_size long")
    got = {r.file_path: r for r in catalog.validate_upload(df, F.lit("image"), {"image": [".jpg", ".png"]}).collect()}
    assert got["a.jpg"].valid and got["a.jpg"].warnings == ["Large file detected (90.0MB). Processing may take longer."]
    assert got["b.exe"].errors == ["File extension not allowed. Allowed: jpg, png", "File size (200.0MB) exceeds maximum allowed (100MB)"]


def test_schema_issues(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1,)], "a long")
    expected = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    assert catalog.schema_issues(df, "t", expected) == ["Missing column: t.b", "Wrong type: t.a"]


def test_cache_keeps_request_order_and_expiry(spark):
    entries = spark.createDataFrame([("k1", 7, "2024-01-02"), ("k2", 8, "2023-01-01"), ("k3", 9, None)], "cache_key string, v int, e string").select(
        "cache_key", "v", F.col("e").cast("timestamp").alias("expires_at"))
    asked = spark.createDataFrame([(0, "k2"), (1, "k1"), (2, "k3"), (3, "k1")], "pos int, cache_key string")
    got = [(r.pos, r.v, r.hit) for r in cache.answer(asked, entries, "v", F.lit(-1), F.lit("2024-01-01").cast("timestamp")).orderBy("pos").collect()]
    assert got == [(0, -1, False), (1, 7, True), (2, 9, True), (3, 7, True)]


def test_failing_item_fails_alone(spark, tmp_path):
    def work(row):
        if row["v"] == 3:
            raise MemoryError("too big")
        return str(row["v"] * 2)

    got = {r.id: r for r in hooks.process_items(spark.createDataFrame([(i, i) for i in range(5)], "id long, v long"), "id", work).collect()}
    assert got[2].result == "4" and got[3].error == "MemoryError: too big" and sum(r.success for r in got.values()) == 4
    target = str(tmp_path)
    hooks.export_each(spark.createDataFrame([(1,), (2,)], "id long"), lambda row: open(f"{target}/{row['id']}", "w").close())
    assert {p.name for p in tmp_path.iterdir()} == {"1", "2"}


def test_written_files_and_bitmaps(spark, tmp_path):
    from tracemark.functions import files as ff

    pixels = [(i, [(i * 7 + j) % 256 for j in range(8 * h)], h) for i, h in ((1, 2), (2, 5))]
    df = spark.createDataFrame(pixels, "id long, px array<int>, h int").select(F.concat(F.lit("deep/"), "id", F.lit(".bmp")).alias("name"), ff.bitmap(F.col("px"), 8, F.col("h")).alias("content"))
    more = df.unionByName(spark.createDataFrame([("empty.bmp", bytearray()), (None, bytearray(b"x")), ("none.bmp", None)], "name string, content binary"))
    for _ in range(2):  # an attempt that comes again
        assert {r.name: r.length for r in sinks.write_files(more, str(tmp_path)).collect()} == {"deep/1.bmp": 54 + 48, "deep/2.bmp": 54 + 120, "empty.bmp": 0}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["deep/1.bmp", "deep/2.bmp", "empty.bmp"]
    images = {r.file_path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path / "deep")).collect()}
    for i, px, h in pixels:
        assert (images[f"{i}.bmp"].height, images[f"{i}.bmp"].width) == (h, 8) and list(images[f"{i}.bmp"].data[::3]) == px
    with pytest.raises(ValueError):
        ff.bitmap(F.col("px"), 7, F.col("h"))


def test_model_is_trained_once_loaded_and_trained_again(spark, tmp_path):
    from tracemark.operators import models
    from tracemark.sources.model_store import ModelStore

    source, store, fits = tmp_path / "source", ModelStore(spark, str(tmp_path / "models")), []
    source.mkdir()
    (source / "a.csv").write_text("text\nx\n")
    data = spark.createDataFrame([(f"shock {i}" if i % 2 else f"report {i}", i % 2) for i in range(20)], "text string, label int")

    def fit():
        fits.append(1)
        return models.train_baseline(data, max_features=30, trees=2, depth=1)

    assert store.versions() == []
    told = lambda m: sorted(map(tuple, models.predict_baseline(m, data).collect()))
    first, version, trained = store.current(str(source), fit)
    assert (version, trained, len(fits)) == (1, True, 1)
    again, version, trained = store.current(str(source), fit)
    assert (version, trained, len(fits)) == (1, False, 1) and told(again) == told(first)
    (source / "b.csv").write_text("text\ny\n")
    assert store.current(str(source), fit)[1:] == (2, True) and store.current(str(source), fit)[1:] == (2, False)
    assert store.current(str(source), fit, force=True)[1:] == (3, True)
    (tmp_path / "models" / "version=000004" / "model").mkdir(parents=True)  # a training cut short
    assert store.versions() == [1, 2, 3] and store.current(str(source), fit)[1:] == (3, False)
    (source / "b.csv").unlink()
    assert store.current(str(source), fit)[1:] == (5, True)


def test_crashed_export_leaves_every_row_once(tmp_path):
    """The first attempt of every task dies half-way, after it has written rows."""
    import subprocess
    import sys

    script = f"""
import os
from pyspark import TaskContext
from tracemark.operators import hooks
from tracemark.session import build_session
spark = build_session("local[2,3]", app="crash", **{{"spark.ui.enabled": "false"}})
def render(row):
    if row["id"] % 50 == 30 and TaskContext.get().attemptNumber() == 0:
        os._exit(1)
    if row["id"] % 10 == 7:
        raise ValueError("seven")
    return f"{{row['id']}}\\n".encode()
hooks.export_parts(spark.range(0, 200, 1, 4), "id", render, "{tmp_path}/out")
lines = sorted(int(r.value) for r in hooks.exported_lines(spark, "{tmp_path}/out").collect())
failed = sorted(int(f.key) for r in hooks.exported_files(spark, "{tmp_path}/out").collect() for f in r.failed)
assert lines == [i for i in range(200) if i % 10 != 7] and failed == [i for i in range(200) if i % 10 == 7]
assert len(os.listdir("{tmp_path}/out/parts")) >= 8
print("whole")
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=240)
    assert "whole" in done.stdout, done.stderr[-2000:]


def test_open_payloads(spark):
    from tracemark.functions import payloads

    rows = [(1, '{"k":3}'), (2, '{"k":{"value":4}}'), (3, "[5]"), (4, '{"k":"6"}'), (5, "{broken"), (6, None), (7, "{}")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("p", payloads.payload(F.col("t")))
    got = {r.id: r.n for r in df.select("id", payloads.first_of(F.col("p"), "int", "$.k", "$.k.value", "$[0]").alias("n")).collect()}
    assert got == {1: 3, 2: 4, 3: 5, 4: 6, 5: None, 6: None, 7: None}
    assert df.where("id in (1, 4)").agg(payloads.common_shape(F.col("p")).alias("s")).first().s == "OBJECT<k: VARIANT>"
