"""Check-on-arrival: uploads compared with everything seen before, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.functions import hashing
from tracemark.operators.blocking import MAX_BROADCAST_BLOCKS, TILE_ROWS, join_blocks, near_pairs, plan_for
from tracemark.session import bounded_broadcast, folder_exists, materialise
from tracemark.streaming.runs import KeyedRuns

STORED = "file_id long, sha256 string, h long"


def _earliest(*keys: str, id: str):
    return lambda rows: rows.groupBy(*keys).agg(F.min(id).alias(id))


class UploadRegistry:
    """Stored fingerprints of all contents seen, and the verdict of every upload.

    Uploads have columns file_id (rising with arrival), sha256 and phash. An upload is a duplicate when an earlier
    content, stored or in the same micro-batch, has the same digest or a fingerprint within `max_distance` digits (bits, with `unit` bit).
    What was seen is stored twice: by digest, and by the blocks of the fingerprint search. A batch reads the slots of its own digests and blocks only, so its
    cost follows its size, not that of the history. The search plan is part of the stored layout: `expected_rows` picks it once.
    Every batch writes its own folders, overwriting them on a replay, and never reads its own or later ones: the
    result does not depend on retries, nor on how the input is cut into batches.
    """

    def __init__(self, spark: SparkSession, folder: str, max_distance: int = 4, unit: str = "char", expected_rows: int = 10_000_000, fan: int = 8, slot_rows: int = 200_000):
        self.spark, self.folder, self.max_distance, self.unit = spark, folder, max_distance, unit
        self.plan = plan_for(max_distance, expected_rows, unit)
        self.digests = KeyedRuns(spark, f"{folder}/digests", "sha256 string, file_id long", ("sha256",), _earliest("sha256", id="file_id"), fan, slot_rows)
        self.blocks = KeyedRuns(spark, f"{folder}/blocks", "key_id int, block long, h long, id long", ("key_id", "block"), _earliest("key_id", "block", "h", id="id"), fan, slot_rows)

    def _read(self, table: str, schema: str) -> DataFrame:
        if not folder_exists(self.spark, f"{self.folder}/{table}"):  # nothing written yet
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema + ", epoch long").parquet(f"{self.folder}/{table}").drop("epoch")

    def verdicts(self) -> DataFrame:
        return self._read("verdicts", "file_id long, is_duplicate boolean, original_id long")

    def contents(self) -> DataFrame:
        return self._read("contents", STORED)

    def process(self, uploads: DataFrame, epoch: int) -> None:
        keyed = uploads.select("file_id", "sha256", hashing.pack(F.col("phash")).alias("h"))
        batch = self._stored(keyed, "incoming", epoch)
        # One row per distinct content of the batch; copies inside the batch refer to the first of them.
        fresh = materialise(batch.groupBy("sha256").agg(F.min("file_id").alias("file_id"), F.first("h").alias("h")), "fresh")
        seen = self.digests.lookup(epoch, fresh).join(bounded_broadcast(fresh.select("sha256")), "sha256", "left_semi")
        known = materialise(_earliest("sha256", id="file_id")(seen), "known")
        new = self._stored(fresh.join(known.select("sha256"), "sha256", "left_anti").select("file_id", "sha256", "h"), "contents", epoch)
        verdict = self._compare(batch, known, fresh, epoch)
        verdict.write.mode("overwrite").parquet(f"{self.folder}/verdicts/epoch={epoch}")
        count = new.count()
        self.digests.put(new.select("sha256", "file_id"), epoch, count)
        self.blocks.put(self.plan.stored_rows(self._values(new)), epoch, count * self.plan.listed)

    def _stored(self, rows: DataFrame, table: str, epoch: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/epoch={epoch}")
        return self.spark.read.schema(STORED).parquet(f"{self.folder}/{table}/epoch={epoch}")

    @staticmethod
    def _values(contents: DataFrame) -> DataFrame:
        return contents.groupBy("h").agg(F.min("file_id").alias("id"))

    def _compare(self, batch: DataFrame, known: DataFrame, fresh: DataFrame, epoch: int) -> DataFrame:
        asked = materialise(self._values(fresh), "asked")
        n = asked.count()
        # Earliest content near each fingerprint value; the value itself is always among them.
        near = near_pairs(asked, self.max_distance, n, probes=asked, probe_rows=n, unit=self.unit).select("ha", "b")
        if self.blocks.live(epoch):
            probes = materialise(self.plan.probe_rows(asked), "probes")
            few = n * len(self.plan.keys) <= MAX_BROADCAST_BLOCKS
            before = join_blocks(probes, self.blocks.lookup(epoch, probes), self.plan, few=few, tile_rows=TILE_ROWS)
            near = near.unionByName(before.select("ha", "b"))
        earliest = near.groupBy("ha").agg(F.min("b").alias("near_id")).withColumnRenamed("ha", "h")
        same = known.unionByName(fresh.select("sha256", "file_id")).groupBy("sha256").agg(F.min("file_id").alias("same_id"))
        judged = batch.join(materialise(earliest, "earliest"), "h", "left").join(materialise(same, "same"), "sha256", "left").withColumn("first", F.least("near_id", "same_id"))
        earlier = F.col("first") < F.col("file_id")
        return judged.select("file_id", F.coalesce(earlier, F.lit(False)).alias("is_duplicate"), F.when(earlier, F.col("first")).alias("original_id"))


def watch_uploads(uploads: DataFrame, registry: UploadRegistry, checkpoint: str):
    """Start the check over a streaming table of uploads; runs until the available input is done."""
    return uploads.writeStream.foreachBatch(registry.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
