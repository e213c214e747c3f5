"""Insert-or-replace by key over a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.session import bounded_broadcast, folder_exists
from tracemark.streaming.runs import KeyedRuns


class UpsertTable:
    """A table of `schema` in which the newest row of a key replaces the others.

    Newest is the highest `version`; at equal versions the row of the later batch, then the greatest row. A batch is reduced to one row per key by partial aggregation,
    and only the slots of its keys are read to tell what it inserts, replaces or leaves. The result doesn't depend on the cut into batches
    unless rows of one version and key come in different batches.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...], version: str, fan: int = 8, slot_rows: int = 200_000):
        self.spark, self.folder, self.keys, self.version = spark, folder, keys, version
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self.runs = KeyedRuns(spark, f"{folder}/rows", f"{schema}, _batch long", keys, self._newest, fan, slot_rows)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in [*self.columns, "_batch"] if c not in self.keys]
        best = F.max(F.struct(F.col(self.version).alias("_version"), F.col("_batch").alias("_later"), F.struct(*rest).alias("row"))).alias("m")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, *(F.col(f"m.row.{c}").alias(c) for c in rest))

    def process(self, rows: DataFrame, batch: int) -> None:
        path = f"{self.folder}/incoming/batch={batch}"
        self._newest(rows.select(*self.columns, F.lit(batch).cast("long").alias("_batch"))).write.mode("overwrite").parquet(path)
        new = self.spark.read.schema(self.runs.schema).parquet(path)
        keys = bounded_broadcast(new.select(*(F.col(k).alias(f"_{k}") for k in self.keys)))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])  # a missing key is a key
        old = self._newest(self.runs.lookup(batch, new).join(keys, same, "left_semi"))
        old = old.select(*(F.col(k).alias(f"_{k}") for k in self.keys), F.col(self.version).alias("_old"), F.lit(True).alias("_known"))
        judged = new.join(old, same, "left")
        kind = F.when(F.col("_known").isNull(), "inserted").when(F.col("_old").isNull() | (F.col(self.version) >= F.col("_old")), "replaced").otherwise("outdated")
        judged.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch={batch}")
        self.runs.put(new, batch)

    def rows(self, batches: int) -> DataFrame:
        """The table after so many batches."""
        return self._newest(self.runs.all(batches)).select(*self.columns)

    def outcomes(self) -> DataFrame:
        """Rows inserted, replaced and outdated, per batch."""
        if not folder_exists(self.spark, f"{self.folder}/outcomes"):
            return self.spark.createDataFrame([], "outcome string, n long, batch long")
        return self.spark.read.schema("outcome string, n long, batch long").parquet(f"{self.folder}/outcomes")


def watch_changes(changes: DataFrame, table: UpsertTable, checkpoint: str):
    """Start the upsert of a streaming table of rows; runs until the available input is done."""
    return changes.writeStream.foreachBatch(table.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
