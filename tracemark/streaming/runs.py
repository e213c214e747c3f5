"""Keyed state of a stream in plain folders, read only where a micro-batch's keys fall.

Every micro-batch adds one run. A run keeps its rows in slots, ranges of the hash of their key, as many as it takes to keep a slot small, and a reader that looks for some keys
reads the slots these fall into. Runs are merged like the digits of a counter: `fan` runs of a level become one of the next, so after n batches at most
`fan` runs a level are read, and every row has been rewritten once a level. Which runs a batch reads follows from its number alone: there is no pointer to keep, a replayed batch
overwrites its own run and reads what it read before, and a merge cut short is done again. Merged runs can be removed by age.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.session import folder_exists, subfolders

SLOT_BITS = 16


@dataclass(frozen=True)
class KeyedRuns:
    """Rows of `schema` by `keys` under `folder`. `merge` joins the rows of several runs; by default all are kept."""

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    fan: int = 8
    slot_rows: int = 200_000

    def _hash(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(1 << SLOT_BITS)).cast("int")

    def _run(self, level: int, index: int) -> str:
        return f"{self.folder}/level={level}/run={index}"

    def _stored(self, level: int, index: int) -> tuple[str, int] | None:
        """Folder and slot bits of a complete run."""
        for name in subfolders(self.spark, self._run(level, index)):
            path = f"{self._run(level, index)}/{name}"
            if folder_exists(self.spark, f"{path}/_SUCCESS"):
                return path, int(name.removeprefix("bits="))
        return None

    def _write(self, rows: DataFrame, count: int, level: int, index: int) -> None:
        bits = min((count // self.slot_rows).bit_length(), SLOT_BITS)
        slotted = rows.withColumn("slot", F.shiftright(self._hash(), SLOT_BITS - bits))
        slotted.repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self._run(level, index)}/bits={bits}")

    def _read(self, level: int, index: int, hashes: list[int] | None = None) -> DataFrame | None:
        found = self._stored(level, index)
        if found is None:  # a batch without rows
            return None
        path, bits = found
        rows = self.spark.read.schema(self.schema + ", slot int").parquet(path)
        if hashes is not None:
            slots = sorted({h >> (SLOT_BITS - bits) for h in hashes})
            if len(slots) < 1 << bits:
                rows = rows.where(F.col("slot").isin(slots))
        return rows.drop("slot")

    def live(self, before: int) -> list[tuple[int, int]]:
        """Runs (level, index) that hold all batches before this one, the oldest first."""
        level, out, start = 0, [], 0
        while self.fan ** (level + 1) <= before:
            level += 1
        for at in range(level, -1, -1):
            while start + self.fan**at <= before:
                out.append((at, start // self.fan**at))
                start += self.fan**at
        return out

    def _settle(self, level: int, index: int) -> None:
        if level == 0 or self._stored(level, index) is not None:
            return
        parts = []
        for child in range(index * self.fan, (index + 1) * self.fan):
            self._settle(level - 1, child)
            parts.append(self._read(level - 1, child))
        parts = [p for p in parts if p is not None]
        rows = self.spark.createDataFrame([], self.schema) if not parts else parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        self._write(self.merge(rows), rows.count(), level, index)

    def put(self, rows: DataFrame, batch: int, count: int | None = None) -> None:
        """Store the rows of a batch. Their number, which sets the number of slots, is counted unless it is given."""
        self._write(rows, rows.count() if count is None else count, 0, batch)

    def all(self, before: int) -> DataFrame:
        return self._union(before, None)

    def lookup(self, before: int, wanted: DataFrame) -> DataFrame:
        """Rows of earlier batches in the slots of the wanted keys: a superset of the rows with these keys, to be joined with them."""
        return self._union(before, [r[0] for r in wanted.select(self._hash()).distinct().collect()])

    def _union(self, before: int, hashes: list[int] | None) -> DataFrame:
        rows = self.spark.createDataFrame([], self.schema)
        for level, index in self.live(before):
            self._settle(level, index)
            part = self._read(level, index, hashes)
            if part is not None:
                rows = rows.unionByName(part)
        return rows
