"""Expiring cache over a stream of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def entries(stream: DataFrame, key: str = "cache_key", time: str = "ts", hours: int = 24, late_hours: int = 1) -> DataFrame:
    """Entries that a cache stores: (key, stored_at, expires_at).

    A request stores an entry if its key has none or an expired one, at `hours` (24 for results, 168 for hashes) after it was stored;
    until then it is a hit and stores nothing. Requests of a micro-batch are taken in order of time, so the entries
    are the same for any cut of an ordered stream into micro-batches. A key is forgotten once the watermark, `late_hours` behind the newest
    request, passes its expiry. A task holds the times of one key's requests in one micro-batch, eight bytes each.
    """
    ttl = hours * 3_600_000_000

    def advance(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([b["at"].to_numpy(np.int64) for b in batches]))
        expires = state.get[0] if state.exists else None
        stored, i = [], 0
        while i < len(times):
            if expires is None or times[i] >= expires:
                stored.append(int(times[i]))
                expires = stored[-1] + ttl
            i = int(np.searchsorted(times, expires))
        if expires // 1000 > state.getCurrentWatermarkMs():
            state.update((expires,))
            state.setTimeoutTimestamp(expires // 1000)
        elif state.exists:
            state.remove()
        if stored:
            yield pd.DataFrame({"k": [name[0]] * len(stored), "at": stored})

    timed = stream.select(F.col(key).cast("string").alias("k"), F.col(time).alias("_time"), F.unix_micros(F.col(time)).alias("at"))
    kept = timed.withWatermark("_time", f"{late_hours} hours").groupBy("k").applyInPandasWithState(
        advance, "k string, at long", "expires long", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.col("k").alias(key), F.timestamp_micros("at").alias("stored_at"), F.timestamp_micros(F.col("at") + ttl).alias("expires_at"))
