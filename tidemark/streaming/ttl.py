"""Exact deduplication with a time to live from the last accepted delivery (duplicates do not extend it), as a stream.

Input: key (string), at (timestamp). Output: the accepted rows. Within a micro-batch a key's rows are taken in order of
time; across micro-batches the state holds one instant per key and ends with the event-time watermark.
"""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def accepted(stream: DataFrame, ttl_seconds: int, lateness: str = "1 hour") -> DataFrame:
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        for at in sorted(x for pdf in batches for x in pdf["at"]):
            if last is None or at - last >= ttl:
                last = at
                yield pd.DataFrame({"key": [key[0]], "at": [at]})
        state.update((int(last.value // 1000),))
        expires = int(last.value // 1_000_000) + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))

    watched = stream.where("key is not null and at is not null").withWatermark("at", lateness)
    return watched.groupBy("key").applyInPandasWithState(step, "key string, at timestamp", "last long", "append", "EventTimeTimeout")
