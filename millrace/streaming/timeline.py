"""Trace analytics on streams: the allocated-bytes timeline kept per query, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIVE = "query string, idx long, ts long, bytes_live long"


def live_bytes(trace: DataFrame) -> DataFrame:
    """``query, idx, ts, bytes_live`` after each allocation and free of a stream of trace rows.

    The state of a query is its live allocations. Unlike the batch timeline it
    counts allocations that are not freed yet, as a stream cannot know; rows of
    one trigger are taken in line order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        addresses, sizes = state.get if state.exists else ([], [])
        live = dict(zip(addresses, sizes))
        rows = pd.concat(list(frames)).sort_values("idx")
        total, out = sum(live.values()), []
        for r in rows.itertuples():
            if r.api == "cudaMalloc":
                total += r.bytes - live.get(r.addr, 0)
                live[r.addr] = int(r.bytes)
            else:
                total -= live.pop(r.addr, 0)
            out.append((key[0], r.idx, r.ts, total))
        state.update((list(live), list(live.values())))
        yield pd.DataFrame(out, columns=["query", "idx", "ts", "bytes_live"])

    rows = trace.filter("phase = 'intercepted' and api in ('cudaMalloc', 'cudaFree') and addr is not null").select("query", "idx", "ts", "api", "addr", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return rows.groupBy("query").applyInPandasWithState(step, LIVE, "addresses array<long>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` by tumbling windows of event time; rows later than the watermark are dropped by the engine.

    A time without a zone counts as UTC, whatever the session's zone.
    """
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
