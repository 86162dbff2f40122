"""Admission control: at most ``limit`` accepted requests of a client in a sliding window; refused ones don't count.

What is accepted depends on what was accepted before, so a plain window count
isn't the same. Batch and stream share ``admit``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_S = 60, 60.0


def admit(times: Iterable[float], limit: int = LIMIT, window: float = WINDOW_S, before: Iterable[float] = ()) -> tuple[list[bool], list[float]]:
    """Whether each request (in order of time) is accepted, and the accepted ones that still count."""
    kept, out = deque(before), []
    for t in times:
        while kept and kept[0] < t - window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, list(kept)


def limited(events: DataFrame, client: str, ts: str, event: str, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """client, event, ts, accepted. A client's own requests go through one task in order; state is the last ``limit`` times."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    shape = f"`{client}` {kinds[client]}, `{event}` {kinds[event]}, `{ts}` {kinds[ts]}, accepted boolean"

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []
        for frame in frames:
            accepted = []
            for who, at in zip(frame["_c"], frame["_t"], strict=True):
                if who != last:
                    last, kept = who, []
                ok, kept = admit([at], limit, window, kept)
                accepted += ok
            yield frame.drop(columns=["_c", "_t"]).assign(accepted=accepted)

    rows = events.select(client, event, ts, F.coalesce(F.col(client).cast("string"), F.lit("")).alias("_c"), F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_t")).withColumn("_t", F.col("_t") / 1e6)
    return rows.repartition("_c").sortWithinPartitions("_c", "_t", event).mapInPandas(decide, shape)


def limited_stream(events: DataFrame, client: str, ts: str, limit: int = LIMIT, window: float = WINDOW_S, delay: str = "1 minute") -> DataFrame:
    """The same for a stream, each micro-batch in order of time: client, ts, accepted. A client's state goes once its window has passed."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def decide(key, frames, state):
        kept = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for frame in frames for t in frame[ts])
        accepted, kept = admit([t.timestamp() for t in times], limit, window, kept)
        state.update((kept,))
        due = int((max(kept, default=0.0) + window) * 1000) + 1
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({client: [key[0]] * len(times), ts: times, "accepted": accepted})

    shape = f"`{client}` {kinds[client]}, `{ts}` {kinds[ts]}, accepted boolean"
    return events.withWatermark(ts, delay).groupBy(client).applyInPandasWithState(decide, shape, "kept array<double>", "append", "EventTimeTimeout")


def counts_by_window(events: DataFrame, ts: str, kind: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window_start, kind, events; the same plan for tables and streams."""
    counted = (events.withWatermark(ts, delay) if events.isStreaming else events).groupBy(F.window(ts, window).alias("w"), kind)
    return counted.agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), kind, "events")
