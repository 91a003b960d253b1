"""Timelines over streams: conflicts and activity by window, gaps by state.

The batch operators of ``operators.timeline`` give the same answers on the whole
table, up to the watermark; these keep only what late events can still change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package

GAP = "user_id BIGINT, start TIMESTAMP, end TIMESTAMP, minutes BIGINT"


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value by window and type; a window is final once its watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def conflicts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Instants of a user with events of several types."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 second").alias("w")).agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return grouped.where(F.size("types") > 1).select("user_id", F.col("w.start").alias("ts"), "types")


def _gaps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, least: int) -> Iterator[pd.DataFrame]:
    """Instants wait in the state until the watermark has passed them, then they are read in order; gaps before them are final."""
    last, waiting = state.get if state.exists else (None, [])
    waiting = sorted([*waiting, *(int(t.value // 1000) for f in frames for t in f["ts"] if not pd.isna(t))])
    passed = state.getCurrentWatermarkMs() * 1000
    rows = []
    while waiting and waiting[0] <= passed:
        now = waiting.pop(0)
        if last is not None and now - last >= least * 60_000_000:
            rows.append((key[0], pd.Timestamp(last, unit="us"), pd.Timestamp(now, unit="us"), (now - last) // 60_000_000))
        last = now
    state.update((last, waiting))
    if waiting:
        state.setTimeoutTimestamp(waiting[0] // 1000 + 1)
    yield pd.DataFrame(rows, columns=["user_id", "start", "end", "minutes"])


def gaps(events: DataFrame, least: int = 60, late: str = "2 hours") -> DataFrame:
    """Gaps between the successive events of each user, final once the watermark has passed their later end.

    Events may arrive in any order within ``late``; later ones are dropped, as by
    every watermark, and null instants are ignored. The state of a user is the last
    final instant and those that the watermark hasn't passed.
    """
    ship_package(events.sparkSession)
    timed = events.select("user_id", "ts").withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(lambda k, fs, s: _gaps(k, fs, s, least), GAP, "last BIGINT, waiting ARRAY<BIGINT>", "append", GroupStateTimeout.EventTimeTimeout)
