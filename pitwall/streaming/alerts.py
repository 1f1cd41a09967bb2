"""Streaming dedupe (D1/D2 on streams) and the race lifecycle timer (H5).

* ``dedupe``: ``dropDuplicatesWithinWatermark`` on the key; state per key lasts for the
  watermark delay, so the dedupe horizon is explicit (the client-side version looked only
  at the 50 rows it still held).
* ``lifecycle``: per race an event-time timer: the first message of a race emits
  ``in_progress`` at its event time and arms a timeout at start + duration; when the
  watermark passes it, ``finished`` is emitted. The finished race is remembered until the
  eviction age has passed, so late messages do not open it again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitwall.operators.races import DURATION_S, STATUSES


def dedupe(df: DataFrame, keys: list[str], event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


LIFECYCLE_OUT = "race_id string, status string, at_us long"
LIFECYCLE_STATE = "start_us long, stage int"
EVICT_AFTER_S = 3600
#: Stages of a race's state: its start may still move, it runs, it is over.
_OPEN, _RUNNING, _OVER = range(3)


def _lifecycle_fn(duration_s: int, settled: bool, evict_after_s: int):
    dur_us = duration_s * 1_000_000
    keep_ms = evict_after_s * 1000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        known = state.exists
        start, stage = state.get if known else (None, _OPEN)
        if stage == _OPEN:
            # an earlier row may come as long as the watermark hasn't passed the earliest seen
            start = min([int(p["ts_us"].min()) for p in pdfs if len(p)] + ([start] if known else []))
        now = state.getCurrentWatermarkMs()
        end_ms = (start + dur_us) // 1000
        if stage == _OPEN and (not settled or start <= now * 1000):
            stage = _RUNNING
            out.append((key[0], STATUSES[1], start))
        if stage == _RUNNING and end_ms <= now:
            stage = _OVER
            out.append((key[0], STATUSES[2], start + dur_us))
        if stage == _OVER and end_ms + keep_ms <= now:
            if known:
                state.remove()
        else:
            # a timeout has to be set again in every call
            state.update((start, stage))
            state.setTimeoutTimestamp({_OPEN: (start + 999) // 1000, _RUNNING: end_ms, _OVER: end_ms + keep_ms}[stage])
        if out:
            yield pd.DataFrame(out, columns=["race_id", "status", "at_us"])
    return fn


def lifecycle(positions: DataFrame, duration_s: int = DURATION_S, delay: str = "1 minute", settled: bool = False,
              evict_after_s: int = EVICT_AFTER_S) -> DataFrame:
    """Status transitions per race as the watermark advances (append mode).

    A race is announced with its first batch, and starts with that batch's earliest row; with ``settled`` it is announced once the
    watermark passes its earliest row, whichever batch that row came in, so the start is exact for rows out of order.
    A finished race is forgotten after ``evict_after_s`` more seconds of event time; rows that come later open it again."""
    p = (positions.where(F.col("race_id").isNotNull())
         .withWatermark("ts", delay)
         .select("race_id", "ts", F.unix_micros("ts").alias("ts_us")))
    res = p.groupBy("race_id").applyInPandasWithState(
        _lifecycle_fn(duration_s, settled, evict_after_s), LIFECYCLE_OUT, LIFECYCLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return res.select("race_id", "status", F.timestamp_micros("at_us").alias("at"))


def with_event_time(df: DataFrame, ms_col: str | None = None, ts_col: str = "ts", delay: str = "1 minute") -> DataFrame:
    """H1: event time from epoch milliseconds (when ``ms_col`` is given) plus a watermark
    of ``delay``; rows later than the watermark are dropped by stateful operators and
    counted in the query progress (``numRowsDroppedByWatermark``)."""
    if ms_col:
        df = df.withColumn(ts_col, F.timestamp_millis(ms_col))
    return df.withWatermark(ts_col, delay)
