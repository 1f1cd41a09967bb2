"""Starting streaming queries with a checkpoint in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pitwall.session import scratch_path


def locations(spark: SparkSession, name: str) -> tuple[str, str]:
    """(output path, checkpoint path) for a new run of ``name``."""
    base = scratch_path(spark, "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/out", f"{base}/checkpoint"


def start_foreach(df: DataFrame, fn, checkpoint: str, mode: str = "update",
                  trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    w = df.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def start_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                trigger: dict | None = None) -> StreamingQuery:
    w = (df.writeStream.outputMode("append").format(fmt).option("path", path)
         .option("checkpointLocation", checkpoint))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def finish(q: StreamingQuery, timeout_s: float = 600.0) -> None:
    """Wait for an ``availableNow`` query; one that does not end in time is stopped and raises,
    so that a sink with only part of the input is never taken for the result."""
    done = q.awaitTermination(timeout_s)
    if not done:
        q.stop()
    if q.exception() is not None:
        raise q.exception()
    if not done:
        raise TimeoutError(f"the streaming query did not end within {timeout_s:g} s; its output is incomplete")


def next_batch(q: StreamingQuery) -> int:
    """The batch id that ``q`` would use next: one more than its last (also when it found nothing new)."""
    last = q.lastProgress
    return int(last["batchId"]) + (1 if last["numInputRows"] else 0) if last else 0
