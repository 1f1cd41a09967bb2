"""Topic sources (A1, A3, A9) for batch and Structured Streaming.

The source is a parameter: Kafka in production (``format("kafka")``; the
``spark-sql-kafka`` package must be on the classpath, it is not in this image), files
for tests and replays. Offsets live in the query checkpoint, which replaces consumer
auto-commit; ``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger`` bound a micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.session import scratch_path, stored
from pitwall.sources.tables import with_instant_time


def subscribed_topics(positions: str, commentary: str, anomalies: str | None = None,
                      anomalies_enabled: bool = False) -> list[str]:
    """A1: positions and commentary always; the anomalies topic only when the feature is
    enabled and a topic name is configured."""
    topics = [positions, commentary]
    if anomalies_enabled and anomalies:
        topics.append(anomalies)
    return topics


def kafka_options(bootstrap: str, topics: list[str], starting: str = "latest",
                  max_offsets_per_trigger: int | None = None, extra: dict | None = None, group_id: str | None = None) -> dict:
    """Subscribe options for several topics at once (A1). ``group_id`` is for brokers that grant reads by
    group; positions are the checkpoint's, so a group id needn't be unique to a restart."""
    o = {"kafka.bootstrap.servers": bootstrap, "subscribe": ",".join(topics), "startingOffsets": starting}
    if max_offsets_per_trigger:
        o["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if group_id:
        o["kafka.group.id"] = group_id
    o.update(extra or {})
    return o


def read_topic(spark: SparkSession, fmt: str, options: dict, stream: bool = True,
               schema: T.StructType | None = None, path: str | None = None) -> DataFrame:
    """A frame from a topic-like source; ``kafka`` yields (key, value, topic, offset, ...)."""
    r = spark.readStream if stream else spark.read
    r = r.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path) if path else r.load()


def demux(frames: DataFrame, topic: str) -> DataFrame:
    """A3: the records of one topic from a multi-topic subscription."""
    return frames.where(F.col("topic") == F.lit(topic))


def log(frames: dict[str, DataFrame]) -> DataFrame:
    """Records of several topics as one frame (topic, key, value, arrival), as a subscription to all of them gives."""
    out = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("topic"), F.col("key").cast("binary").alias("key"), F.col("value").cast("string").alias("value"), "arrival")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no topic")
    return out


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A given table as a file stream (replay of a topic); times cast as in batch."""
    from pitwall.sources.tables import SCHEMAS
    schema = SCHEMAS.get(name) or spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    # the file source takes a pattern where a bare file path would not do; this one matches the exact name only
    return with_instant_time(r.parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]"))


def files_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return with_instant_time(r.load(directory))


REPLAY_SLOT_ROWS = 100_000


def replay(spark: SparkSession, rows: DataFrame, slot: Column, slots: int, name: str) -> DataFrame:
    """``rows`` as a file stream in ``slots`` micro-batches, in the order of ``slot`` (0 to slots - 1).

    Each slot is written in one go after the one before it; a trigger takes just the files of one slot,
    so a batch holds what a topic would deliver in one poll."""
    path = scratch_path(spark, "replays", f"{name}-{uuid.uuid4().hex[:12]}")
    dealt = stored(rows.withColumn("slot", slot.cast("int")), f"replay-{name}")
    files = max(1, min(200, dealt.count() // (slots * REPLAY_SLOT_ROWS)))
    written = 0
    for i in range(slots):
        one = dealt.where(F.col("slot") == i).drop("slot")
        if one.limit(1).count():
            one.repartition(files).write.mode("append").parquet(path)
            written += 1
    if not written:
        dealt.drop("slot").write.mode("append").parquet(path)
    return files_stream(spark, path, rows.schema, max_files_per_trigger=files)
