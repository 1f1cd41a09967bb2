"""Sinks: JSON envelopes (K8), keyed upsert (K3), append (K4), change callbacks (K7),
bounded per-key history (S7).

Upsert without a table format: each micro-batch writes its latest row per key into its
own ``batch_id=N`` folder with overwrite, so a retried batch replaces itself
(idempotent); readers take the latest version per key across batches. Where a table
format with MERGE is available the same ``latest_per_key`` frame is the MERGE source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def anomaly_envelope_fields() -> list[tuple[str, Column]]:
    """Alert notification fields with their defaults ('' / 0.0 / 'info')."""
    return [
        ("team_name", F.coalesce(F.col("team_name"), F.lit(""))),
        ("driver_name", F.coalesce(F.col("driver_name"), F.lit(""))),
        ("race_id", F.coalesce(F.col("key"), F.lit(""))),
        ("timestamp", F.col("timestamp").cast("long")),
        ("metric_name", F.coalesce(F.col("metric_name"), F.lit(""))),
        ("metric_value", F.coalesce(F.col("metric_value"), F.lit(0.0))),
        ("confidence_score", F.coalesce(F.col("confidence_score"), F.lit(0.0))),
        ("severity", F.coalesce(F.col("severity"), F.lit("info"))),
    ]

ANOMALY_ENVELOPE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("team_name", T.StringType()),
        T.StructField("driver_name", T.StringType()),
        T.StructField("race_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("metric_name", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("severity", T.StringType()),
    ])),
])

COMMENTARY_ENVELOPE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("type", T.StringType()),
    ])),
])


def commentary_envelope_fields() -> list[tuple[str, Column]]:
    """Commentary notification fields: ISO time, default type 'info'."""
    return [
        ("id", F.col("id")),
        ("message", F.col("message")),
        ("timestamp", F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        ("type", F.coalesce(F.col("type"), F.lit("info"))),
    ]


def envelope(df: DataFrame, kind: str, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """{"type": kind, "data": {...}} as one JSON text column ``message``."""
    data = F.struct(*[c.alias(n) for n, c in fields])
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), data.alias("data"))).alias("message"))


def parse_envelope(env: DataFrame, schema: T.StructType) -> DataFrame:
    """Envelope JSON -> (kind = envelope type, data fields...)."""
    p = env.select(F.from_json("message", schema).alias("_e"))
    return p.select(F.col("_e.type").alias("kind"), "_e.data.*")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """K3 core: the last row per key by ``order`` (partial aggregation, skew-safe)."""
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_m"))
            .select(*keys, "_m.*"))


def upsert_batch(path: str, keys: Sequence[str], order: str, cols: Sequence[str],
                 partitions: int | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer for keyed upsert. Rows are hash-partitioned by the key
    (as the sink table is distributed by it) before writing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = latest_per_key(batch, keys, order, cols)
        out = out.repartition(partitions, *keys) if partitions else out.repartition(*keys)
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Current table state: the newest version of each key across batch folders."""
    raw = spark.read.parquet(path)
    return latest_per_key(raw, keys, "batch_id", cols)


def append_json(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """K4: append-only JSON files from a streaming frame."""
    w = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def on_update(callback: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """K7: call ``callback`` with each micro-batch's changed state (update mode)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        callback(batch, batch_id)
    return run


def bounded_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows per key (``row_number`` with a group limit: Spark keeps at
    most ``n`` rows per key in each task before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def to_table(df: DataFrame, table: str, checkpoint: str | None = None, mode: str = "append"):
    """K5: continuous ``INSERT INTO table SELECT ...`` (streaming) or a batch insert."""
    if df.isStreaming:
        return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                .toTable(table))
    df.write.mode(mode).saveAsTable(table) if mode == "overwrite" else df.write.insertInto(table)
    return None
