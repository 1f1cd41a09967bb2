"""Wire records -> typed rows (A4-A8, B5, B6, B10-B12), and the inverse encoders (K1, K2).

A topic frame has ``key`` (binary or string) and ``value`` (JSON text, or a struct when
the source is already typed). Tombstones (null value) are dropped; malformed values are
kept apart by ``split_corrupt`` (dead letters) so the stream goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall import schemas as S
from pitwall.functions import exprs as X

CORRUPT = "_corrupt_record"


def _parsed(df: DataFrame, schema: T.StructType) -> Column:
    v = F.col("value")
    if isinstance(df.schema["value"].dataType, T.StructType):
        return v
    with_bad = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return F.from_json(v.cast("string"), with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def split_corrupt(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(parsed rows with a ``_v`` struct, dead letters with the raw value).

    The parsed struct is produced by a one-element ``explode``: filters on it then stay
    above the Generate, so each value is parsed once (a plain projection would be
    inlined into every pushed-down predicate and parsed again there)."""
    p = df.where(F.col("value").isNotNull()).select("*", F.explode(F.array(_parsed(df, schema))).alias("_v"))
    if CORRUPT in p.schema["_v"].dataType.fieldNames():
        bad = F.col("_v").isNull() | F.col(f"_v.{CORRUPT}").isNotNull()
        return p.where(~bad), p.where(bad).drop("_v")
    return p, p.limit(0).drop("_v")


def dead_letters(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The records that a decoder leaves out because their value can't be parsed, with
    the raw value; tombstones are none."""
    bad = split_corrupt(df, schema)[1]
    return bad.withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))


# --- Fixed values of a registry's framing: one magic byte, then the schema's id as four bytes, highest first ---
FRAME_MAGIC = "00"
FRAME_BYTES = 5
# ---------------------------------------------------------------------------------------------------------------


def framed(df: DataFrame, schema_id) -> DataFrame:
    """The value with a registry's header before it (tombstones stay null)."""
    header = F.unhex(F.concat(F.lit(FRAME_MAGIC), F.lpad(F.hex(X.col(schema_id).cast("long")), 8, "0")))
    return df.withColumn("value", F.concat(header, F.col("value").cast("string").cast("binary")))


def unframed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (records with ``schema_id`` and their payload as ``value``, records whose value has no such header).

    Tombstones stay among the first, as they carry no payload; a value of fewer than five bytes, or with another first byte, is no frame."""
    v = F.col("value").cast("binary")
    ok = v.isNull() | ((F.octet_length(v) >= FRAME_BYTES) & (F.hex(F.substring(v, 1, 1)) == FRAME_MAGIC))
    good = df.where(ok).withColumn("schema_id", F.conv(F.hex(F.substring(v, 2, FRAME_BYTES - 1)), 16, 10).cast("long"))
    return good.withColumn("value", F.substring(v, FRAME_BYTES + 1, 2_147_483_647)), df.where(~ok)


def _passthrough(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("key", "value", "_v")]


def positions(df: DataFrame) -> DataFrame:
    """A4: (driver_name, position, ts, race_id, + passthrough); team_name and speed are
    dropped as in the consumer; '' race id means no race."""
    good, _ = split_corrupt(df, S.POSITION_WIRE)
    return good.select(
        F.col("_v.driver_name").alias("driver_name"),
        F.col("_v.position").alias("position"),
        X.ms_to_ts("_v.timestamp").alias("ts"),
        X.empty_as_null("_v.race_id").alias("race_id"),
        *_passthrough(df))


def metrics(df: DataFrame) -> DataFrame:
    """Car metrics with the race key as a string (B6) and ms -> instant."""
    good, _ = split_corrupt(df, S.METRICS_WIRE)
    return good.select(
        F.col("key").cast("string").alias("key"),
        F.col("_v.team_name").alias("team_name"),
        X.ms_to_ts("_v.timestamp").alias("ts"),
        F.col("_v.engine_temperature").alias("engine_temperature"),
        *_passthrough(df))


def commentary(df: DataFrame) -> DataFrame:
    """A5 + B11 + B12: drop rows whose id, message or timestamp is missing; missing type
    means 'info'; timestamp (ms, a JSON number) -> instant."""
    good, _ = split_corrupt(df, S.COMMENTARY_WIRE)
    v = F.col("_v")
    kept = good.where(v.id.isNotNull() & v.message.isNotNull() & v.timestamp.isNotNull())
    return kept.select(
        v.id.alias("id"), v.message.alias("message"),
        F.timestamp_millis(v.timestamp.cast("long")).alias("ts"),
        F.coalesce(v.type, F.lit(X.DEFAULT_COMMENT_TYPE)).alias("type"),
        *_passthrough(df))


def anomalies(df: DataFrame) -> DataFrame:
    """Anomaly value (team_name, engine_temperature, is_anomaly); the key is not read."""
    good, _ = split_corrupt(df, S.ANOMALY_WIRE)
    return good.select("_v.team_name", "_v.engine_temperature", "_v.is_anomaly", *_passthrough(df))


def encode_positions(df: DataFrame) -> DataFrame:
    """K1: key = race id; value JSON with the producer's coercions (name -> '' , position
    -> 0, missing time -> 0, speed -> double or null; race/team pass through)."""
    val = F.struct(
        F.coalesce(F.col("driver_name").cast("string"), F.lit("")).alias("driver_name"),
        F.coalesce(F.col("position").cast("int"), F.lit(0)).alias("position"),
        F.coalesce(X.ts_to_ms("ts"), F.lit(0).cast("long")).alias("timestamp"),
        F.col("race_id"), F.col("team_name"),
        F.col("speed").cast("double").alias("speed"))
    keep = [c for c in df.columns if c in ("arrival",)]
    return df.select(F.encode(F.col("race_id"), "UTF-8").alias("key"), F.to_json(val).alias("value"), *keep)


def encode_metrics(df: DataFrame, key_col: str, asof_ms: int) -> DataFrame:
    """K2: key = race key; a missing time becomes ``asof_ms`` (the producer used 'now');
    missing team -> '', temperature -> 0.0."""
    val = F.struct(
        F.coalesce(F.col("team_name").cast("string"), F.lit("")).alias("team_name"),
        F.coalesce(X.ts_to_ms("ts"), F.lit(asof_ms).cast("long")).alias("timestamp"),
        F.coalesce(F.col("engine_temperature").cast("double"), F.lit(0.0)).alias("engine_temperature"))
    keep = [c for c in df.columns if c in ("arrival",)]
    return df.select(F.encode(F.col(key_col), "UTF-8").alias("key"), F.to_json(val).alias("value"), *keep)


def encode_commentary(df: DataFrame) -> DataFrame:
    """Commentary wire value: {id, message, timestamp (number), type}."""
    keep = [c for c in df.columns if c not in ("id", "message", "timestamp", "type")]
    val = F.struct("id", "message", F.col("timestamp").cast("double").alias("timestamp"), "type")
    return df.select(F.col("id").cast("binary").alias("key"),
                     F.to_json(val, {"ignoreNullFields": "false"}).alias("value"), *keep)
