"""Declared record contracts (K9) and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POSITION_WIRE = T.StructType([
    T.StructField("driver_name", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("timestamp", T.LongType(), False),          # epoch ms
    T.StructField("race_id", T.StringType(), True),
    T.StructField("team_name", T.StringType(), True),
    T.StructField("speed", T.DoubleType(), True),
])

METRICS_WIRE = T.StructType([
    T.StructField("team_name", T.StringType(), False),
    T.StructField("timestamp", T.LongType(), False),          # epoch ms
    T.StructField("engine_temperature", T.DoubleType(), False),
])

ANOMALY_WIRE = T.StructType([
    T.StructField("team_name", T.StringType(), True),
    T.StructField("engine_temperature", T.DoubleType(), True),
    T.StructField("is_anomaly", T.BooleanType(), True),
])

ANOMALY_KEY = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
])

COMMENTARY_WIRE = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("timestamp", T.DoubleType(), True),         # epoch ms, a JSON number
    T.StructField("type", T.StringType(), True),
])

ANOMALY_TABLE = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("team_name", T.StringType(), True),
    T.StructField("engine_temperature", T.DoubleType(), True),
    T.StructField("is_anomaly", T.BooleanType(), True),
])

COMMENTARY_TABLE = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("type", T.StringType(), True),
])


class ContractError(ValueError):
    pass


def assert_contract(df_or_schema, expected: T.StructType, check_nullability: bool = False) -> None:
    """Raise before a job starts when a frame does not carry the declared fields/types.

    Extra columns are allowed; a missing field or a different type is an error; with
    ``check_nullability`` a nullable column where the contract says required is too.
    """
    schema = df_or_schema.schema if isinstance(df_or_schema, DataFrame) else df_or_schema
    have = {f.name: f for f in schema.fields}
    problems = []
    for f in expected.fields:
        g = have.get(f.name)
        if g is None:
            problems.append(f"missing {f.name}")
        elif g.dataType != f.dataType:
            problems.append(f"{f.name}: {g.dataType.simpleString()} != {f.dataType.simpleString()}")
        elif check_nullability and g.nullable and not f.nullable:
            problems.append(f"{f.name}: nullable but required")
    if problems:
        raise ContractError("; ".join(problems))
