"""Reading the given parquet tables.

Only the columns a plan asks for are read (Catalyst prunes the scan; filters written on
top are pushed into the parquet reader). Zone-less parquet timestamps load as
TIMESTAMP_NTZ; they are cast to TIMESTAMP under the UTC session zone so that
``unix_millis`` and watermarks work on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def with_instant_time(df: DataFrame) -> DataFrame:
    """Cast every TIMESTAMP_NTZ column to TIMESTAMP (UTC session zone)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(F.col(f.name).cast("timestamp").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# Declared schemas of the tables the operators read: no schema inference job per read
# (at scale, no footer discovery across many files either).
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    r = spark.read
    if name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    return with_instant_time(r.parquet(path(sf_dir, name)))


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Register every given table as a temp view (for SQL use)."""
    for t in TABLES:
        load(spark, sf_dir, t).createOrReplaceTempView(t)
