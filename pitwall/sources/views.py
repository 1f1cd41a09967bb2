"""Canonical inputs derived from the given tables.

The given tables hold no races, so the operator inputs are derived from them (the same
mapping is written in SQL for the oracle):

* ``roster``    nation x region: id = n_nationkey, name = n_name, team = r_name.
* ``positions`` one position message per event: race_id = event_type, except that
  'signup' events carry no race (the no-race list); driver = roster row
  ``user_id % 25``; position = 1 + event_id % 10; arrival (offset) = event_id.
* ``metrics``   one car-metrics message per event: key = event_type (the race key),
  team = the driver's team, engine_temperature = value.
* ``comments``  one commentary message per conversation turn.
* ``corpus``    the embeddings table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.sources.tables import load

# --- Fixed values of the mapping ---------------------------------------------------------
N_DRIVERS = 25            # driver code = user_id % N_DRIVERS (one driver per nation row)
NO_RACE_EVENT = "signup"  # events of this type carry no race id
N_POSITIONS = 10          # position = 1 + event_id % N_POSITIONS
# -----------------------------------------------------------------------------------------


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").cast("int").alias("id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("team"),
        F.concat(F.lit("#"), F.substring(F.md5(F.col("r_name")), 1, 6)).alias("team_color"),
    )


def _events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(*cols)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, ts, race_id, driver_name, position, team_name, speed)."""
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value")
    return positions_from(e, roster(spark, sf_dir))


def positions_from(e: DataFrame, ro: DataFrame) -> DataFrame:
    """The positions mapping over any events frame (batch or streaming)."""
    return e.join(ro, (e.user_id % N_DRIVERS) == ro.id).select(
        F.col("event_id").alias("arrival"),
        F.col("ts"),
        F.when(F.col("event_type") != NO_RACE_EVENT, F.col("event_type")).alias("race_id"),
        F.col("name").alias("driver_name"),
        (F.col("event_id") % N_POSITIONS + 1).cast("int").alias("position"),
        F.col("team").alias("team_name"),
        F.col("value").alias("speed"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival, key, ts, team_name, engine_temperature)."""
    e = _events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value")
    return metrics_from(e, roster(spark, sf_dir))


def metrics_from(e: DataFrame, ro: DataFrame) -> DataFrame:
    """The metrics mapping over any events frame (batch or streaming)."""
    return e.join(ro, (e.user_id % N_DRIVERS) == ro.id).select(
        F.col("event_id").alias("arrival"),
        F.col("event_type").alias("key"),
        F.col("ts"),
        F.col("team").alias("team_name"),
        F.col("value").alias("engine_temperature"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commentary messages: (conv_id, turn, id, message, timestamp ms, type).

    The turn's role gives the type: system -> highlight, assistant -> warning, user -> no
    type (the decoder then applies the default). timestamp = conv_id * 1000 + turn.
    """
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.select(
        "conv_id", "turn",
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("message"),
        (F.col("conv_id") * 1000 + F.col("turn")).cast("double").alias("timestamp"),
        F.when(F.col("role") == "system", F.lit("highlight"))
         .when(F.col("role") == "assistant", F.lit("warning")).alias("type"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding array<float>, label)."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """The canonical inputs as SQL temp views (roster, positions, metrics, comments,
    corpus), so the same operators can be written as SQL over them."""
    for name, fn in [("roster", roster), ("positions", positions), ("metrics", metrics),
                     ("comments", comments), ("corpus", corpus)]:
        fn(spark, sf_dir).createOrReplaceTempView(name)
