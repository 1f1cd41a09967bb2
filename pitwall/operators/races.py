"""Race lifecycle, status, laps and history.

A race is identified by race_id; its start is the event time of its first message, its
selected driver the driver of that message, its duration a parameter (60 s by default).
All "now" values are an explicit ``asof`` so results are reproducible.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.operators import sequence

DURATION_S = 60            # default race length (fixed value of the behaviour)
EVICT_AFTER = "1 hour"     # finished races older than this are dropped
STATUSES = ("not_started", "in_progress", "finished")


def _ts_lit(asof) -> F.Column:
    """An as-of instant as a literal. Naive values are UTC wall clock; the literal is
    built from text in the session zone (UTC), never from the Python process's zone."""
    if isinstance(asof, str):
        asof = dt.datetime.fromisoformat(asof)
    if asof.tzinfo is not None:
        asof = asof.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(asof.isoformat(sep=" ")).cast("timestamp")


def races(positions: DataFrame, duration_s: int = DURATION_S) -> DataFrame:
    """(race_id, selected_driver, start_time, end_time, duration) per race."""
    g = (positions.where(F.col("race_id").isNotNull()).groupBy("race_id")
         .agg(F.min("ts").alias("start_time"), F.min_by("driver_name", "arrival").alias("selected_driver")))
    return g.select("race_id", "selected_driver", "start_time",
                    (F.col("start_time") + F.make_interval(secs=F.lit(duration_s))).alias("end_time"),
                    F.lit(duration_s).cast("int").alias("duration"))


def _elapsed_s(start: F.Column, now: F.Column) -> F.Column:
    return (F.unix_micros(now) - F.unix_micros(start)).cast("double") / 1_000_000.0


def status(race_df: DataFrame, asof) -> DataFrame:
    """B21/B22 as of an instant: status, progress, elapsed and remaining seconds."""
    now = _ts_lit(asof)
    el = F.when(now < F.col("start_time"), F.lit(0.0)).otherwise(_elapsed_s(F.col("start_time"), now))
    st = (F.when(F.col("start_time").isNull() | (now < F.col("start_time")), F.lit(STATUSES[0]))
          .when(el >= F.col("duration"), F.lit(STATUSES[2]))
          .otherwise(F.lit(STATUSES[1])))
    prog = (F.when(st == STATUSES[0], F.lit(0.0)).when(st == STATUSES[2], F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), el / F.col("duration").cast("double"))))
    return race_df.select(
        "race_id", "selected_driver", st.alias("status"), prog.alias("progress"),
        el.alias("elapsed_s"),
        F.greatest(F.lit(0.0), F.col("duration").cast("double") - el).alias("remaining_s"),
        "duration", "start_time", "end_time")


def finished(status_df: DataFrame) -> DataFrame:
    """The finished races."""
    return status_df.where(F.col("status") == STATUSES[2])


def evicted(status_df: DataFrame, asof, ttl: str = EVICT_AFTER) -> DataFrame:
    """H4: finished races whose end is older than ``ttl`` before ``asof``."""
    cutoff = _ts_lit(asof) - F.expr(f"INTERVAL {ttl}")
    return finished(status_df).where(F.col("end_time") < cutoff)


def lifecycle(race_df: DataFrame) -> DataFrame:
    """H5 (batch form): the status transitions of each race with their instants."""
    return race_df.select("race_id", F.explode(F.array(
        F.struct(F.lit(STATUSES[1]).alias("status"), F.col("start_time").alias("at")),
        F.struct(F.lit(STATUSES[2]).alias("status"), F.col("end_time").alias("at")))).alias("t")
    ).select("race_id", "t.status", "t.at")


def _with_race(positions: DataFrame, race_df: DataFrame) -> DataFrame:
    # one row per race, derived from the data: no hint, adaptive execution broadcasts it
    # from its measured size (and keeps the shuffle join when it is large)
    r = race_df.select("race_id", F.col("start_time").alias("_start"), F.col("duration").alias("_dur"))
    return positions.join(r, "race_id")


def laps(positions: DataFrame, race_df: DataFrame) -> DataFrame:
    """lap = max(1, floor(elapsed / 10) + 1) for each position message."""
    p = _with_race(positions, race_df)
    el = _elapsed_s(F.col("_start"), F.col("ts"))
    return p.select("arrival", "race_id", "driver_name", el.alias("elapsed_s"), X.lap_number(el).alias("lap"))


def history(positions: DataFrame, race_df: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """Per (race, driver) the ordered position history with race progress.

    The sequence number is an exclusive running count per (race, driver), computed in
    offset chunks so that a hot driver is spread over many tasks.
    """
    p = _with_race(positions, race_df)
    el = _elapsed_s(F.col("_start"), F.col("ts"))
    p = p.select("arrival", "race_id", "driver_name", "position", "ts",
                 F.least(F.lit(1.0), F.greatest(F.lit(0.0), el / F.col("_dur").cast("double"))).alias("progress"))
    s = sequence.prefix_sums(p, ["race_id", "driver_name"], ["arrival"],
                             sequence.offset_chunk("arrival", chunk_rows), {"_before": F.lit(1)})
    return s.withColumn("seq", (F.col("_before") + 1).cast("long")).drop("_before")


def validate(requests: DataFrame, roster: DataFrame, name_col: str = "driver_name"):
    """(known, unknown) requests by driver name: left semi / left anti joins."""
    ro = roster.select(F.col("name").alias("_n"))
    cond = F.col(name_col) == F.col("_n")
    return requests.join(ro, cond, "left_semi"), requests.join(ro, cond, "left_anti")
