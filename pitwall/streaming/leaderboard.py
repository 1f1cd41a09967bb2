"""Streaming leaderboard state (G1-G3 on streams, H3, K7).

* ``latest``: stateful aggregation ``max_by(row, arrival)`` per (race, driver) in update
  mode: each micro-batch emits the changed keys; state lives in the state store
  (RocksDB provider), recovered from the checkpoint after a restart.
* ``BoundedLists``: the capped list per race, carried from batch to batch as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitwall import sinks
from pitwall.operators import capped, leaderboard as lb
from pitwall.schemas import assert_contract
from pitwall.session import stored
from pitwall.streaming.batches import Carry

LATEST_COLS = ["arrival", "ts", "position", "team_name", "speed"]


def latest(positions: DataFrame) -> DataFrame:
    """Update-mode aggregation; the same expression as the batch operator."""
    return lb.latest(positions)


def start_latest(positions: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """Upsert every micro-batch's changed (race, driver) rows into ``out_path``."""
    from pitwall.streaming.runner import start_foreach
    return start_foreach(latest(positions), sinks.upsert_batch(out_path, list(lb.KEYS), "arrival", LATEST_COLS),
                         checkpoint, "update", trigger)


ROW = "arrival long, ts timestamp, race_id string, driver_name string, position int, team_name string, speed double"
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


class BoundedLists:
    """G3 over a stream: every race's capped list with the latest message of each listed driver.

    A micro-batch is folded by the batch operator, in chunks that start from the lists carried over (at most
    ``cap`` rows a race, see ``batches``), so a race that holds most of a batch spreads over many tasks.
    Messages of a race must reach the stream in arrival order across batches (one race key is one topic
    partition); inside a batch any order will do. A race without a message for ``idle_ms`` of event time is evicted (H4);
    one that reports again starts with an empty list.
    """

    def __init__(self, spark: SparkSession, base: str, cap: int = lb.CAP, chunk: int = capped.CHUNK, idle_ms: int | None = None):
        self.spark, self.cap, self.chunk, self.idle_ms = spark, cap, chunk, idle_ms
        self.carry = Carry(spark, f"{base}/lists", ROW + ", slot int")
        self.mark = Carry(spark, f"{base}/mark", "newest timestamp, batch_id long")
        self.last = -1

    def process(self, batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch.select(*_COLUMNS), "bounded-batch")
        before = self.carry.of(batch_id - 1)
        initial = before.groupBy("race_id").agg(F.sort_array(F.collect_list(F.struct("slot", "driver_name"))).alias("s")).select("race_id", F.col("s.driver_name").alias("slots"))
        lists, _ = capped.chunk_lists(rows, self.cap, self.chunk, initial)
        after = capped.with_values(capped.members(lists, initial), rows.unionByName(before.drop("slot"))).select(*_COLUMNS, "slot")
        if self.idle_ms is not None:
            newest = rows.select(F.max("ts").alias("newest")).unionByName(self.mark.of(batch_id - 1).select("newest")).agg(F.max("newest").alias("newest"))
            newest = self.mark.write(newest.select("newest", F.lit(batch_id).cast("long").alias("batch_id")), batch_id).first().newest
            live = after.groupBy(capped.race_key().alias("rk")).agg(F.max("ts").alias("seen")).where(F.unix_millis("seen") >= F.unix_millis(F.lit(newest)) - self.idle_ms)
            after = after.join(live, capped.race_key() == F.col("rk"), "left_semi")
            self.mark.forget(batch_id)
        self.carry.write(after, batch_id)
        self.carry.forget(batch_id)
        self.last = batch_id

    def start(self, positions: DataFrame, checkpoint: str, trigger: dict | None = None):
        from pitwall.streaming.runner import start_foreach
        assert_contract(positions, StructType.fromDDL(ROW))
        return start_foreach(positions, lambda batch, batch_id: self.process(batch, batch_id), checkpoint, "append", trigger)

    def lists(self, batch_id: int | None = None) -> DataFrame:
        """The lists after ``batch_id`` (the last one processed here)."""
        return self.carry.of(self.last if batch_id is None else batch_id).select("race_id", "driver_name", "slot", "arrival", "ts", "position", "team_name", "speed")
