"""Streaming anomaly detector with a reorder buffer (W1 on streams, H1, H2, H6).

Every micro-batch is scored by the batch operator, so a team that holds most of a batch spreads over many
tasks and the doubles are those of the batch:

* Rows wait in the *buffer* until the watermark (the newest event time seen, less ``delay_ms``)
  has passed them; released rows are later than all that were released before, so peers of one
  millisecond are scored together, whatever the batches were.
* The *carry* table holds one row a team: the exact sums of everything released so far (AR(1): the last
  value, too). The batch operator's prefix sums start from it.
* A row that the watermark had passed when it came is *late*: it is not scored but written to the
  late output, as is a row without event time. Nothing is dropped silently.

A team without a released row for ``ttl_ms`` of processing time starts afresh (the streaming-SQL state TTL was 24 h).
All tables are written per batch id (see ``batches``). ``drain`` scores what is still held when
a bounded replay has ended; a query that goes on later takes the drained batch back.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pitwall.functions import exprs as X
from pitwall.operators import anomaly
from pitwall.operators.anomaly import CONFIDENCE_PCT, MIN_TRAINING
from pitwall.schemas import assert_contract
from pitwall.session import remove, stored
from pitwall.streaming import runner
from pitwall.streaming.batches import Carry

TTL_MS = 24 * 3600 * 1000
DELAY_MS = 60_000
ROW = "arrival long, key string, ts timestamp, team_name string, engine_temperature double"
_SUMS = {"gaussian": "_n decimal(38,0), _s1 decimal(38,0), _s2 decimal(38,0)",
         "ar1": "_n decimal(38,0), _sx decimal(38,0), _sy decimal(38,0), _sxx decimal(38,0), _syy decimal(38,0), _sxy decimal(38,0), _v long"}
SCORED = ROW + ", ts_ms long, n long, forecast double, lower double, upper double, is_anomaly boolean"
_COLUMNS = [c.split()[0] for c in SCORED.split(", ")]
_FOREVER = 1 << 62


class Detector:
    """State and outputs of one detector below ``base``: scored, late, held, carry, mark."""

    def __init__(self, spark: SparkSession, base: str, method: str = "gaussian", delay_ms: int = DELAY_MS,
                 confidence_pct: float = CONFIDENCE_PCT, min_training: int = MIN_TRAINING, ttl_ms: int | None = TTL_MS):
        self.spark, self.base, self.method, self.delay_ms, self.ttl_ms = spark, base, method, delay_ms, ttl_ms
        self.options = {"confidence_pct": confidence_pct, "min_training": min_training}
        self.held = Carry(spark, f"{base}/held", ROW)
        self.carry = Carry(spark, f"{base}/carry", f"team_name string, {_SUMS[method]}, updated_ms long")
        self.mark = Carry(spark, f"{base}/mark", "passed_ms long, batch_id long")
        self.scored_path, self.late_path = f"{base}/scored", f"{base}/late"

    def process(self, batch: DataFrame, batch_id: int, everything: bool = False) -> None:
        """Score what the watermark lets go after ``batch``; ``everything``: also what is held."""
        names = [c.split()[0] for c in ROW.split(", ")]
        rows = stored(batch.select(*names), "detector-batch")
        passed = self.mark.of(batch_id - 1).first()
        passed = passed.passed_ms if passed else -_FOREVER
        ms = X.ts_to_ms("ts")
        late = F.coalesce(ms <= passed, F.lit(True))
        rows.where(late).withColumn("passed_ms", F.lit(passed)).write.mode("overwrite").parquet(f"{self.late_path}/batch_id={batch_id}")
        waiting = rows.where(~late).unionByName(self.held.of(batch_id - 1))
        newest = waiting.agg(F.max(ms)).first()[0]
        if newest is not None:
            passed = max(passed, newest if everything else newest - self.delay_ms)
        ready = stored(waiting.where(ms <= passed), "detector-ready")
        now = int(time.time() * 1000)
        before = self.carry.of(batch_id - 1)
        if self.ttl_ms:
            before = before.where(F.col("updated_ms") > now - self.ttl_ms)
        scored = anomaly.detect(ready, self.method, carry=before, **self.options).select(*_COLUMNS)
        scored.write.mode("overwrite").parquet(f"{self.scored_path}/batch_id={batch_id}")
        after = anomaly.totals(ready, self.method, carry=before)
        touched = ready.select("team_name").distinct().select(F.col("team_name").alias("t"))
        stamps = before.select(F.col("team_name").alias("u"), "updated_ms")
        after = (after.join(touched, F.col("team_name").eqNullSafe(F.col("t")), "left_semi").withColumn("updated_ms", F.lit(now))
                 .unionByName(after.join(touched, F.col("team_name").eqNullSafe(F.col("t")), "left_anti")
                              .join(stamps, F.col("team_name").eqNullSafe(F.col("u"))).drop("u")))
        self.carry.write(after, batch_id)
        self.held.write(waiting.where(ms > passed), batch_id)
        self.mark.write(self.spark.createDataFrame([(passed, batch_id)], self.mark.schema), batch_id)
        for table in (self.held, self.carry, self.mark):
            table.forget(batch_id)
        for used in (rows, ready):
            for f in {f.rsplit("/", 1)[0] for f in used.inputFiles()}:
                remove(self.spark, f)

    def start(self, metrics: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Streaming query over (arrival, key, ts, team_name, engine_temperature); other types are refused before it starts."""
        assert_contract(metrics, StructType.fromDDL(ROW))
        return runner.start_foreach(metrics, lambda batch, batch_id: self.process(batch, batch_id), checkpoint, "append", trigger)

    def drain(self, batch_id: int) -> None:
        """Score what is held after the last batch of a bounded input; ``batch_id`` is the one the query would use next."""
        self.process(self.spark.createDataFrame([], ROW), batch_id, everything=True)

    def scored(self) -> DataFrame:
        return self.spark.read.schema(SCORED + ", batch_id long").parquet(self.scored_path).select(*_COLUMNS)

    def late(self) -> DataFrame:
        """Rows that were not scored, with the watermark that had passed them and their batch."""
        return self.spark.read.schema(ROW + ", passed_ms long, batch_id long").parquet(self.late_path)


def run(detector: Detector, metrics: DataFrame, checkpoint: str) -> Detector:
    """Replay a bounded stream to its end."""
    q = detector.start(metrics, checkpoint)
    runner.finish(q)
    detector.drain(runner.next_batch(q))
    return detector
