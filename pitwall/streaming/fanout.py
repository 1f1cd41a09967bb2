"""One subscription, several sinks (A1, A3, K5, pipelines E1, E2, E4).

A ``foreachBatch`` query takes a frame of records of several topics (topic, key, value, arrival). Each micro-batch is
written once, so that the source is polled once however many sinks there are; then every topic's route decodes
its records and each output of the route goes to its sink. Nothing is dropped silently: values that a decoder can't parse go to
the ``dead_letters`` table with their topic, records of a topic without a route to ``unrouted``.

Every sink is idempotent by batch id (an append overwrites its own ``batch_id=N`` folder, an ``UpsertTable`` its own
delta), so a batch that is tried again after any of its sinks failed changes nothing in the others.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pitwall import schemas
from pitwall.session import remove, stored
from pitwall.sources import decode, topics
from pitwall.streaming import runner
from pitwall.streaming.upsert import UpsertTable

RECORD = "topic string, key binary, value string, arrival long"
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]


class AppendTable:
    """K5: continuous ``INSERT INTO``; one folder a batch, which a retry overwrites."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, T.StructType.fromDDL(schema)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        schemas.assert_contract(batch, self.schema)
        batch.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(self.path).drop("batch_id")


@dataclasses.dataclass(frozen=True)
class Route:
    """What becomes of one topic: its decoder, the wire schema whose breach makes a dead letter, and each sink with
    the frame that it takes from the decoded records."""
    topic: str
    wire: T.StructType
    decoder: Callable[[DataFrame], DataFrame]
    sinks: tuple[tuple[Callable[[DataFrame], DataFrame], AppendTable | UpsertTable], ...]


class Fanout:
    def __init__(self, spark: SparkSession, base: str, routes: list[Route]):
        if len({r.topic for r in routes}) != len(routes):
            raise ValueError("one route a topic")
        self.spark, self.routes = spark, routes
        self.dead = AppendTable(spark, f"{base}/dead_letters", RECORD)
        self.unrouted = AppendTable(spark, f"{base}/unrouted", RECORD)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        records = stored(batch.select(*_FIELDS), "fanout-batch")
        dead = [decode.split_corrupt(topics.demux(records, r.topic), r.wire)[1].select(*_FIELDS) for r in self.routes]
        for r in self.routes:
            decoded = r.decoder(topics.demux(records, r.topic))
            for shape, sink in r.sinks:
                sink.process(shape(decoded), batch_id)
        every = self.spark.createDataFrame([], RECORD)
        for d in dead:
            every = every.unionByName(d)
        self.dead.process(every, batch_id)
        known = F.coalesce(F.col("topic").isin([r.topic for r in self.routes]), F.lit(False))
        self.unrouted.process(records.where(~known), batch_id)
        for folder in {f.rsplit("/", 1)[0] for f in records.inputFiles()}:
            remove(self.spark, folder)

    def start(self, records: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        schemas.assert_contract(records, T.StructType.fromDDL(RECORD))
        return runner.start_foreach(records, self.process, checkpoint, "append", trigger)
