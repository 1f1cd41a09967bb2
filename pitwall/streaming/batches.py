"""Tables that a ``foreachBatch`` query carries from one micro-batch to the next.

A table lives in a folder with one ``batch_id=N`` folder for each batch that wrote it. Batch N
reads what batch N - 1 left and overwrites its own folder, so that a retried batch repeats itself and
changes nothing. Folders that no retry can need any more are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitwall.session import remove
from pitwall.sinks import bounded_history

#: Folders kept behind the newest: the one before it serves a retry.
KEPT = 2


class Carry:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def of(self, batch_id: int) -> DataFrame:
        """What batch ``batch_id`` wrote; nothing before the first batch."""
        if batch_id < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch_id={batch_id}")

    def write(self, df: DataFrame, batch_id: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        return self.of(batch_id)

    def forget(self, batch_id: int) -> None:
        """Called when batch ``batch_id`` has written everything."""
        if batch_id >= KEPT:
            remove(self.spark, f"{self.path}/batch_id={batch_id - KEPT}")


class LastN:
    """S7 on a stream: the newest ``n`` rows of every key, carried from batch to batch.

    Each task keeps at most ``n`` rows of a key before the shuffle (``sinks.bounded_history``), so a hot key
    costs no more than the others. Rows may come in any order; ``order`` must tell them apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], n: int):
        self.carry, self.keys, self.order, self.n, self.last = Carry(spark, path, schema), keys, order, n, -1

    def process(self, batch: DataFrame, batch_id: int) -> None:
        before = self.carry.of(batch_id - 1)
        both = before.unionByName(batch.select(*before.columns)).dropDuplicates([*self.keys, *self.order])
        self.carry.write(bounded_history(both, self.keys, self.order, self.n), batch_id)
        self.carry.forget(batch_id)
        self.last = batch_id

    def rows(self) -> DataFrame:
        return self.carry.of(self.last)
