"""K3: a keyed table that merges, with snapshots.

Below ``path``:

* ``delta/batch_id=N``: the last row per key of batch N, ``bucket`` (hash of the key) as partition folders.
* ``base/batch_id=N``: buckets rewritten by the compaction that batch N ran: one row per key.
* ``manifest/batch_id=N``: the snapshot that batch N committed: for each bucket the folders that make
  it up, with their row counts. It is written last, so a batch counts only when all its files are there.

Batch N starts from the manifest of batch N - 1 and overwrites its own folders, so a retried batch repeats itself.
A bucket with more than ``max_deltas`` deltas, or with more rows in deltas than ``ratio`` times those in its base, is
rewritten, and no other: the work of a batch follows the buckets that it touched, not the table. Folders that neither of the
last two snapshots needs are removed, so their number is bounded by buckets and deltas, not by batches.

The newest row of a key is that of the largest ``order`` (unique per key; a repeated row changes nothing). A row whose ``deleted`` column is true removes
its key (a tombstone); it stays in its bucket, as an older row of the key may still come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.session import remove
from pitwall.sinks import latest_per_key

MANIFEST = "bucket int, folder string, batch_id long, is_base boolean, n_rows long"
BUCKETS, MAX_DELTAS, RATIO = 64, 4, 0.5


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The batch ids that have a folder below ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))


class UpsertTable:
    """``schema`` (DDL) holds the keys, ``order`` and, where rows can delete, a boolean ``deleted``.

    ``buckets`` is fixed for a table's life; about one per GB of the table keeps a rewrite within a few tasks."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: str, buckets: int = BUCKETS,
                 max_deltas: int = MAX_DELTAS, ratio: float = RATIO, deleted: str | None = None):
        self.spark, self.path, self.schema = spark, path, T.StructType.fromDDL(schema)
        self.keys, self.order, self.buckets, self.deleted = list(keys), order, buckets, deleted
        self.max_deltas, self.ratio = max_deltas, ratio
        self.values = [f.name for f in self.schema.fields if f.name not in self.keys]

    # --- snapshots -------------------------------------------------------------------------

    def snapshots(self) -> list[int]:
        """Batch ids with a committed manifest, oldest first."""
        return [n for n in _numbers(self.spark, f"{self.path}/manifest") if _exists(self.spark, f"{self.path}/manifest/batch_id={n}/_SUCCESS")]

    def manifest(self, batch_id: int) -> list:
        """The folders of one snapshot: at most ``buckets * (max_deltas + 1)`` rows."""
        if batch_id < 0 or not _exists(self.spark, f"{self.path}/manifest/batch_id={batch_id}/_SUCCESS"):
            return []
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/batch_id={batch_id}").collect()

    def read(self, batch_id: int | None = None) -> DataFrame:
        """The table as of a snapshot (the newest by default); a later commit doesn't change what a reader sees."""
        have = self.snapshots()
        at = batch_id if batch_id is not None else (have[-1] if have else -1)
        if batch_id is not None and batch_id not in have:
            raise ValueError(f"no snapshot {batch_id}; kept are {have}")
        now = self._newest(self._rows(self.manifest(at)))
        return now.where(~F.coalesce(F.col(self.deleted), F.lit(False))).drop(self.deleted) if self.deleted else now

    # --- writing ---------------------------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function: merge ``batch`` and commit snapshot ``batch_id``."""
        before = self.manifest(batch_id - 1)
        earlier = [n for n in self.snapshots() if n < batch_id]
        if earlier and batch_id - 1 not in earlier:
            raise ValueError(f"snapshot {batch_id - 1} is not there; the table goes on from the batch after its last one")
        entries = before + self._write(self._newest(batch.select(*self.schema.fieldNames())), "delta", batch_id)
        full = self._full(entries)
        if full:
            old = [e for e in entries if e.bucket in full]
            entries = [e for e in entries if e.bucket not in full] + self._write(self._newest(self._rows(old)), "base", batch_id)
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch_id={batch_id}")
        self._forget(batch_id, entries, before)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, self.keys, self.order, self.values).select(*self.schema.fieldNames())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> list:
        folder = f"{self.path}/{kind}/batch_id={batch_id}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        counts = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
        return [Row(bucket=r["bucket"], folder=f"{kind}/batch_id={batch_id}/bucket={r['bucket']}", batch_id=batch_id, is_base=kind == "base", n_rows=r["count"])
                for r in counts.groupBy("bucket").count().collect()]

    def _rows(self, entries: list) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{e.folder}" for e in entries])

    def _full(self, entries: list) -> set[int]:
        deltas, added, held = {}, {}, {}
        for e in entries:
            if e.is_base:
                held[e.bucket] = e.n_rows
            else:
                deltas[e.bucket] = deltas.get(e.bucket, 0) + 1
                added[e.bucket] = added.get(e.bucket, 0) + e.n_rows
        return {b for b, n in deltas.items() if n > self.max_deltas or (n > 1 and added[b] > self.ratio * held.get(b, 0))}

    def _forget(self, batch_id: int, entries: list, before: list) -> None:
        """Drop the folders and manifests that snapshots ``batch_id`` and ``batch_id - 1`` don't need."""
        used = {e.folder for e in (*entries, *before)}
        for n in [n for n in _numbers(self.spark, f"{self.path}/manifest") if n < batch_id - 1]:
            for e in self.manifest(n):
                if e.folder not in used:
                    remove(self.spark, f"{self.path}/{e.folder}")
            remove(self.spark, f"{self.path}/manifest/batch_id={n}")
        for kind in ("delta", "base"):
            for n in _numbers(self.spark, f"{self.path}/{kind}"):
                if n < batch_id - 1 and not any(f.startswith(f"{kind}/batch_id={n}/") for f in used):
                    remove(self.spark, f"{self.path}/{kind}/batch_id={n}")
