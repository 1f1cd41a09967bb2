"""Shared numpy kernels and table helpers of the training-data operators.

Texts arrive in Arrow batches; a kernel works on one flat byte buffer of some megabytes at a
time (``text_slices``), so a task's memory is bounded by the slice and its longest text.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.session import remove, scratch_path

SLICE_BYTES = 1 << 20
#: White space of a word boundary: space and 0x09-0x0D.
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}
#: Paths stored within each ``stored_alone`` that this thread is in.
_made = threading.local()
#: Spark's setting by which a write deletes its shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: a lineage cut that outlives executors."""
    return stored_at(df, name)[0]


def written(df: DataFrame, path: str) -> None:
    """``df`` written as Parquet. What this write shuffled is deleted with it, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, was)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and the folder, for a table that is to be removed (``session.remove``) before its user ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    written(df, path)
    if getattr(_made, "open", None):
        _made.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored(build(), name)``, after which the tables that ``build`` stored on the way are removed: the result no longer reads them."""
    if not hasattr(_made, "open"):
        _made.open = []
    _made.open.append([])
    try:
        df = build()
        inner = _made.open[-1]
        path = scratch_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
        written(df, path)
    finally:
        _made.open.pop()
    for used in inner:
        remove(df.sparkSession, used)
    if _made.open:
        _made.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id="doc_id"):
    """Rows never learned from: crc32 of the id's text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 4096) * 5 // 4, base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def text_slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``most`` bytes."""
    if not len(col):
        return
    data, off = flat(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1), lo + 4096)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run without white space; words don't cross texts."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_WS[buf]
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (first | ~before))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~inside[1:] | first[1:]
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each span [start, end) of the buffer (polynomial over random byte values)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = prefix_sums(_LOWER[buf] if lower else buf)
        h = (total[end] - total[start]) * powers(_INV, len(buf) + 1)[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums of byte value times base**position before each position, modulo 2**64."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * powers(_BASE, len(buf)), out=out[1:])
        return out


def byte_windows(buf: np.ndarray, k: int) -> np.ndarray:
    """Rolling 64-bit hash of each k bytes of the buffer."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = prefix_sums(buf)
        return mix((total[k:] - total[:-k]) * powers(_INV, n))


def word_windows(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k consecutive values of ``h`` (in order)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(_BASE, len(h)), out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(_INV, n))


def code_points(buf: np.ndarray) -> np.ndarray:
    """1 at each byte that begins a code point."""
    return (buf & 0xC0) != 0x80


def white(buf: np.ndarray) -> np.ndarray:
    return _WS[buf]


def attach(rows: DataFrame, keys: list[str], table: DataFrame, size: str, most: int = 1000) -> DataFrame:
    """``rows`` with the struct ``found``: the row of ``table`` with the same ``keys`` (null where there is none).

    ``table`` has one row a key, and ``size`` says how many rows have it. Fewer than ``most`` keys can hold more
    than a share of 1 / ``most`` of all: those are broadcast. The others meet their rows in a join in which
    no key has more rows than that share; rows that are served already go there under keys that spread them."""
    table = table.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(size).alias("size"), F.struct(*(c for c in table.columns if c not in keys)).alias("hit"))
    total = table.agg(F.sum("size")).first()[0] or 0
    hot = F.col("size") > max(1, total // most)
    names = [f"k{i}" for i in range(len(keys))]
    large = F.broadcast(table.filter(hot).select(*names, F.col("hit").alias("hot")))
    given = rows.select(F.struct("*").alias("row"), *(F.col(k).alias(f"j{i}") for i, k in enumerate(keys)))
    match = F.lit(True)
    for i in range(len(keys)):
        match = match & (F.col(f"j{i}") == F.col(f"k{i}"))
    given = given.join(large, match, "left").drop(*names)
    served = F.col("hot").isNotNull()
    given = given.withColumn("served", F.when(served, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long")))
    rest = table.filter(~hot).select(*names, F.col("hit").alias("cold"), F.lit(-1).cast("long").alias("open"))
    both = given.join(rest, match & (F.col("served") == F.col("open")), "left")
    return both.select("row.*", F.coalesce("hot", "cold").alias("found"))


def lowered(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[buf]
