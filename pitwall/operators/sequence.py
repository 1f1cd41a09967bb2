"""Ordered per-key computations that survive hot keys.

``lag`` and running sums per key are naturally written as a window over the key. With a
window partitioned by the key alone, one hot key (say a third of all rows) lands in one
task. Here every key's sequence is cut into chunks (a column the caller derives from the
ordering value: an offset range or a time bucket), the window runs per (key, chunk) in
parallel, and the chunk boundaries are fixed with a small per-(key, chunk) summary table:

1. per-row values inside the chunk (window over key + chunk: the one shuffle of rows);
2. one summary row per (key, chunk) by a partial aggregation over a column-pruned
   second read of the input: only one row per (key, chunk) and map task is shuffled
   (reusing step 1's shuffle output instead would re-read every row);
3. a window over the summary table per key, ordered by chunk (few rows per key);
4. an equi-join of the summary back onto the rows on (key, chunk). The row side is
   already hash-partitioned on exactly these columns by step 1, so only the summary moves.

With ``keep_parts=True`` the partitioning columns stay in the output, and a following
call on the same keys and chunks reuses the partitioning instead of shuffling again.

Keys may be null; they are replaced by (coalesced value, is-null flag) column pairs so
that a plain equi-join (which keeps the step-1 partitioning) still matches null keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _default_for(dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, (T.IntegralType, T.FractionalType, T.DecimalType)):
        return F.lit(0).cast(dt)
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(dt)


PART_COLS = ("_kv", "_kn", "_chunk")


def _norm_keys(df: DataFrame, keys: Sequence[str], chunk: Column) -> tuple[DataFrame, list[str]]:
    """Add the (value, is-null) key pairs and ``_chunk`` unless a previous helper call
    left them in place (then its partitioning is reused and no new shuffle is needed)."""
    names = [n for i in range(len(keys)) for n in (f"_kv{i}", f"_kn{i}")]
    if all(n in df.columns for n in names) and "_chunk" in df.columns:
        return df, names
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for i, k in enumerate(keys):
        cols.append(F.coalesce(F.col(k), _default_for(types[k])).alias(f"_kv{i}"))
        cols.append(F.col(k).isNull().alias(f"_kn{i}"))
    return df.select("*", *cols, chunk.alias("_chunk")), names


def _out_cols(df: DataFrame, keep_parts: bool) -> list[str]:
    return [c for c in df.columns if keep_parts or not c.startswith(PART_COLS)]


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
             cols: Sequence[str], prefix: str = "prev_", keep_parts: bool = False,
             carry: DataFrame | None = None) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row of the same key by
    ``order`` (null on the key's first row). ``keep_parts`` leaves the partitioning
    columns for a following helper call on the same keys and chunks. ``carry`` (keys and
    cols, one row per key) holds the row before a key's first one."""
    base, kn = _norm_keys(df, keys, chunk)
    part = [*kn, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    row = F.struct(*[F.col(c) for c in cols])
    local = base.select("*", F.lag(row).over(w).alias("_lag"),
                        (F.row_number().over(w) == 1).alias("_first"))
    # per-chunk summary: the chunk's last row, by a partial aggregation (one row per
    # (key, chunk) and map task crosses the shuffle)
    last = base.groupBy(*part).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    carried = last.select(*part, F.lag("_last").over(
        Window.partitionBy(*kn).orderBy("_chunk")).alias("_carry"))
    if carry is not None:
        before, _ = _norm_keys(carry, keys, F.lit(0))
        carried = (carried.join(before.select(*kn, F.struct(*cols).alias("_start")), kn, "left")
                   .select(*part, F.coalesce("_carry", "_start").alias("_carry")))
    joined = local.join(carried, part, "inner")
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))
    keep = [c for c in _out_cols(base, keep_parts)]
    return joined.select(*keep, *[prev.getField(c).alias(prefix + c) for c in cols])


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                sums: dict[str, Column], range_order: bool = False, keep_parts: bool = False,
                carry: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Add one exact exclusive prefix sum per entry of ``sums`` (name -> integral column; with ``exact=False``
    any number, summed as doubles).

    ``range_order=False``: rows strictly before the current row by ``order`` (a total
    order). ``range_order=True``: rows whose single ``order`` value is strictly smaller
    (peers share one history, SQL RANGE semantics); ``chunk`` must then be a function of
    the order value so that peers never straddle a chunk boundary.

    ``carry`` (keys and one column per sum, one row per key) holds the sums before a key's
    first row.

    Results are DECIMAL(38,0): chunk totals are summed as decimals so that the running
    value cannot overflow however many rows a key holds.
    """
    base, kn = _norm_keys(df, keys, chunk)
    part = [*kn, "_chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    frame = (w.rangeBetween(Window.unboundedPreceding, -1) if range_order
             else w.rowsBetween(Window.unboundedPreceding, -1))
    dec = T.DecimalType(38, 0) if exact else T.DoubleType()
    local = base.select("*", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).cast(dec).alias(f"_l_{n}")
                               for n, c in sums.items()])
    # per-chunk totals by a partial aggregation (one row per (key, chunk) and map task
    # crosses the shuffle)
    tot = base.groupBy(*part).agg(*[F.sum(c).cast(dec).alias(f"_t_{n}") for n, c in sums.items()])
    wo = Window.partitionBy(*kn).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, *[F.coalesce(F.sum(f"_t_{n}").over(wo), F.lit(0)).cast(dec).alias(f"_o_{n}")
                              for n in sums])
    if carry is not None:
        before, _ = _norm_keys(carry, keys, F.lit(0))
        before = before.select(*kn, *[F.col(n).alias(f"_c_{n}") for n in sums])
        off = off.join(before, kn, "left").select(
            *part, *[(F.col(f"_o_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).cast(dec).alias(f"_o_{n}") for n in sums])
    joined = local.join(off, part, "inner")
    return joined.select(*_out_cols(base, keep_parts),
                         *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).cast(dec).alias(n) for n in sums])


def balanced_time_chunk(df: DataFrame, keys: Sequence[str], ms_col: str,
                        target_rows: int = 1_000_000, out: str = "_tchunk",
                        max_keys: int = 100_000) -> DataFrame:
    """Add ``out``: per key, event-time buckets sized so that one bucket holds about
    ``target_rows`` rows at the key's average rate (a hot key gets narrow buckets, a cold
    one a single bucket). The bucket is a function of (key, event time), so peers with
    equal time always share a bucket.

    The sizes come from one small aggregate per key (count, first and last time; a
    column-pruned scan with map-side partial aggregation). Up to ``max_keys`` keys it is
    broadcast as a local relation (bounded, checked by the ``limit``); beyond that the same
    widths reach the rows by a plain join.
    """
    spark = df.sparkSession
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"), F.min(ms_col).alias("_t0"),
                                  F.max(ms_col).alias("_t1"))
    rows = stats.limit(max_keys + 1).collect()

    def width(cnt, t0, t1):
        return F.greatest(F.lit(1), F.ceil((t1 - t0 + 1) * F.lit(target_rows) / cnt)).cast("long")

    small = len(rows) <= max_keys
    local = spark.createDataFrame(rows, stats.schema) if small else stats
    local = local.select(*[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)], "_t0",
                         width(F.col("_cnt"), F.col("_t0"), F.col("_t1")).alias("_w"))
    local = F.broadcast(local) if small else local
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(local[f"_sk{i}"])
        cond = c if cond is None else cond & c
    j = df.join(local, cond, "left")
    bucket = F.floor((F.col(ms_col) - F.col("_t0")) / F.col("_w")).cast("long")
    return j.withColumn(out, F.coalesce(bucket, F.lit(-1).cast("long"))).drop(
        *[f"_sk{i}" for i in range(len(keys))], "_t0", "_w")


def offset_chunk(offset_col: str, width: int) -> Column:
    """Chunk by dense offsets: at most ``width`` rows per chunk and key."""
    return F.floor(F.col(offset_col) / F.lit(width)).cast("long")


def time_chunk(ms_col: str, width_ms: int) -> Column:
    """Chunk by event-time bucket (epoch milliseconds)."""
    return F.floor(F.col(ms_col) / F.lit(width_ms)).cast("long")
