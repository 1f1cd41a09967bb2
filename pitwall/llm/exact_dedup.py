"""Exact dedup (operator 11): two passes of Bloom filters, in DataFrame functions alone.

Texts are equal when they are identical after A-Z is lower-cased. The first pass is a counting
Bloom filter: every text sets two cells of a filter that has ``cells_per_row`` cells a row, and
the tasks' counts are summed (a cell and a count a row, combined before the shuffle). Cells
that were set twice go into the second filter, a bitmap of at most ``most_bits`` bits whatever
the input: that is what is broadcast. The second pass reads the rows again and tests both cells of
each. A row that fails is unique and passes straight through; the others may be repeated: only
these shuffle, and only their groups, by SHA-256, decide. When more cells repeat than the bitmap
holds well, it lets more unique rows into the exact step; nothing is lost.

No group meets in one task: groups are counted by partial aggregation, and groups of more than
``rows / hot_groups`` rows (there are fewer than ``hot_groups``) come to their rows by
broadcast, the others by a join in which no key has more rows than that.

Of equal texts the row with the largest id stays; a null id counts as the smallest. Rows that
repeat an id and a text are copies, too: exactly one of them stays (the first in the order of
partitions). Null text is empty, and equal to empty. An empty table gives no rows. Texts of any length
are one hash to everything after the first step. Extra columns don't matter: ``mark_duplicates`` leaves them out,
``drop_duplicates`` carries the whole input row as one struct and returns the input's columns as they were, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.llm import common as C

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of one bitmap as Spark's bitmap functions build it.
_BUCKET = 32768


@dataclass(frozen=True)
class Params:
    cells_per_row: int = 256
    #: Size bound of the broadcast bitmap: 2**28 bits are 32 MB.
    most_bits: int = 1 << 28
    bits_per_cell: int = 16
    hot_groups: int = 1000


def normalised(text):
    """The text whose equality counts: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def _power(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(n, 1))))


def _cells(cells: int):
    """The two cells of a text, from its SHA-256."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(j), "text_sha256"), 65 - cells.bit_length()) for j in (0, 1)]


def repeated_cells(keys: DataFrame, cells: int) -> DataFrame:
    """First pass over ``keys`` (text_sha256): the cells that rows set more than once."""
    return keys.select(F.explode(F.array(*_cells(cells))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")


def bitmaps(cells: DataFrame, bits: int) -> DataFrame:
    """The second filter: (bucket, bitmap) over ``bits`` bits, at most bits / 32768 rows of 4 KB."""
    at = _position(F.col("cell"), bits)
    return cells.select(at.alias("at")).groupBy(F.floor(F.col("at") / _BUCKET).alias("bucket")).agg(F.expr(f"bitmap_construct_agg(at % {_BUCKET})").alias("bitmap"))


def _position(cell, bits: int):
    return F.pmod(F.xxhash64(F.lit("second"), cell), F.lit(bits))


def _is_set(bitmap, at):
    """Whether bit ``at`` of its bucket's bitmap is set (bit 0 is the lowest of the first byte)."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at % _BUCKET / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.expr("1") == F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)), F.lit(False))


def flagged(keys: DataFrame, p: Params) -> DataFrame:
    """``keys`` (text_sha256, ...) with ``maybe``: whether the filters leave it possible that the text repeats."""
    cells = _power(p.cells_per_row * keys.count())
    found = C.stored(repeated_cells(keys, cells), "repeated-cells")
    bits = max(_BUCKET, min(p.most_bits, _power(p.bits_per_cell * found.count())))
    filters = F.broadcast(C.stored(bitmaps(found, bits), "bitmaps"))
    out = keys
    for j, cell in enumerate(_cells(cells)):
        at = F.col(f"at{j}")
        out = (out.withColumn(f"at{j}", _position(cell, bits))
               .join(filters.select(F.col("bucket").alias(f"bucket{j}"), F.col("bitmap").alias(f"bitmap{j}")), F.floor(at / _BUCKET) == F.col(f"bucket{j}"), "left"))
    return out.select(*keys.columns, (_is_set(F.col("bitmap0"), F.col("at0")) & _is_set(F.col("bitmap1"), F.col("at1"))).alias("maybe"))


def sieve(keys: DataFrame, p: Params = Params(), most: int | None = None) -> tuple[DataFrame, int]:
    """A filter of ``keys`` (cell long; at most ``most``, which are counted where it isn't known) for ``sifted``: its stored bitmaps, to be broadcast, and their bits."""
    bits = max(_BUCKET, min(p.most_bits, _power(p.bits_per_cell * (keys.count() if most is None else most))))
    return C.stored(bitmaps(keys, bits).coalesce(1), "bitmaps"), bits


def sifted(rows: DataFrame, key: str, by: tuple[DataFrame, int], maybe: str) -> DataFrame:
    """``rows`` with ``maybe``: false only where the filter's keys don't have the row's ``key``. Nothing shuffles."""
    filters, bits = by
    at = _position(F.col(key), bits)
    found = rows.join(F.broadcast(filters.select(F.col("bucket").alias("sieve_bucket"), F.col("bitmap").alias("sieve_bitmap"))), F.floor(at / _BUCKET) == F.col("sieve_bucket"), "left")
    return found.select(*rows.columns, _is_set(F.col("sieve_bitmap"), at).alias(maybe))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and the input row as struct ``row``."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))


def _marked(keys: DataFrame, p: Params) -> DataFrame:
    """``keys`` (doc_id, text_sha256, maybe row) with keep_id, group_size and kept."""
    marked = flagged(keys, p)
    once = marked.filter(~F.col("maybe")).select(*keys.columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = marked.filter("maybe").select(*keys.columns)

    by_id = again.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.coalesce("doc_id", F.lit(-(2**63)))).alias("ties"))
    groups = C.stored(groups.filter("group_size > 1"), "copy-groups")
    total, ties = groups.agg(F.sum("group_size"), F.max("ties")).first()
    least = max(1, (total or 0) // p.hot_groups)
    hot = F.broadcast(groups.filter(F.col("group_size") > least).select(F.col("text_sha256").alias("h"), F.struct("keep_id", "group_size", "ties").alias("hot")))
    # rows of hot groups are done: they get a key that no group has, and spread
    spread = again.join(hot, F.col("text_sha256") == F.col("h"), "left").withColumn(
        "key", F.when(F.col("hot").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("hot "), F.xxhash64("doc_id").cast("string"))))
    cold = groups.filter(F.col("group_size") <= least).select(F.col("text_sha256").alias("key"), F.struct("keep_id", "group_size", "ties").alias("cold"))
    both = spread.join(cold, "key", "left").select(*keys.columns, F.coalesce("hot", "cold").alias("g"))
    one = F.col("g").isNull()
    held = both.select(*keys.columns, F.when(one, F.col("doc_id")).otherwise(F.col("g.keep_id")).alias("keep_id"),
                       F.when(one, F.lit(1).cast("long")).otherwise(F.col("g.group_size")).alias("group_size"),
                       (one | F.col("doc_id").eqNullSafe(F.col("g.keep_id"))).alias("kept"), F.coalesce("g.ties", F.lit(1)).alias("ties"))
    if (ties or 1) > 1:
        # an id repeats with its text: the first row of each partition, then the first of those
        tied = F.col("kept") & (F.col("ties") > 1)
        local = Window.partitionBy("text_sha256", "part").orderBy("doc_id")
        across = Window.partitionBy("text_sha256", F.when(F.col("nth") == 1, F.lit(-1)).otherwise(F.col("part"))).orderBy("part", "nth")
        first = (held.filter(tied).withColumn("part", F.spark_partition_id()).withColumn("nth", F.row_number().over(local))
                 .withColumn("kept", (F.row_number().over(across) == 1) & (F.col("nth") == 1)).select(*held.columns))
        held = held.filter(~tied).unionByName(first)
    return once.unionByName(held.drop("ties"))


def mark_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256. Texts are read once."""
    keys = C.stored(keyed(docs).drop("row"), "text-keys")
    return _marked(keys, p).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the rows whose text has a copy that stays: the same columns. Unique rows don't shuffle."""
    return _marked(keyed(docs), p).filter("kept").select("row.*")


SQL = f"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM t
"""
