"""Best-fit packing (operator 6) of documents into sequences, with conflicts.

A sequence holds up to ``capacity`` words, at most one piece of any source and at most one of any
duplicate cluster. Longer documents are cut into pieces of ``capacity`` words; whole pieces fill a
sequence each, the rest is packed with the other documents, longest first. Open sequences are
ordered by what room they have left; each carries a bitmap of its sources and one of its
clusters. A successor search starts at the tightest sequence that has room and goes on until one is
compatible; if there is none, a new one opens. A block numbers its own sources and clusters, one bit each, so
only real conflicts keep pieces apart.

Rows are dealt evenly to blocks of about ``block`` rows, each packed by itself: a hot source
spreads over all blocks. A source with more pieces in a block than the others can fill up leaves
sequences partly empty; no order avoids that, as two of its pieces never share one.

Null or blank texts have no words and aren't packed. A null source is a source of its own; equal
texts (white space and case apart) are one cluster. Repeated rows are packed as rows of their own
(never together). Ties go to the smaller cluster hash, then id. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "bin_id long, bin_offset long, doc_id long, piece long, first_word long, n_words long, source string, cluster long"


@dataclass(frozen=True)
class Params:
    capacity: int = 2048
    block: int = 8192


class Bins:
    """Open sequences by room left, each level by (source bits, cluster bits)."""

    def __init__(self, capacity: int):
        self.capacity, self.levels, self.mask = capacity, {}, 0
        self.used: list[int] = []

    def _put(self, room: int, bits: tuple[int, int], number: int) -> None:
        if room:
            self.levels.setdefault(room, {}).setdefault(bits, []).append(number)
            self.mask |= 1 << room

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(sequence, offset) of a piece."""
        rest = self.mask >> size
        room = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            room += step
            level = self.levels[room]
            bits = next((x for x in level if not x[0] & source and not x[1] & cluster), None)
            if bits is not None:
                own = level[bits]
                number = own.pop()
                if not own:
                    del level[bits]
                    if not level:
                        del self.levels[room]
                        self.mask &= ~(1 << room)
                at = self.used[number]
                self.used[number] += size
                self._put(room - size, (bits[0] | source, bits[1] | cluster), number)
                return number, at
            rest >>= step + 1
            room += 1
        self.used.append(size)
        self._put(self.capacity - size, (source, cluster), len(self.used) - 1)
        return len(self.used) - 1, 0


def pack_rows(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, source, cluster, n) to (sequence, offset, doc_id, piece, first word, words, source, cluster)."""
    bins, out, rest = Bins(capacity), [], []
    sources, clusters = {}, {}
    for doc, source, cluster, n in rows:
        whole, left = divmod(n, capacity)
        for i in range(whole):
            bins.used.append(capacity)
            out.append((len(bins.used) - 1, 0, doc, i, i * capacity, capacity, source, cluster))
        if left:
            rest.append((-left, cluster, doc is not None, doc or 0, doc, source, whole))
    rest.sort(key=lambda r: r[:4])
    for minus, cluster, _, _, doc, source, whole in rest:
        number, at = bins.place(-minus, 1 << sources.setdefault(source, len(sources)), 1 << clusters.setdefault(cluster, len(clusters)))
        out.append((number, at, doc, whole, whole * capacity, -minus, source, cluster))
    return out


def pack(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text, source) with their place: SCHEMA."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cluster = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))))
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), n.alias("n"),
                        F.monotonically_increasing_id().alias("__row"))
    blocks = max(1, -(-docs.count() // p.block))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n"))))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1] or ""))
        out = pack_rows(rows, p.capacity)
        cols = list(zip(*out)) if out else [[]] * 8
        cols[0] = [(key[0].as_py() << 32) + x for x in cols[0]]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    block = F.pmod(F.xxhash64("doc_id", "__row"), F.lit(blocks))
    return (items.filter("n > 0").withColumn("block", block).drop("__row")
            .groupBy("block").applyInArrow(run, SCHEMA))
