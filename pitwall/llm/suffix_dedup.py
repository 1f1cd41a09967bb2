"""Suffix-array dedup (operator 1): byte strings of ``length`` bytes that start more than once.

A suffix array of all texts is sorted in parts. Every window of ``length`` bytes belongs to its
anchor: the k-byte string in it whose rolling hash is smallest (the last one among equals). Equal
windows have equal anchors, so suffixes are dealt by their anchor's hash and only need sorting
among those of one anchor. Windows in a row with one anchor form a run; runs of equal bytes are
counted, not compared. Runs that differ under one anchor go, with their bytes, to a task that
sorts their suffixes (truncated to ``length`` bytes, equal ones in order of position), and takes
from previous and next smaller positions in suffix order the longest previous factor of each
suffix, and, with positions turned round, the longest next factor. A factor of ``length`` bytes is
an earlier or later match.

Anchors with more differing runs than ``most_runs`` don't fit one task. Their suffixes are dealt
once more, by all ``length`` bytes; a bucket then holds equal suffixes only, and a count and the
smallest position are all that its factors need.

``keep="first"`` removes later copies (the first occurrence by id, then position, stays);
``keep="none"`` removes every byte of a window that starts more than once. Overlaps count, matches
don't cross texts, and windows are judged on the input.

Null text is empty. Rows with the same id and text are one position to ``keep="first"`` (none of
them is earlier) but copies to ``keep="none"``. A null id counts as the smallest. Extra columns of
the input are kept by ``dedup_text``. Texts shorter than ``length`` stay as they are.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.llm import common as C

_RUN = "anchor long, seg long, doc long, th long, at array<long>, n int"
_FOUND = "anchor long, seg long, later array<int>, every array<int>"
_FIRST_ID = -(2**63)


@dataclass(frozen=True)
class Params:
    length: int = 400
    gram: int = 128
    #: Suffixes of so many runs (about 140 windows each) are sorted at once at most: some 250 MB.
    most_runs: int = 4096
    block_suffixes: int = 40_000


def _sliding_last_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: smallest of a block's tail and the next block's head."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - w + 1], head[w - 1:n])


def runs(buf: np.ndarray, off: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor's hash, hash of the run's bytes) of each run of windows with one anchor."""
    z = np.zeros(0, np.int64)
    if not len(buf) or np.diff(off).max() < p.length:
        return z, z, z, z, z
    h = C.byte_windows(buf, p.gram)
    bits = max(1, len(h).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    anchor = (low - (_sliding_last_min(packed, p.length - p.gram + 1) & low)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - p.length + 1, 0))
    start = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(np.diff(off) - p.length + 1, 0))])[:-1],
                                            np.maximum(np.diff(off) - p.length + 1, 0)) + off[row]
    a = anchor[start]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(a)))
    begin = start[first]
    seg = C.span_hashes(buf, begin, begin + n - 1 + p.length)
    return row[first], begin - off[row[first]], n, h[a[first]].view(np.int64), seg.view(np.int64)


def previous_factors(suffix_order: np.ndarray, position: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix, where it is at least ``least`` (else 0).

    ``suffix_order`` lists suffixes in order, ``position`` gives each suffix's place in the text,
    ``lcp[i]`` is the common prefix of the i-th and the one before it (lcp[0] = 0). The nearest
    suffixes before and after in order that have a smaller position are found by pointer
    jumping; the smallest lcp on the way is their common prefix. Ways below ``least`` end early.
    """
    n = len(suffix_order)
    pos = position[suffix_order]
    best = np.zeros(n, np.int64)
    for turn in (False, True):
        q = pos[::-1] if turn else pos
        low = np.append(0, lcp[1:][::-1]) if turn else lcp.copy()
        low = low.astype(np.int64)
        at = np.arange(n) - 1
        low[(at < 0) | (low < least)] = 0
        live = np.flatnonzero(low)
        while len(live):
            live = live[q[at[live]] >= q[live]]
            if not len(live):
                break
            j = at[live]
            low[live] = np.where(at[j] >= 0, np.minimum(low[live], low[j]), 0)
            at[live] = at[j]
            gone = (low[live] < least) | (at[live] < 0)
            low[live[gone]] = 0
            live = live[~gone]
        best = np.maximum(best, low[::-1] if turn else low)
    out = np.zeros(n, np.int64)
    out[suffix_order] = best
    return out


def sorted_suffixes(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes at ``start``, each truncated to ``length`` bytes; equal ones stay in given order."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(data, length)[start]
    order = pc.array_sort_indices(pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(start), [None, pa.py_buffer(rows)])).to_numpy().astype(np.int64)
    lcp = np.zeros(len(start), np.int64)
    for lo in range(1, len(start), 8192):
        some = rows[order[lo - 1:lo + 8192]]
        differ = some[1:] != some[:-1]
        lcp[lo:lo + len(differ)] = np.where(differ.any(1), differ.argmax(1), length)
    return order, lcp


def _ranges(flag: np.ndarray) -> list[int]:
    """Flagged windows as from, to, from, to, ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge.tolist()


def _matched(rows: list[tuple], p: Params):
    """Of runs (anchor, seg, n, bytes), in order of anchor and first position: which windows have an earlier, or any, match."""
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    n = np.array([r[2] for r in rows])
    base = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])[:-1]
    first = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(base - first[:-1], n) + np.arange(first[-1])
    order, lcp = sorted_suffixes(data, start, p.length)
    place = np.arange(len(start))
    later = previous_factors(order, place, lcp, p.length) >= p.length
    before = previous_factors(order, -place, lcp, p.length) >= p.length
    for i, r in enumerate(rows):
        x, y = later[first[i]:first[i + 1]], before[first[i]:first[i + 1]]
        if x.any() or y.any():
            yield r[0], r[1], _ranges(x), _ranges(x | y)


def _sort_blocks(batches, p: Params):
    """Whole anchors are gathered to blocks; one block's suffixes are sorted together."""
    block: list[tuple] = []
    size, out = 0, []

    def flush():
        out.extend(_matched(block, p))
        block.clear()

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if size >= p.block_suffixes and r[0] != block[-1][0]:
                flush()
                size = 0
            block.append(r)
            size += r[2]
        if len(out) > 2000:
            yield _found(out)
            out = []
    if block:
        flush()
    if out:
        yield _found(out)


def _found(rows) -> pa.RecordBatch:
    a, s, x, y = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.list_(pa.int32())), pa.array(y, pa.list_(pa.int32()))],
                                      ["anchor", "seg", "later", "every"])


def repeated_spans(docs: DataFrame, keep: str = "first", p: Params = Params()) -> DataFrame:
    """Byte spans to remove: doc, th (the row's id and text hash, see ``keyed``), spans array<long> (from, to, from, to, ... of windows)."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(2)):
                row, at, n, anchor, seg = runs(buf, off, p)
                if len(row):
                    # equal runs of one text (it repeats itself) are one row
                    order = np.lexsort((at, anchor, seg, row))
                    r, a, s = row[order], anchor[order], seg[order]
                    cut_at = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
                    take = pa.array(r[cut_at])
                    places = pa.ListArray.from_arrays(np.append(cut_at, len(r)).astype(np.int32), at[order])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[cut_at]), pa.array(s[cut_at]), b.column(0).slice(lo, hi - lo).take(take), b.column(1).slice(lo, hi - lo).take(take),
                         places, pa.array(n[order][cut_at].astype(np.int32))], ["anchor", "seg", "doc", "th", "at", "n"])

    every = C.stored(docs.select("doc", "th", "text").mapInArrow(cut, _RUN), "runs")
    segs = every.groupBy("anchor", "seg").agg(F.sum(F.size("at").cast("long")).alias("copies"), F.min(F.struct("doc", F.col("at")[0].alias("at"), "th")).alias("first"), F.first("n").alias("n"))

    def with_others(segs):
        """Runs whose anchor is in another place, too."""
        return segs.join(segs.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).filter("total > 1").select("anchor", "kinds"), "anchor")

    shared = C.stored_alone(lambda: C.stored(segs, "segments").transform(with_others), "shared-segments")

    # runs that differ under one anchor: fetch their bytes
    differ = shared.filter("kinds > 1").select("anchor", "seg", "n", "kinds", F.col("first.doc").alias("doc"), F.col("first.th").alias("th"), F.col("first.at").alias("at"))
    wanted = differ.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "seg", "n", "kinds", "at")).alias("pieces"))

    def fetch(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                some = b.slice(lo, 64)
                data, off = C.flat(some.column(3))
                anchor, seg, n, kinds, at, doc, raw = [], [], [], [], [], [], []
                for i, (d, pieces) in enumerate(zip(some.column(0).to_pylist(), some.column(2).to_pylist())):
                    text = data[off[i]:off[i + 1]].tobytes()
                    for x in pieces:
                        anchor.append(x["anchor"]), seg.append(x["seg"]), n.append(x["n"]), kinds.append(x["kinds"]), at.append(x["at"]), doc.append(d)
                        raw.append(text[x["at"]:x["at"] + x["n"] - 1 + p.length])
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int64()), "seg": pa.array(seg, pa.int64()), "n": pa.array(n, pa.int32()),
                                                  "raw": pa.array(raw, pa.binary()), "kinds": pa.array(kinds, pa.int64()), "doc": pa.array(doc, pa.int64()), "at": pa.array(at, pa.int64())})

    fetched = C.stored(wanted.join(docs.select("doc", "th", "text"), ["doc", "th"]).dropDuplicates(["doc", "th"]).select("doc", "th", "pieces", "text")
                       .mapInArrow(fetch, "anchor long, seg long, n int, raw binary, kinds long, doc long, at long"), "segment-bytes")
    small = (fetched.filter(F.col("kinds") <= p.most_runs).repartition(n_parts, "anchor").sortWithinPartitions("anchor", "doc", "at")
             .select("anchor", "seg", "n", "raw").mapInArrow(lambda it: _sort_blocks(it, p), _FOUND))

    # anchors with very many runs: buckets of suffixes that are equal in all their bytes
    def full_depth(batches):
        for b in batches:
            data, off = C.flat(b.column(2))
            for i, (a, s, d, at) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 1, 3, 4)))):
                h = C.byte_windows(data[off[i]:off[i + 1]], p.length).view(np.int64)
                m = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, a)), pa.array(np.full(m, s)), pa.array(np.arange(m, dtype=np.int32)), pa.array(h),
                                                  pa.array(np.full(m, d)), pa.array(np.full(m, at))], ["anchor", "seg", "i", "h", "doc", "at"])

    deep = C.stored(fetched.filter(F.col("kinds") > p.most_runs).select("anchor", "seg", "raw", "doc", "at")
                    .mapInArrow(full_depth, "anchor long, seg long, i int, h long, doc long, at long"), "suffix-buckets")
    bucket = deep.groupBy("anchor", "h").agg(F.count("*").alias("c"), F.min(F.struct("doc", "at")).alias("f")).filter("c > 1")
    hit = deep.join(bucket, ["anchor", "h"])
    span = F.array(F.col("i"), F.col("i") + 1)
    large = hit.groupBy("anchor", "seg").agg(
        F.flatten(F.collect_list(F.when((F.col("f.doc") != F.col("doc")) | (F.col("f.at") != F.col("at")), span))).alias("later"),
        F.flatten(F.collect_list(span)).alias("every"))
    found = small.unionByName(large)

    # back to every run
    known = shared.join(found, ["anchor", "seg"], "left").filter("copies > 1 or every is not null")
    hits = every.join(known.select("anchor", "seg", "copies", "first", "later", "every"), ["anchor", "seg"])
    whole = F.array(F.lit(0), F.col("n"))
    none = F.array().cast("array<int>")
    if keep == "none":
        some = lambda at: F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("every", none))
    elif keep == "first":
        some = lambda at: F.when((F.col("first.doc") == F.col("doc")) & (F.col("first.th") == F.col("th")) & (F.col("first.at") == at),
                                 F.coalesce("later", none)).otherwise(whole)
    else:
        raise ValueError("keep is 'first' or 'none'")
    return (hits.select("doc", "th", F.flatten(F.transform("at", lambda at: F.transform(some(at), lambda x: x + at))).alias("s")).filter(F.size("s") > 0)
            .groupBy("doc", "th").agg(F.flatten(F.collect_list("s")).alias("spans")))


def _key(prefix: str = ""):
    """Row identity: doc (the id; the smallest integer for null) and th (hash of the text)."""
    return [F.coalesce(F.col(f"{prefix}doc_id").cast("long"), F.lit(_FIRST_ID)).alias("doc"), F.xxhash64(F.col(f"{prefix}text").cast("string")).alias("th")]


def dedup_text(docs: DataFrame, keep: str = "first", p: Params = Params(), min_words: int = 0, with_bytes: bool = True) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, ...) as the struct ``row`` with its text cut, and kept, n_bytes, n_removed, n_spans, sha256 (of the bytes left).

    ``kept`` holds the bytes left (a removed window may end inside a character; null without ``with_bytes``); ``row.text`` is
    those bytes with broken characters left out, null where it was null. A span of fewer than ``min_words``
    words stays. The input's columns may have any names.
    """
    spans = C.stored_alone(lambda: repeated_spans(docs.select(*_key(), F.col("text").cast("string").alias("text")), keep, p), "spans")
    at, width = docs.columns.index("text"), len(docs.columns)
    rows = docs.select(*_key(), *(F.col(f"`{c}`").cast("string").alias(f"c{i}") if i == at else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    both = rows.join(spans, ["doc", "th"], "left").select(*(f"c{i}" for i in range(width)), "spans")
    made = [("kept", T.BinaryType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("sha256", T.StringType())]
    schema = T.StructType([*both.drop("spans").schema.fields, *(T.StructField(*m) for m in made)])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                data, off = C.flat(some.column(at))
                kept, size, gone, parts, sha, text = [], [], [], [], [], []
                for i, s in enumerate(some.column(width).to_pylist()):
                    raw = data[off[i]:off[i + 1]]
                    left, k = raw.tobytes(), 0
                    if s:
                        cover = _covered(raw, s, p.length, min_words)
                        left = raw[~cover].tobytes()
                        k = int((np.diff(np.concatenate([[0], cover.astype(np.int8)])) == 1).sum())
                    kept.append(left if with_bytes else None), size.append(len(raw)), gone.append(len(raw) - len(left)), parts.append(k)
                    sha.append(hashlib.sha256(left).hexdigest())
                    text.append(left.decode("utf-8", "ignore"))
                cols = list(some.columns[:width])
                cols[at] = pa.array(text, pa.string(), mask=some.column(at).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()), pa.array(sha)],
                                                 schema.names)

    return both.mapInArrow(run, schema).select(F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns))).alias("row"), *(m for m, _ in made))


def _covered(raw: np.ndarray, spans: list[int], length: int, min_words: int) -> np.ndarray:
    """Bytes that the windows of ``spans`` cover, in runs of at least ``min_words`` words."""
    edge = np.zeros(len(raw) + 1, np.int32)
    s = np.array(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1] - 1 + length, -1)
    cover = np.cumsum(edge[:-1]) > 0
    if min_words:
        for lo, hi in np.array(_ranges(cover)).reshape(-1, 2):
            gap = C.white(raw[lo:hi])
            if int((~gap & np.concatenate([[True], gap[:-1]])).sum()) < min_words:
                cover[lo:hi] = False
    return cover
