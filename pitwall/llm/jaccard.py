"""N-gram Jaccard join (operator 7) by parity sketches.

A document is its set of distinct 5-word shingles. Sizes fall into bands (powers of two); each
band has m segments, every shingle belongs to one segment by its hash, and a segment is the XOR of
its shingles' hashes. A shingle in just one of two sets changes one segment at most, so the number
of differing segments (and the Hamming distance of a one-bit-a-shingle sketch) is a lower bound
of the symmetric difference. At similarity t the latter is at most D = (1-t)/(1+t) of the sizes'
sum, so linked documents agree in m - D segments (pigeonhole), and if each lists its segments in
one common order, one of the first D + 1 agrees. The order puts segments made of frequent
shingles (and empty ones) last, so text that many unlinked documents share makes no candidates.

Documents that share a listed segment become candidates by stars, not by all pairs: each is paired
with the smallest id of the segment's group. Candidates pass the length and Hamming bounds (large sets also
that of a sketch as wide as they are large: 1,024 bits say nothing of sets of many thousands) and
are verified on their shingle sets; components follow. A second round takes all pairs between
*different* components that share a listed segment (then one of them is not in the component of the
segment's smallest id), so no link between components is lost, and none inside a component is expanded.

Only the document that names its class lists segments, and only texts of candidates shuffle: both are told by a broadcast bitmap
(``exact_dedup.sieve``) of bounded size. Many candidates are verified in rounds. Tables and shuffle files that no later step reads are removed on the way.

Texts null, blank or empty have an empty set, are linked with nothing and are their own
component; a text with fewer words than a shingle is one shingle. Equal sets form one class
before verification. Rows with one id are one document in the links, whatever their texts, yet each row is returned;
a null id gets no links and a null component. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm import common as C
from pitwall.llm.components import connected_components
from pitwall.llm.exact_dedup import sieve, sifted
from pitwall.session import remove

BITS = 1024
#: Of a shingle's hash; a row number of a slice (below 4,096) and the hash sort as one integer.
HASH_BITS = 52
_HOT_BUCKETS = 1 << 20
#: A partition of the listed segments holds at most some third of so many rows.
SHINGLES_PER_PART = 1 << 21
_SIG = "kind int, doc_id long, n long, s1 long, s2 long, parity array<long>, wide binary, bucket long, seen long"


@dataclass(frozen=True)
class Params:
    """threshold in hundredths; hot: at most so many buckets of frequent shingles are known to every task (1 bit of 2^20)."""

    words: int = 5
    threshold: int = 80
    hot: int = 1 << 16

    def most_different(self, sizes: int | np.ndarray):
        """Largest symmetric difference of linked sets whose sizes have this sum."""
        return sizes * (100 - self.threshold) // (100 + self.threshold)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, in order of row and hash (at most 4,096 rows)."""
    start, end, row = C.words(buf, off)
    h = C.span_hashes(buf, start, end, lower=True)
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    some = np.zeros(0, np.uint64)
    rows = np.zeros(0, np.int64)
    if len(h) >= k:
        win = C.word_windows(h, k)
        ok = row[k - 1:] == row[:len(row) - k + 1]
        some, rows = win[ok], row[:len(win)][ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        with np.errstate(over="ignore"):
            whole = np.array([C.mix(C.word_windows(h[first[i]:first[i + 1]], int(n[i])) + np.uint64(n[i]))[0] for i in short], np.uint64)
        some, rows = np.concatenate([some, whole]), np.concatenate([rows, short])
    both = np.sort((rows.astype(np.uint64) << np.uint64(HASH_BITS)) | (some >> np.uint64(64 - HASH_BITS)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both >> np.uint64(HASH_BITS)).astype(np.int64), both & np.uint64((1 << HASH_BITS) - 1)


def _sums(values: np.ndarray, first: np.ndarray, n: np.ndarray, op) -> np.ndarray:
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        out[full] = op.reduceat(values, first[:-1][full])
    return out


def wide_sketch(h: np.ndarray) -> bytes:
    """Parities of a set's hashes at their low bits, as many places as the next power of two over its size."""
    return np.packbits((np.bincount((h % np.uint64(1 << (len(h) - 1).bit_length())).astype(np.int64), minlength=1 << (len(h) - 1).bit_length()) & 1).astype(np.uint8)).tobytes()


def wide_distance(x: bytes, y: bytes) -> int:
    """Hamming distance, the longer sketch folded to the shorter one's places: a lower bound of the symmetric difference."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    k = min(len(x), len(y))
    return int(np.unpackbits(np.bitwise_xor.reduce(x.reshape(-1, k), axis=0) ^ np.bitwise_xor.reduce(y.reshape(-1, k), axis=0)).sum())


def _signatures(batches, p: Params):
    """A row per document (kind 0), and counts of the busiest shingle buckets (kind 1)."""
    seen = np.zeros(_HOT_BUCKETS, np.int64)
    for b in batches:
        for lo, hi, buf, off in C.text_slices(b.column(1)):
            row, h = shingle_sets(buf, off, p.words)
            n = np.bincount(row, minlength=hi - lo)
            first = np.concatenate([[0], np.cumsum(n)])
            seen += np.bincount((h >> np.uint64(HASH_BITS - 20)).astype(np.int64), minlength=_HOT_BUCKETS)
            with np.errstate(over="ignore"):
                s1, s2 = _sums(C.mix(h), first, n, np.add), _sums(C.mix(h ^ np.uint64(0x1B873593CC9E2D51)), first, n, np.add)
            bits = np.zeros((hi - lo) * BITS, np.uint8)
            flip = np.bincount(row * BITS + (h % np.uint64(BITS)).astype(np.int64), minlength=len(bits))
            bits[:] = flip & 1
            parity = np.packbits(bits.reshape(hi - lo, -1), axis=1).view(np.int64)
            k = parity.shape[1]
            arrays = pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * k, k, dtype=np.int32), parity.ravel())
            none = pa.nulls(hi - lo, pa.int64())
            wide = pa.array([wide_sketch(h[first[i]:first[i + 1]]) if n[i] > BITS else None for i in range(hi - lo)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(hi - lo, np.int32)), b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                 pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), arrays, wide, none, none], _NAMES)
    busy = np.flatnonzero(seen > max(8, 4 * seen.mean()))
    busy = busy[np.argsort(-seen[busy], kind="stable")][:p.hot]
    none = pa.nulls(len(busy), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.ones(len(busy), np.int32)), none, none, none, none, pa.nulls(len(busy), pa.list_(pa.int64())), pa.nulls(len(busy), pa.binary()), pa.array(busy), pa.array(seen[busy])], _NAMES)


_NAMES = ["kind", "doc_id", "n", "s1", "s2", "parity", "wide", "bucket", "seen"]


def segments_of(band: np.ndarray) -> np.ndarray:
    """Segments of a band: three quarters of its smallest size, more than D + 1 of its largest."""
    return (3 << band) // 4 + 2


def listed_segments(row: np.ndarray, h: np.ndarray, hot: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the first D + 1 segments, in the common order, of each set and band it takes part in."""
    m = int(row[-1]) + 1 if len(row) else 0
    n = np.bincount(row, minlength=m)
    band = np.zeros(m, np.int64)
    band[n > 0] = np.floor(np.log2(n[n > 0])).astype(np.int64)
    reach = n * 100 // p.threshold
    out_row, out_key = [], []
    is_hot = hot[(h >> np.uint64(HASH_BITS - 20)).astype(np.int64)]
    for above in (0, 1):
        # once in its own band, and in the next if its partner may belong there
        at = band + above
        top = np.minimum(reach, (2 << at) - 1)
        use = (n > 0) & ((1 << at) <= reach) if above else n > 0
        need = np.minimum(p.most_different(n + top) + 1, segments_of(at))
        take = use[row]
        r, x = row[take], h[take]
        if not len(r):
            continue
        count = np.where(use, segments_of(at), 0)
        first = np.concatenate([[0], np.cumsum(count)])
        seg = (C.mix(x ^ np.uint64(0x2545F4914F6CDD1D)) % count[r].astype(np.uint64)).astype(np.int64)
        flat = first[r] + seg
        sig = np.zeros(first[-1], np.uint64)
        np.bitwise_xor.at(sig, flat, C.mix(x))
        common = np.ones(first[-1], np.uint64)
        common[flat[~is_hot[take]]] = 0
        who = np.repeat(np.arange(m), count)
        number = np.arange(first[-1]) - first[who]
        with np.errstate(over="ignore"):
            key = C.mix(sig + (number * 64 + at[who]).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        # one integer sorts by set, rare segments first, then key
        key = np.sort((who.astype(np.uint64) << np.uint64(52)) | (common << np.uint64(51)) | (key >> np.uint64(13)))
        chosen = number < need[who]
        out_row.append(who[chosen])
        out_key.append(key[chosen] & np.uint64((1 << 51) - 1))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def _groups(batches):
    """Rows (key, doc_id), sorted by both, to (key, doc_id, lead) of keys with two documents or more; a key may span batches."""
    key = doc = lead = None  # the row held back, and its group's first document
    shown = False            # whether the held-back row's group has more rows
    for b in batches:
        k, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        if key is not None:
            k, d = np.concatenate([[key], k]), np.concatenate([[doc], d])
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k, d = k[new], d[new]
        begin = np.ones(len(k), bool)
        begin[1:] = k[1:] != k[:-1]
        at = np.maximum.accumulate(np.where(begin, np.arange(len(k)), 0))
        leads = d[at]
        if key is not None:
            leads[at == 0] = lead
        more = np.zeros(len(k), bool)
        more[:-1] = ~begin[1:]
        more |= ~begin
        if key is not None and shown:
            more[0] = True
        # the last row waits, as its group may go on
        key, doc, lead, shown = int(k[-1]), int(d[-1]), int(leads[-1]), bool(more[-1])
        out = np.flatnonzero(more[:-1])
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(d[out]), pa.array(leads[out])], ["key", "doc_id", "lead"])
    if key is not None and shown:
        yield pa.RecordBatch.from_pydict({"key": [key], "doc_id": [doc], "lead": [lead]})


def _far(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _close(p: Params, na: str, nb: str, pa_: str, pb: str):
    """The length bound and the Hamming bound."""
    sizes = F.col(na) + F.col(nb)
    return (100 * F.least(na, nb) >= p.threshold * F.greatest(na, nb)) & \
        (_far(pa_, pb) * (100 + p.threshold) <= sizes * (100 - p.threshold))


def _narrowed(pairs: DataFrame, p: Params) -> DataFrame:
    """Of ``pairs`` (a, b, na, nb, wa, wb) all but those of large sets whose wide sketches differ too much: what is left is worth its texts."""

    def run(batches):
        for b in batches:
            far = [x is not None and y is not None and wide_distance(x, y) > p.most_different(n)
                   for n, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array([not x for x in far], pa.bool_()))

    return pairs.select("a", "b", F.col("na") + F.col("nb"), "wa", "wb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Of ``pairs`` (a, b) those whose shingle sets are similar enough."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                some = b.slice(lo, 128)
                sets = []
                for col in (2, 3):
                    got: list[np.ndarray] = []
                    for i, j, buf, off in C.text_slices(some.column(col)):
                        row, h = shingle_sets(buf, off, p.words)
                        got += np.split(h, np.cumsum(np.bincount(row, minlength=j - i))[:-1])
                    sets.append(got)
                keep = []
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= p.threshold * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = C.stored(docs.mapInArrow(lambda it: _signatures(it, p), _SIG), "signatures")
    rows = found.filter("kind = 0").select("doc_id", "n", "s1", "s2", "parity", "wide")
    known = rows.filter("doc_id is not null and n > 0")
    hot = np.zeros(_HOT_BUCKETS, bool)
    busiest = (found.filter("kind = 1").groupBy("bucket").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= 32)
               .orderBy(F.col("seen").desc(), "bucket").limit(p.hot))
    hot[[r.bucket for r in busiest.select("bucket").collect()]] = True  # at most p.hot of a fixed number of buckets

    # a class is all documents of one set, named by its smallest id
    classes = C.stored(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("parity", "wide"), "doc_id").alias("sketch"))
                       .select("n", "s1", "s2", "rep", "sketch.*"), "classes")

    rep_of = known.select("doc_id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("doc_id", "rep").distinct()
    rep_of = C.stored(rep_of, "class-members")
    sides = classes.select("rep", "n", "parity")
    a = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"), F.col("wide").alias("wa"))
    b = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"), F.col("wide").alias("wb"))

    def listed(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                row, key = listed_segments(*shingle_sets(buf, off, p.words), hot, p)
                for i in range(0, len(row), 1 << 16):
                    r = row[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[i:i + (1 << 16)].view(np.int64)), pa.array(ids[lo:hi][r])], ["key", "doc_id"])

    # the other members of a class list what its name lists; the few that the filter lets through are in no class' name, and fall out where sides join
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (classes.agg(F.sum("n")).first()[0] or 0) // SHINGLES_PER_PART)
    n_docs = rows.count()
    names = sifted(docs.filter("doc_id is not null"), "doc_id", sieve(classes.select(F.col("rep").alias("cell"))), "maybe").filter("maybe").select("doc_id", "text")
    groups, groups_at = C.stored_at(names.mapInArrow(listed, "key long, doc_id long")
                                    .repartition(n_parts, "key").sortWithinPartitions("key", "doc_id").mapInArrow(_groups, "key long, doc_id long, lead long"), "segment-groups")

    def verified(pairs, name):
        """Only texts of the pairs shuffle, in rounds of about as many texts as there are documents."""
        n = pairs.count()
        rounds = 1 + 2 * n // max(1, n_docs)
        links = []
        for i in range(rounds):
            some = pairs.filter(F.pmod(F.xxhash64("b"), F.lit(rounds)) == i)
            ids = sieve(some.select(F.col("a").alias("cell")).union(some.select("b")), most=2 * n // rounds)
            # dealt by id once, for both sides
            texts = sifted(docs, "doc_id", ids, "maybe").filter("maybe").select("doc_id", "text").repartition("doc_id").dropDuplicates()
            links.append(C.stored(_verified(some, texts, p).distinct(), name))
        return reduce(DataFrame.union, links)

    # the smallest id of a group has no smaller id with its set: it names its class
    stars = C.stored(groups.filter("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
                     .join(classes.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b"), "stars")
    near = C.stored(_narrowed(stars.join(a, "a").join(b, "b").filter(_close(p, "na", "nb", "pa", "pb")), p), "candidates")
    one_id = rep_of.join(rep_of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").filter("rep != b").select(F.col("rep").alias("a"), "b")
    comps = C.stored(connected_components(verified(near, "verified").union(one_id)), "components-1")

    # second round: segments with a document in another component than their first; bitmaps find them, so that groups don't shuffle
    ca = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = stars.join(ca, "a", "left").join(cb, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(F.xxhash64("a", "b").alias("cell"))
    found = sifted(groups.select("key", F.xxhash64("lead", "doc_id").alias("pair")), "pair", sieve(apart, most=stars.count()), "maybe").filter("maybe")
    split = C.stored(found.select(F.col("key").alias("cell")).distinct(), "open-keys")
    rows_of = sifted(groups.select("key", F.col("doc_id").alias("rep")), "key", sieve(split), "maybe").filter("maybe").join(split, F.col("key") == F.col("cell"), "left_semi")
    open_rows, open_at = C.stored_at(rows_of.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
                                     .join(sides, "rep"), "open-groups")
    remove(spark, groups_at)
    x = open_rows.select("key", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    y = open_rows.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    far = (x.join(y, (x.key == y.key) & (F.col("ca") < F.col("cb")) & _close(p, "na", "nb", "pa", "pb")).select("a", "b").distinct()
           .join(near.select(F.col("a"), F.col("b")).union(near.select("b", "a")), ["a", "b"], "left_anti"))
    far = C.stored(_narrowed(far.join(a, "a").join(b, "b"), p), "cross-candidates")
    remove(spark, open_at)
    if not far.isEmpty():
        more = verified(far, "verified-2")
        comps = C.stored(connected_components(more.union(comps.select("node", "component").filter("node != component"))), "components-2")

    home = rep_of.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    home = home.groupBy("doc_id").agg(F.min("component").alias("component"))
    return (rows.select("doc_id", "n").join(home, "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
