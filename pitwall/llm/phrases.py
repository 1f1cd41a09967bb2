"""Phrase collocation mining (operator 13) with an FM-index per shard over word ids.

Each task cuts its texts into shards of about ``shard_words`` words: a shard is one sequence of local word ids
with a separator between pieces, and its dictionary with counts. A shard's index (``index``) is the
Burrows-Wheeler transform of its sequence and of the reversed sequence, in an order by the
first ``most_words`` words of each suffix: phrases are no longer, so that order finds their intervals.

Counts are summed across shards in buckets of hashed words (``_count_words``) and of hashed phrases
(``_count_phrases``). A shard sends every bucket one compressed block: its words or phrases of that bucket in order,
with counts. The bucket sends back which of them have ``min_count`` in all shards, one bit each, and the ids of those,
so neither a count nor an answer is a row of its own. Words below ``min_count`` turn into separators.

Phrases grow by one word a level, up to three words to the left, then to the right. A phrase has an interval in
both indexes (``extend``): grouping the transform inside it by word gives, for every word that can be put on, the
count, the interval in the index it extends (the LF mapping of the first place), and the interval in the
other one (the smaller words before it). A shard reports a longer phrase only if what it has without its other end word
is frequent, too. A phrase is known by the id of the shorter one and the added word's, so all counts are exact.
The number of buckets follows the bytes of text (``bucket_bytes``), so a bucket holds as much on any input.

Words and pieces: A-Z lower-cased, pieces end at . , ; : ! ? and line ends, words are what spaces and tabs
separate; phrases don't cross pieces or texts. Null text has no words; a null language is ``und``.
Ids don't matter: repeated rows count as often as they come. An empty table has no phrases. A shard holds
whole texts, so a text longer than a shard makes a longer shard. Extra columns are ignored.

No side is broadcast unless its rows were counted and are at most ``most_broadcast``; other joins shuffle.
A word, phrase or language that holds a large part of everything is summed by partial aggregation first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.llm import common as C
from pitwall.session import remove

_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _STOP.copy()
_GAP[list(b" \t")] = True
_CODEC = "zstd"
#: A block of a shard's words has ``n`` of them; a shard's sequence is a row of its own, with the counts of all its words in the blocks' order.
_SHARD = "shard long, bucket int, first int, n int, lang string, total long, words binary, sizes binary, c binary, size int, tokens binary"
#: A block of a shard's phrases; the places of all of them in the indexes (in the blocks' order), and the index, are rows of their own.
_FOUND = "shard long, bucket int, first int, n int, p binary, w binary, c binary, lo binary, other binary"
_INDEX = f"{_FOUND}, size int, gids binary, left binary, right binary"
#: What a bucket answers a block (the first five), and its frequent words or phrases.
_ANSWER = "shard long, bucket int, first int, n int, mask binary, ranks binary"
_WORDS = f"{_ANSWER}, id long, f long, lang string, word string"
_PHRASES = f"{_ANSWER}, id long, f long, p long, w long"
#: An id is the bucket, shifted by so many bits, and the rank in it.
_RANK_BITS = 33
_LEAST_BUCKETS = 16


@dataclass(frozen=True)
class Params:
    min_count: int = 100
    most_words: int = 5
    shard_words: int = 1 << 21
    top: int = 2000
    most_broadcast: int = 200_000
    bucket_bytes: int = 1 << 24


def _packed(x: np.ndarray, kind: str = "<i4") -> bytes:
    """Bytes of one weight side by side compress better."""
    return pa.compress(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), codec=_CODEC, asbytes=True)


def _unpacked(raw: bytes, size: int, kind: str = "<i4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw, size * width, codec=_CODEC, asbytes=True), np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _by_count(count: np.ndarray) -> np.ndarray:
    """Numbers from 1 on, the largest count first."""
    out = np.empty(len(count), np.int32)
    out[np.argsort(-count, kind="stable")] = np.arange(1, len(count) + 1)
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, np.int64)


def cut_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, length, row, begins a piece) of the words of texts, in order."""
    inside = ~_GAP[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    row = np.searchsorted(off, start, "right") - 1
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    return buf[inside], end - start, row, new


def _shards(batches, p: Params, buckets: int) -> Iterator[pa.RecordBatch]:
    part, seq, held = TaskContext.get().partitionId(), 0, []

    def flush():
        size = np.concatenate([h[1] for h in held])
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        arr = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(np.concatenate([h[0] for h in held]))))
        code = pc.dictionary_encode(arr)
        names = {}
        lang = np.concatenate([np.array([names.setdefault(x, len(names)) for x in h[2]], np.int64)[h[3]] for h in held])
        kinds, found, count = np.unique(lang * len(code.dictionary) + code.indices.to_numpy(), return_inverse=True, return_counts=True)
        # blocks in order of language, bucket and word; local ids by count, as small numbers compress best
        rank = np.empty(len(code.dictionary), np.int64)
        rank[pc.array_sort_indices(code.dictionary).to_numpy()] = np.arange(len(rank))
        data, at = C.flat(code.dictionary)
        home = (C.span_hashes(data, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int32)
        own, word = np.divmod(kinds, len(code.dictionary))
        order = np.lexsort((rank[word], home[word], own))
        own, word, count = own[order], word[order], count[order]
        local = np.empty(len(kinds), np.int32)
        local[order] = _by_count(count)
        new = np.concatenate([h[4] for h in held])
        tokens = np.zeros(len(size) + int(new.sum()), np.int32)
        tokens[np.arange(len(size)) + np.cumsum(new)] = local[found]
        shard, langs = part << 24 | seq, list(names)
        data, at = C.flat(code.dictionary.take(pa.array(word)))
        cut = _starts(own, home[word])
        rows = [{"shard": shard, "bucket": int(home[word[lo]]), "first": int(lo), "n": int(hi - lo), "lang": langs[own[lo]], "total": int(count[lo:hi].sum()),
                 "words": pa.compress(data[at[lo]:at[hi]].tobytes(), codec=_CODEC, asbytes=True), "sizes": _packed(np.diff(at[lo:hi + 1])), "c": _packed(count[lo:hi])} for lo, hi in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_pylist([*rows, {"shard": shard, "n": len(count), "c": _packed(count), "size": len(tokens), "tokens": _packed(tokens)}], _schema(_SHARD))

    have = 0
    for b in batches:
        langs = b.column(0).to_pylist()
        for lo, hi, buf, off in C.text_slices(b.column(1)):
            data, size, row, new = cut_words(C.lowered(buf), off)
            if len(size):
                held.append((data, size, langs[lo:hi], row, new))
                have += len(size)
            if have >= p.shard_words:
                yield from flush()
                seq, have, held = seq + 1, 0, []
    if have:
        yield from flush()


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of the cyclic sequence ``t`` in order of the ``depth`` values from there; equal ones by place."""
    bits = max(1, int(t.max()).bit_length()) if len(t) else 1
    per = 63 // bits
    keys = []
    for lo in range(0, depth, per):
        key = np.zeros(len(t), np.int64)
        for j in range(lo, min(depth, lo + per)):
            key = key << bits | np.roll(t, -j)
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def index(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transforms of the cyclic sequence ``t`` and of its reverse."""
    return t[suffix_order(t, depth) - 1], t[::-1][suffix_order(t[::-1], depth) - 1]


def extend(bwt: np.ndarray, lo: np.ndarray, other: np.ndarray, count: np.ndarray, known: bool) -> tuple[np.ndarray, ...]:
    """(phrase, added symbol, count, interval start here, interval start in the other index) of all extensions by one word.

    ``lo`` and ``other`` are the starts of the phrases' intervals, ``count`` their length. ``known``: only those whose interval
    here lies inside one of the given, that is, which are given without their other end word."""
    turn = np.argsort(bwt, kind="stable")
    lf = np.empty(len(bwt), np.int64)
    lf[turn] = np.arange(len(bwt))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(lo - first[:-1], count)
    own = np.repeat(np.arange(len(lo)), count)
    key = own * (int(bwt.max(initial=0)) + 1) + bwt[at]
    order = np.argsort(key, kind="stable")
    ks = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]])) if len(ks) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(ks)))
    which = own[order[begin]]
    here = lf[at[order[begin]]]
    there = other[which] + begin - first[which]
    symbol = bwt[at[order[begin]]]
    good = symbol > 0
    if known and len(lo):
        by = np.argsort(lo, kind="stable")
        j = np.searchsorted(lo[by], here, "right") - 1
        good &= (j >= 0) & (here < lo[by][j] + count[by][j])
    return which[good], symbol[good], n[good], here[good], there[good]


def _answers(t: dict, rank: np.ndarray) -> list[dict]:
    """For each block: the bits of what is frequent (rank 0 or more), and its ranks in that order."""
    out, at = [], 0
    for shard, bucket, first, n in zip(t["shard"], t["bucket"], t["first"], t["n"]):
        some = rank[at:at + n]
        ranks = some[some >= 0]
        out.append({"shard": shard, "bucket": bucket, "first": first, "n": n, "mask": np.packbits(some >= 0).tobytes(), "ranks": _packed(np.diff(ranks, prepend=0))})
        at += n
    return out


def _answered(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(which of a shard's words or phrases are frequent, their ids), from all answers to its blocks."""
    keep, ids = [], []
    for r in right.sort_by("first").to_pylist():
        keep.append(np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["n"]).astype(bool))
        ids.append(np.cumsum(_unpacked(r["ranks"], int(keep[-1].sum()))) + (r["bucket"] << _RANK_BITS))
    return np.flatnonzero(np.concatenate(keep)), np.concatenate(ids).astype(np.int64)


def _count_words(key, t: pa.Table, p: Params) -> pa.Table:
    """Of a bucket: the answers to its blocks, and its frequent words."""
    out, base = [], 0
    for lang in dict.fromkeys(t.column("lang").to_pylist()):
        b = t.filter(pc.equal(t.column("lang"), lang)).to_pydict()
        size = [_unpacked(x, n) for x, n in zip(b["sizes"], b["n"])]
        raw = b"".join(pa.decompress(x, int(s.sum()), codec=_CODEC, asbytes=True) for x, s in zip(b["words"], size))
        off = np.concatenate([[0], np.cumsum(np.concatenate(size), dtype=np.int64)])
        code = pc.dictionary_encode(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(raw)))
        kind, count = code.indices.to_numpy(), np.concatenate([_unpacked(x, n) for x, n in zip(b["c"], b["n"])]).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        f = np.add.reduceat(count[order], _starts(kind[order])[:-1])
        often = np.flatnonzero(f >= p.min_count)
        words = code.dictionary.take(pa.array(often))
        turn = pc.array_sort_indices(words).to_numpy()
        rank = np.full(len(f), -1, np.int64)
        rank[often[turn]] = base + np.arange(len(often))
        out += _answers(b, rank[kind])
        out += [{"id": (key[0].as_py() << _RANK_BITS) + base + i, "f": int(f[often[j]]), "lang": lang, "word": words[int(j)].as_py()} for i, j in enumerate(turn)]
        base += len(often)
    return pa.Table.from_pylist(out, _schema(_WORDS))


def _count_phrases(key, t: pa.Table, p: Params) -> pa.Table:
    """Of a bucket: the answers to its blocks, and its frequent phrases."""
    b = t.to_pydict()
    head = np.concatenate([np.cumsum(_unpacked(x, n, "<i8")) for x, n in zip(b["p"], b["n"])])
    word = np.concatenate([_unpacked(x, n, "<i8") for x, n in zip(b["w"], b["n"])])
    count = np.concatenate([_unpacked(x, n) for x, n in zip(b["c"], b["n"])])
    order = np.lexsort((word, head))
    head, word = head[order], word[order]
    cut = _starts(head, word)
    f = np.add.reduceat(count[order].astype(np.int64), cut[:-1])
    often = f >= p.min_count
    rank = np.empty(len(order), np.int64)
    rank[order] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), np.diff(cut))
    at, n, kinds = cut[:-1][often], int(often.sum()), _schema(_PHRASES)
    rows = {"id": pa.array((key[0].as_py() << _RANK_BITS) + np.arange(n)), "f": pa.array(f[often]), "p": pa.array(head[at]), "w": pa.array(word[at])}
    return pa.concat_tables([pa.Table.from_pylist(_answers(b, rank), kinds), pa.Table.from_arrays([rows.get(x.name, pa.nulls(n, x.type)) for x in kinds], schema=kinds)])


def _ordered(head: np.ndarray, word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each phrase, order by bucket and phrase)."""
    with np.errstate(over="ignore"):
        home = (C.mix(C.mix(head.astype(np.uint64)) + word.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return home, np.lexsort((word, head, home))


def _blocks(shard: int, head: np.ndarray, word: np.ndarray, count: np.ndarray, home: np.ndarray) -> list[dict]:
    """Blocks of a shard's phrases, in order of bucket and phrase."""
    cut = _starts(home)
    return [{"shard": shard, "bucket": int(home[lo]), "first": int(lo), "n": int(hi - lo), "p": _packed(np.diff(head[lo:hi], prepend=0), "<i8"), "w": _packed(word[lo:hi], "<i8"), "c": _packed(count[lo:hi])}
            for lo, hi in zip(cut[:-1], cut[1:])]


def _pairs(fore: np.ndarray, gids: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """(first known word, word before it, count, place, place in the other index, bucket) of a shard's phrases of two words, in order of bucket and phrase."""
    total = np.bincount(fore, minlength=len(gids) + 1)
    starts = np.concatenate([[0], np.cumsum(total)])[:-1]
    which, symbol, n, here, there = extend(fore, starts[1:], starts[1:], total[1:], False)
    head, word = gids[which], gids[symbol - 1]
    home, order = _ordered(head, word, buckets)
    return tuple(x[order] for x in (head, word, n, here, there, home))


def _build(key, left: pa.Table, right: pa.Table, p: Params, buckets: int) -> pa.Table:
    """The index of a shard (one row), and the blocks of its phrases of two words."""
    kinds = _schema(_INDEX)
    local, gids = _answered(right) if left.num_rows and right.num_rows else ((), ())
    if not len(local):
        return kinds.empty_table()
    own = left.to_pylist()[0]
    count = _unpacked(own["c"], own["n"])
    by = np.argsort(-count[local], kind="stable")
    dense = np.zeros(len(count) + 1, np.int32)
    dense[_by_count(count)[local[by]]] = np.arange(1, len(by) + 1)
    t = dense[_unpacked(own["tokens"], own["size"])]
    t = t[(t > 0) | (np.roll(t, 1) > 0)]
    if not len(t) or t.min() > 0:
        t = np.append(t, np.int32(0))
    fore, back = index(t, p.most_words)
    gids, shard = gids[by], key[0].as_py()
    head, word, n, _, _, home = _pairs(fore, gids, buckets)
    own = {"shard": shard, "size": len(t), "gids": _packed(gids, "<i8"), "left": _packed(fore), "right": _packed(back)}
    return pa.Table.from_pylist([own, *_blocks(shard, head, word, n, home)], kinds)


def _grow(key, left: pa.Table, right: pa.Table, to_left: bool, buckets: int) -> pa.Table:
    """Longer phrases of a shard: their blocks and places."""
    kinds = _schema(_FOUND)
    rows = left.to_pylist()
    own = next((r for r in rows if r["gids"] is not None), None)
    if own is None or not right.num_rows:
        return kinds.empty_table()
    bwt = _unpacked(own["bwt"], own["size"])
    words = int(bwt.max(initial=0))
    gids = _unpacked(own["gids"], words, "<i8")
    places = next((r for r in rows if r["lo"] is not None), None)
    if places is None:
        _, _, c, lo, other, _ = _pairs(bwt, gids, buckets)
    else:
        c, lo, other = (_unpacked(places[x], places["n"]).astype(np.int64) for x in ("c", "lo", "other"))
    some, ids = _answered(right)
    c, lo, other = c[some], lo[some], other[some]
    lo, other = (lo, other) if to_left else (other, lo)
    which, symbol, n, here, there = extend(bwt, lo, other, c, True)
    here, there = (here, there) if to_left else (there, here)
    head, word = ids[which], gids[symbol - 1]
    home, order = _ordered(head, word, buckets)
    if not len(order):
        return kinds.empty_table()
    shard, n = key[0].as_py(), n[order]
    places = {"shard": shard, "n": len(n), "c": _packed(n), "lo": _packed(here[order]), "other": _packed(there[order])}
    return pa.Table.from_pylist([places, *_blocks(shard, head[order], word[order], n, home[order])], kinds)


def _sized(df: DataFrame, rows: int, p: Params) -> DataFrame:
    return F.broadcast(df) if rows <= p.most_broadcast else df


def ngrams(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (text, lang): (lang, phrase, k, f) of the frequent phrases of one word or more, and (lang, n), all words of a language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    buckets = max(_LEAST_BUCKETS, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // p.bucket_bytes))
    shards, path = C.stored_at(rows.mapInArrow(lambda it: _shards(it, p, buckets), _SHARD), "phrase-shards")
    blocks = shards.filter("bucket is not null").drop("size", "tokens")
    sizes = C.stored(blocks.groupBy("lang").agg(F.sum("total").alias("n")), "phrase-sizes")
    counted = C.stored(blocks.groupBy("bucket").applyInArrow(lambda key, t: _count_words(key, t, p), _WORDS), "phrase-words")
    words = counted.filter("id is not null")
    n_words = words.count()
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")
    named = words.select(F.col("id").alias("w"), "word")
    out = level
    answers = [c.split()[0] for c in _ANSWER.split(", ")]
    hits = counted.filter("id is null").select(*answers)
    built = C.stored(shards.filter("tokens is not null").select("shard", "n", "c", "size", "tokens").groupBy("shard").cogroup(hits.groupBy("shard"))
                     .applyInArrow(lambda key, a, b: _build(key, a, b, p, buckets), _INDEX), "phrase-index")
    remove(docs.sparkSession, path)     # the index has all that is read of it
    found, n_level = built.filter("bucket is not null"), n_words
    for k in range(2, p.most_words + 1):
        to_left = k <= 3
        if k > 2:
            # with the index, the places of the phrases found last; those of two words are found once more, in the index that grows them to three
            side = built.filter("gids is not null").select("shard", "size", "gids", F.col("left" if to_left else "right").alias("bwt"))
            side = side.unionByName(found.filter("lo is not null").select("shard", "n", "c", "lo", "other"), allowMissingColumns=True)
            found = C.stored(side.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(_grower(to_left, buckets), _FOUND), "phrases-found")
        blocks = found.filter("bucket is not null").select("shard", "bucket", "first", "n", "p", "w", "c")
        counted = C.stored(blocks.groupBy("bucket").applyInArrow(lambda key, t: _count_phrases(key, t, p), _PHRASES), "phrases-frequent")
        more, hits = counted.filter("id is not null").select("id", "p", "w", "f"), counted.filter("id is null").select(*answers)
        below, n_below = level, n_level
        n_level = more.count()
        if not n_level:
            break
        both = more.join(_sized(below.select(F.col("id").alias("p"), "lang", "phrase"), n_below, p), "p").join(_sized(named, n_words, p), "w")
        level = C.stored(both.select("id", "lang", F.concat_ws(" ", *(("word", "phrase") if to_left else ("phrase", "word"))).alias("phrase"), F.lit(k).alias("k"), "f"), "phrases")
        out = out.unionByName(level)
    return out.drop("id"), sizes


def _grower(to_left: bool, buckets: int):
    return lambda key, left, right: _grow(key, left, right, to_left, buckets)


def extensions(grams: DataFrame) -> DataFrame:
    """The largest counts of ``grams`` (lang, phrase, k, f) with one word more: lang, phrase, to_left, to_right."""
    w = F.split("phrase", " ")
    each = grams.filter("k > 1").select("lang", "f", "k", w.alias("w")).select(
        "lang", F.explode(F.array(F.struct(F.expr("array_join(slice(w, 2, k - 1), ' ')").alias("phrase"), F.col("f").alias("to_left"), F.lit(None).cast("long").alias("to_right")),
                                  F.struct(F.expr("array_join(slice(w, 1, k - 1), ' ')").alias("phrase"), F.lit(None).cast("long").alias("to_left"), F.col("f").alias("to_right")))).alias("x"))
    return each.groupBy("lang", "x.phrase").agg(F.max("x.to_left").alias("to_left"), F.max("x.to_right").alias("to_right"))


def collocations(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut: lang, phrase, a, l, r, n, score, cut, to_left, to_right.

    Phrases that a longer one accounts for entirely are left out: then one with a single word more does, too."""
    grams, sizes = ngrams(docs, p)
    grams = C.stored(grams, "grams")
    many = grams.count()
    own = grams.filter("k > 1").join(extensions(grams), ["lang", "phrase"], "left").filter("100 * greatest(coalesce(to_left, 0), coalesce(to_right, 0)) < 100 * f")
    cuts = own.withColumn("w", F.split("phrase", " ")).select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "to_left", "to_right", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("rest"))
    for side, part in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(_sized(grams.select("lang", F.col("phrase").alias(part), F.col("f").alias(side)), many, p), ["lang", part])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(sizes, "lang").withColumn("top", (F.lit(1000).cast("decimal(4,0)") * whole("a")).cast("decimal(19,0)") * whole("n")).withColumn("bottom", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    return cuts.groupBy("lang", "phrase", "a", "n", "to_left", "to_right").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select(
        "lang", "phrase", "a", "x.l", "x.r", "n", "x.score", "x.cut", "to_left", "to_right")


def top_collocations(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = collocations(docs, p).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
sized AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM places),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS c FROM sized GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 100),
starts AS (SELECT lang, k, a, w, unnest(range(1, k)) AS i FROM cand WHERE k > 2),
inside AS (SELECT lang, a, k, w, i, unnest(range(2, least(k - 1, k - i + 1) + 1)) AS m FROM starts),
longer AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS most FROM inside GROUP BY 1, 2),
own AS (SELECT c.* FROM cand c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase WHERE g.most IS NULL OR 100 * g.most < 100 * c.a),
cuts AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM own),
scored AS (SELECT s.lang, s.phrase, s.a, s.cut, l.c AS l, r.c AS r, n.n, CAST((1000::HUGEINT * s.a * n.n) // (l.c::HUGEINT * r.c) AS BIGINT) AS score
           FROM cuts s JOIN n ON n.lang = s.lang
           JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(list_slice(s.w, 1, s.cut), ' ') AND l.k = s.cut
           JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(list_slice(s.w, s.cut + 1, s.k), ' ') AND r.k = s.k - s.cut),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY rank <= 2000
"""
