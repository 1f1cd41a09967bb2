"""What the near-duplicate join leaves on disk and lets shuffle."""

import random
import time

from pyspark.sql import functions as F

import corpus_pipeline as cp
from pitwall.llm import common as C
from pitwall.llm import exact_dedup, jaccard
from tests.llm.conftest import DOCS


def shuffles(spark):
    """(name, bytes) of the shuffle files that there are."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = (files.apply(i) for i in range(files.size()))
    return {(f.getName(), f.length()) for f in found if f.getName().startswith("shuffle")}


def prose(seed, words=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(words))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    was = shuffles(spark)
    made = C.stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counted")
    until = time.time() + 20
    while (new := shuffles(spark) - was) and time.time() < until:
        time.sleep(0.2)
    assert not new and made.count() == 700
    assert spark.conf.get(C._CLEANUP, "false") == "false"


def test_copies_list_no_segments_and_what_was_read_goes(spark, make, monkeypatch):
    made, kept_at = [], C.stored_at

    def stored_at(df, name):
        out, path = kept_at(df, name)
        made.append((name, out.count(), path))
        return out, path

    monkeypatch.setattr(C, "stored_at", stored_at)
    near = prose(2).split()
    near[7] = "other"
    texts = [prose(1)] * 30 + [prose(2)] * 30 + [" ".join(near), None, ""]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(make(list(enumerate(texts)))).collect()}
    assert got == {**dict.fromkeys(range(30), 0), **dict.fromkeys(range(30, 61), 30), 61: 61, 62: 62}
    rows = {name: n for name, n, _ in made}
    listed = len(jaccard.listed_segments(*jaccard.shingle_sets(*C.flat(C.pa.array([texts[30]])), 5), C.np.zeros(jaccard._HOT_BUCKETS, bool), jaccard.Params())[0])
    # by chance the filter lets one copy through; all 61 documents would be 6,000 rows
    assert 0 < rows["segment-groups"] <= 4 * listed and rows["candidates"] == 1
    left = {name for name, _, path in made if _exists(spark, path)}
    assert not left & {"segment-groups", "open-groups", "large-star"}


def _exists(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_rows_alone_in_their_group_do_not_shuffle(spark, make):
    texts = [prose(i) for i in range(60)] + [prose(3)] * 5
    docs = make([(i, t, None, None, len(t)) for i, t in enumerate(texts)] + [(3, texts[3], None, None, 1), (None, texts[0], None, None, 2)])
    docs = C.stored(docs.repartition(3), "docs")
    was = {name for name, _ in shuffles(spark)}
    left = cp.near_duplicates(spark, docs, DOCS).collect()
    new = sum(size for name, size in shuffles(spark) if name not in was)
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == list(range(60)) and len(left) == 61
    assert new < 0.4 * sum(map(len, texts))


def test_sifted_never_misses_a_key(spark):
    keys = spark.range(0, 3000, 3).selectExpr("id as cell")
    for most in (1 << 15, 1 << 28):
        by = exact_dedup.sieve(keys, exact_dedup.Params(most_bits=most))
        got = exact_dedup.sifted(spark.range(3000).selectExpr("id as doc_id", "id * 2 as twice"), "doc_id", by, "maybe").collect()
        assert len(got) == 3000 and all(r.maybe for r in got if r.doc_id % 3 == 0)
        assert sum(r.maybe for r in got) < 1300
    none = exact_dedup.sieve(keys.limit(0))
    assert exact_dedup.sifted(keys, "cell", none, "maybe").filter("maybe").count() == 0


def test_wide_sketches_bound_the_difference_and_tell_large_sets_apart(spark, make, monkeypatch):
    rng = C.np.random.default_rng(3)
    for n, cut, new in ((1025, 3, 5), (2048, 1, 40), (2040, 0, 30), (5000, 300, 300), (6000, 4000, 4000)):
        own = C.np.unique(rng.integers(0, 2**jaccard.HASH_BITS, n, dtype=C.np.uint64))
        other = C.np.unique(C.np.concatenate([own[rng.permutation(len(own))[cut:]], rng.integers(0, 2**jaccard.HASH_BITS, new, dtype=C.np.uint64)]))
        if min(len(own), len(other)) > jaccard.BITS:
            far = jaccard.wide_distance(jaccard.wide_sketch(own), jaccard.wide_sketch(other))
            assert far <= len(C.np.setxor1d(own, other)) and (far > jaccard.Params().most_different(len(own) + len(other))) == (cut > 2000)
    made, kept_at = {}, C.stored_at

    def stored_at(df, name):
        out, path = kept_at(df, name)
        made[name] = out.count()
        return out, path

    monkeypatch.setattr(C, "stored_at", stored_at)
    words = prose(4, 6000).split()
    texts = [" ".join(words), " ".join(words[:4200]) + " " + prose(5, 1800), " ".join(words[:5900])]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(make(list(enumerate(texts)))).collect()}
    assert got == {0: 0, 1: 1, 2: 0} and made["stars"] >= 2 and made["candidates"] == 1
