"""Operators 1, 4, 5, 6 and 7 and the pipeline against brute force and edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwall.llm import ann, components, jaccard, mixing, packing, queries, suffix_dedup
from tests.llm.conftest import DOCS, EMPTY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name, sf=DOCS):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- suffix-array dedup


def plain_repeats(texts, length, keep):
    """Covered bytes of each text, by a table of all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, b in enumerate(raw):
        for j in range(len(b) - length + 1):
            seen[b[j:j + length]].append((i, j))
    cover = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        for i, j in places[1:] if keep == "first" else places if len(places) > 1 else []:
            cover[i][j:j + length] = True
    return [(len(b), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(np.int8)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest())
            for b, c in zip(raw, cover)]


def plain_passages(texts, length, words):
    """(bytes, bytes cut) where only later copies in runs of so many words go."""
    raw = [(t or "").encode() for t in texts]
    seen, out = set(), []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            w = b[j:j + length]
            if w in seen:
                cover[j:j + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))).reshape(-1, 2)
        out.append((len(b), sum(int(z - a) for a, z in edge if len(re.findall(rb"[^\x20\x09-\x0D]+", b[a:z])) >= words)))
    return out


def made_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    say = lambda k: " ".join(word() for _ in range(k))
    shared = [say(30) for _ in range(4)]
    out = [None, "", "x", "ab" * 300, "ab" * 300, "a" * 500]
    for _ in range(n):
        t = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            t += [rng.choice(shared), say(rng.randint(0, 20))]
        out.append(" ".join(t))
    return out + out[10:14]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most_runs", [512, 2])
def test_dedup_equals_brute_force(spark, keep, most_runs):
    texts = made_texts(1)
    p = suffix_dedup.Params(length=40, gram=12, most_runs=most_runs, block_suffixes=300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(suffix_dedup.dedup_text(docs, keep, p).collect(), key=lambda r: r.row.doc_id)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["sha256"]) for r in got] == plain_repeats(texts, 40, keep)
    assert got[0].row.text is None and all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["sha256"] for r in got)


def test_dedup_query_equals_brute_force(spark):
    docs = table(spark, "documents").orderBy("doc_id").collect()
    got = sorted(queries.op1_suffix_dedup(spark, DOCS).collect())
    assert [tuple(r)[:5] for r in got] == [(d.doc_id, *x) for d, x in zip(docs, plain_repeats([d.text for d in docs], 400, "none"))]


def test_dedup_edges(spark, make):
    p = suffix_dedup.Params(length=40, gram=12)
    out = suffix_dedup.dedup_text(make(EMPTY).withColumnRenamed("lang", "doc"), "none", p)
    assert out.count() == 6 and out.filter("n_removed > 0").count() == 0 and "doc" in out.select("row.*").columns
    assert suffix_dedup.dedup_text(make([]), "first", p).count() == 0
    same = make([(None, "z" * 39 + "y" * 40), (7, "z" * 39 + "y" * 40), (7, "z" * 39 + "y" * 40)])
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup_text(same, "none", p).collect()) == [79, 79, 79]
    assert sorted((r.row.doc_id or 0, r["n_removed"]) for r in suffix_dedup.dedup_text(same, "first", p).collect()) == [(0, 0), (7, 79), (7, 79)]


def test_previous_factors_equal_definition():
    rng = random.Random(2)
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 80))) + bytes(8)
        data = np.frombuffer(text, np.uint8)
        start = np.arange(len(text) - 8)
        order, lcp = suffix_dedup.sorted_suffixes(data, start, 8)
        common = lambda i, j: next((k for k in range(8) if text[i + k] != text[j + k]), 8)  # noqa: B023, E731
        want = [max([common(i, j) for j in range(i)], default=0) for i in start]
        assert suffix_dedup.previous_factors(order, start, lcp).tolist() == want
        cut = suffix_dedup.previous_factors(order, start, lcp, 5)
        assert cut.tolist() == [x if x >= 5 else 0 for x in want]


# --- n-gram Jaccard join


def plain_sets(texts):
    out = []
    for t in texts:
        ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    return out


def plain_components(ids, sets):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    owner = defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            owner[g].append(n)
    pairs = {p for o in owner.values() for p in itertools.combinations(o, 2)}
    for x, y in pairs:
        both = len(sets[x] & sets[y])
        if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((top(ids[x]), top(ids[y])))
            root[b] = a
    return [(i, len(s), top(i)) for i, s in zip(ids, sets)]


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 20, 40, 90, 200]))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 20))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.5:
                t = t + [rng.choice(vocabulary) for _ in range(rng.randint(0, len(t) // 10 + 1))]
            out.append(" ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    out += [common + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))) for _ in range(40)]
    return out + [None, "", " \t", "É é É é É é", "é é é é é é"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_equals_brute_force(spark, seed):
    texts = near_copies(seed)
    ids = [3 * i + 1 for i in range(len(texts))]
    random.Random(seed).shuffle(ids)
    got = jaccard.jaccard_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_components(ids, plain_sets(texts)))


def test_jaccard_query_equals_brute_force(spark):
    docs = table(spark, "documents").collect()
    want = sorted(plain_components([d.doc_id for d in docs], plain_sets([d.text for d in docs])))
    assert sorted(map(tuple, queries.op7_jaccard_join(spark, DOCS).collect())) == want


def test_jaccard_edges(spark, make):
    got = sorted(map(tuple, jaccard.jaccard_components(make(EMPTY)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (5, 1, 5), (5, 1, 5)], key=str)
    assert jaccard.jaccard_components(make([])).count() == 0
    two = make([(5, "a b c d e f"), (5, "u v w x y z"), (9, "u v w x y z"), (2, "a b c d e f")])
    assert {r.component_id for r in jaccard.jaccard_components(two).collect()} == {2}


def test_listed_segments_meet():
    """Any two similar sets share one of their listed segments, whatever is frequent."""
    rng = np.random.default_rng(4)
    p = jaccard.Params()
    for n in [1, 2, 4, 5, 8, 9, 15, 16, 17, 31, 33, 60, 64, 100, 127, 128, 129, 200, 255, 256, 300]:
        for _ in range(20):
            own = np.unique(rng.integers(0, 2**jaccard.HASH_BITS, n, dtype=np.uint64))
            d = rng.integers(0, n // 4 + 1)
            other = np.unique(np.concatenate([own[rng.permutation(len(own))[int(rng.integers(0, d + 1)):]], rng.integers(0, 2**jaccard.HASH_BITS, d, dtype=np.uint64)]))
            both = len(np.intersect1d(own, other))
            if 100 * both < 80 * (len(own) + len(other) - both):
                continue
            hot = rng.random(jaccard._HOT_BUCKETS) < rng.choice([0, 0.3, 1.0])
            keys = [set(jaccard.listed_segments(np.zeros(len(s), np.int64), np.sort(s), hot, p)[1].tolist()) for s in (own, other)]
            assert keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(1, 400), rng.randint(1, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for p in links for x in p if p[0] != p[1]})
    root = {n: n for n in nodes}
    for _ in range(60):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- nearest neighbours


def plain_nearest(rows, asked, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = set()
    for qid, q in asked:
        s = (x * np.array(q, float)).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != qid][:k]
        out |= {(qid, n + 1, int(ids[i])) for n, i in enumerate(order)}
    return out


def test_ann_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "embeddings", "/root/testdata/sf0.1").collect()]
    want = plain_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = queries.op4_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & {(a, c) for a, _, c in want}) / len(want) >= 0.95
    at = {i: np.array(v, float) for i, v in rows}
    assert all(abs(r.score - float(at[r.query_id] @ at[r.vec_id])) < 1e-9 for r in got[:500])


def test_ann_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same) for i in range(300)] + [(300 + i, rng.standard_normal(8).tolist()) for i in range(50)]
    bad = [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [None] + [1.0] * 7), (480, [float("inf")] * 8), (500, [1.0]), (None, same), (520, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit("x"), "v": F.lit(0), "id": F.lit(9)})
    p = ann.Params(k=5, leaf=16, rows_per_shard=100, confidence=0.9999)
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df.filter("vec_id % 20 = 0"), p).collect()}
    assert got == plain_nearest(rows, [r for r in rows if r[0] % 20 == 0], 5)
    few = df.filter("vec_id < 3")
    assert ann.search(few, few, p).count() == 6
    assert ann.search(df.filter("false"), df, p).count() == 0 and ann.search(df, df.filter("false"), p).count() == 0


def test_ann_malformed_first_row_and_repeated_queries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(1, 61)]
    df = spark.createDataFrame([(0, [1.0, 2.0])] + rows + [r for r in rows if r[0] == 20], "vec_id long, embedding array<double>")
    p = ann.Params(k=4, leaf=8, rows_per_shard=20, confidence=0.9999)
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df.filter("vec_id % 20 = 0"), p).collect()}
    assert {(q, k) for q, k, _ in got} == {(q, k) for q in (20, 40, 60) for k in (1, 2, 3, 4)}
    plain = plain_nearest(rows, [r for r in rows if r[0] % 20 == 0], 4)
    assert {x for x in got if x[0] == 20} == {x for x in plain if x[0] == 20}


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(10, 0.95) - 18.307) < 1e-3 and abs(ann.chi_square_quantile(2, 0.5) - 1.3863) < 1e-3


# --- mixing


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_mixing(spark, sf).collect()
    assert len(rows) == table(spark, "documents", sf).count()
    post, tok, rate = (np.array([r[c] for r in rows]) for c in ("posterior", "n_tokens", "rate"))
    got = (tok * rate) @ post
    names = sorted({f"q{r.quality}t{r.toxic}" for r in table(spark, "labels", sf).collect()})
    want = np.array([mixing.Fit().targets.get(n, 0.0) for n in names])
    assert np.abs(got / got.sum() - want / want.sum()).max() < 0.005
    assert (rate >= 0).all() and np.allclose(post.sum(1), 1)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(3)
    post = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tok = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tok, post)], "n_tokens long, posterior array<double>")
    how = mixing.Fit(targets={"a": 0.7, "b": 0.2, "c": 0.1}, steps=200, tolerance=1e-5)
    rates = mixing.fit_rates(members, ["a", "b", "c"], how)
    got = (tok * rates.trace(post)[0]) @ post
    assert np.allclose(got / got.sum(), [0.7, 0.2, 0.1], atol=2e-3)


def test_mixing_edges(spark, make):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make([(i, "bad words here" if i % 2 else "fine words there") for i in range(60)] + EMPTY)
    out = mixing.mixing_rates(docs, labels).collect()
    assert len(out) == 66 and all(r.n_tokens == 0 for r in out if r.doc_id in (1, 2, 3) and r.n_tokens == 0)
    kept = mixing.resample(docs, labels)
    assert kept.columns == docs.columns and 30 <= kept.filter("text = 'fine words there'").count() <= 36
    assert kept.filter("text = 'bad words here'").count() < 10
    assert mixing.mixing_rates(docs, labels.filter("false")).filter("rate = 1").count() == 66
    assert mixing.mixing_rates(make([]), labels).count() == 0 and mixing.resample(make([]), labels).count() == 0


@pytest.mark.parametrize("rare", ["toxic", "poor"])
def test_scarce_domains_cost_no_clean_document(spark, make, rare):
    rng = random.Random(5)
    kinds = ["clean"] * 510 + ["poor"] * (84 if rare == "toxic" else 6) + ["toxic"] * (6 if rare == "toxic" else 84)
    docs = make([(i, " ".join(f"{kind}{rng.randrange(20)}" for _ in range(40))) for i, kind in enumerate(kinds)])
    labels = spark.createDataFrame([(i, int(k != "poor"), int(k == "toxic")) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    left = {r.doc_id for r in mixing.resample(docs, labels).select("doc_id").distinct().collect()}
    assert set(range(510)) <= left


# --- packing


def check_packing(pieces, capacity):
    bins = defaultdict(list)
    for r in pieces:
        bins[r.bin_id].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in rows:
            assert r.bin_offset == at and r.n_words > 0
            at += r.n_words
        assert at <= capacity
        assert len({r.source for r in rows}) == len(rows) == len({r.cluster for r in rows})
    return bins


def test_packing_query(spark):
    pieces = queries.op6_packing(spark, DOCS).collect()
    check_packing(pieces, 2048)
    got = defaultdict(list)
    for r in pieces:
        got[r.doc_id].append((r.piece, r.first_word, r.n_words))
    for d in table(spark, "documents").collect():
        n, at = len(WORD.findall(d.text or "")), 0
        for i, (piece, first, words) in enumerate(sorted(got[d.doc_id])):
            assert piece == i and first == at
            at += words
        assert at == n


def test_packing_takes_the_tightest_compatible_bin():
    rng = random.Random(2)
    for _ in range(20):
        bins, plain = packing.Bins(100), []
        for _ in range(200):
            size, s, c = rng.randint(1, 60), 1 << rng.randrange(6), 1 << rng.randrange(30)
            fit = [b for b in plain if b[0] >= size and not b[1] & s and not b[2] & c]
            number, at = bins.place(size, s, c)
            if fit:
                assert number < len(plain) and plain[number][0] == min(b[0] for b in fit) and at == 100 - plain[number][0]
                assert not plain[number][1] & s and not plain[number][2] & c
                plain[number] = (plain[number][0] - size, plain[number][1] | s, plain[number][2] | c)
            else:
                assert number == len(plain) and at == 0
                plain.append((100 - size, s, c))


def test_packing_fills_sequences(spark):
    """Only real conflicts keep pieces apart: few sequences beyond what the words and the largest source ask for."""
    sf = "/root/testdata/sf0.1"
    pieces = packing.pack(table(spark, "documents", sf), packing.Params(block=1 << 20)).collect()
    bins = check_packing(pieces, 2048)
    rest = Counter(r.source for r in pieces if r.n_words < 2048)
    full = sum(r.n_words == 2048 for r in pieces)
    least = max(-(-sum(r.n_words for r in pieces) // 2048), full + max(rest.values()))
    assert len(bins) <= 1.1 * least


def test_packing_many_sources_share_a_sequence():
    rows = [(i, f"s{i}", i, 10) for i in range(600)]
    assert len({r[0] for r in packing.pack_rows(rows, 1000)}) == 6


def test_packing_edges(spark, make):
    p = packing.Params(capacity=4, block=3)
    rows = [(i, "a b c d e f g h i"[: 2 * (i % 9) + 1], "en", None if i % 3 else "s") for i in range(40)]
    check_packing(packing.pack(make(rows + EMPTY), p).collect(), 4)
    assert packing.pack(make([]), p).count() == 0


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp
    docs = table(spark, "documents")
    first = {r.doc_id: r for r in docs.collect()}
    seen = docs
    for name, stage in cp.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, DOCS).collect(), docs.schema)
        assert seen.columns == docs.columns and seen.count() > 0
        if name == "near_duplicates":
            left = [r.doc_id for r in seen.collect()]
            comp = {i: c for i, _, c in plain_components([r.doc_id for r in before], plain_sets([r.text for r in before]))}
            assert sorted(left) == sorted(set(comp.values()))
        if name == "repeated_passages":
            texts = sorted(before, key=lambda r: r.doc_id)
            want = {r.doc_id: n - k for r, (n, k) in zip(texts, plain_passages([r.text for r in texts], 220, 51))}
            assert {r.doc_id: len(r.text.encode()) for r in seen.collect()} == {i: n for i, n in want.items() if n}
        before = seen.collect()
    assert set(r.doc_id for r in before) <= set(first)
    check_packing(cp.STAGES[-1][1](spark, seen, DOCS).collect(), 2048)
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5


def test_passages_of_51_words(spark, make):
    """A passage of 51 short words goes from all texts but the first; one of 48 words stays (a part of a neighbouring word counts)."""
    import corpus_pipeline as cp
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5))) for _ in range(n))
    long, short = say(51), say(48)
    rows = [(i, f"{say(60)}\n{long}\n{say(40)}") for i in range(3)] + [(i, f"{say(60)}\n{short}\n{say(40)}") for i in range(3, 6)]
    got = {r.doc_id: r.text for r in cp.repeated_passages(spark, make(rows), DOCS).collect()}
    assert [long in got[i] for i in range(3)] == [True, False, False]
    assert all(got[i] == t for i, t in rows if i in (0, 3, 4, 5))
    assert all(len(t) - len(got[i]) >= len(long) for i, t in rows[1:3])


def test_unlike_texts_under_one_id(spark, make):
    import corpus_pipeline as cp
    rng = random.Random(9)
    say = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    a, b = say(100), say(100)
    rows = [(5, a), (5, b), (5, b), (3, a + " tail"), (7, say(50)), (None, a)]
    left = cp.near_duplicates(spark, make(rows), DOCS).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(3, a + " tail"), (5, b), (7, rows[4][1]), (0, a)])


def test_dedup_with_the_operators_column_names(spark):
    docs = spark.createDataFrame([(1, "ab" * 40, 1, 2, "x", "y"), (2, "ab" * 40, 3, 4, "z", None)], "doc_id long, text string, doc long, th long, kept string, `spans` string")
    out = suffix_dedup.dedup_text(docs, "none", suffix_dedup.Params(length=20, gram=8)).collect()
    assert sorted(tuple(r.row)[2:] for r in out) == [(1, 2, "x", "y"), (3, 4, "z", None)] and all(r.n_removed == 80 for r in out)


def test_pipeline_of_an_empty_table(spark, make):
    import corpus_pipeline as cp
    docs = make([])
    for _, stage in cp.STAGES:
        docs_next = stage(spark, docs, DOCS)
        assert docs_next.count() == 0
    odd = make(EMPTY)
    for _, stage in cp.STAGES[:-1]:
        odd = spark.createDataFrame(stage(spark, odd, DOCS).collect(), odd.schema)
