import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.operators import ai, vector

QS = "query_id int, vector array<double>"
CS = "vec_id long, embedding array<float>"


def brute(queries, corpus, k):
    out = []
    for qid, q in queries:
        q = np.asarray(q, dtype=np.float64)
        sims = []
        for cid, c in corpus:
            if c is None or len(c) != len(q):
                continue
            c = np.asarray(c, dtype=np.float64)
            nc, nq = np.linalg.norm(c), np.linalg.norm(q)
            if nc == 0 or nq == 0:
                continue
            sims.append((-(c @ q) / (nc * nq), cid))
        for rank, (s, cid) in enumerate(sorted(sims)[:k], start=1):
            out.append((qid, cid, rank, round(-s, 6)))
    return sorted(out)


def test_topk_matches_brute_force_with_ties_zero_and_null(spark):
    rng = np.random.default_rng(0)
    corpus = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    corpus += [(1000, [0.0] * 8), (1001, None), (1002, [1.0] * 3)]      # zero, null, wrong length
    corpus += [(2000, corpus[5][1]), (2001, corpus[5][1])]              # exact ties
    queries = [(1, corpus[5][1]), (2, rng.normal(size=8).tolist()), (3, [0.0] * 8)]
    cdf = spark.createDataFrame(corpus, CS).repartition(4)
    qdf = spark.createDataFrame([(a, [float(x) for x in b]) for a, b in queries], QS)
    got = sorted(tuple(r) for r in vector.top_k(qdf, cdf, 5).collect())
    assert got == brute(queries, corpus, 5)
    ranks_q1 = sorted((r for r in got if r[0] == 1), key=lambda r: r[2])
    assert [r[1] for r in ranks_q1[:3]] == [5, 2000, 2001]             # ties: smaller id first


def test_fewer_rows_than_k(spark):
    cdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], CS)
    qdf = spark.createDataFrame([(7, [1.0, 0.1])], QS)
    got = vector.top_k(qdf, cdf, 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]


def test_more_queries_than_a_block(spark):
    cdf = spark.createDataFrame([(i, [1.0, i / 7.0]) for i in range(40)], CS)
    qdf = spark.createDataFrame([(i, [1.0, i / 5.0]) for i in range(11)] + [(11, [0.0, 0.0]), (12, None)], QS)
    one = sorted(map(tuple, vector.top_k(qdf, cdf, 3).collect()))
    assert len(one) == 33 and sorted(map(tuple, vector.top_k(qdf, cdf, 3, block_queries=2).collect())) == one


def test_centroids_exact(spark):
    cdf = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0), (3, [5.0, 5.0], 1)],
                                "vec_id long, embedding array<float>, label int")
    got = {r.query_id: r.vector for r in vector.centroids(cdf).collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 5.0]}


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])],
                               "a array<float>, b array<float>")
    got = [r.s for r in df.select(X.cosine("a", "b").alias("s")).collect()]
    assert abs(got[0] - 2 ** -0.5) < 1e-12 and got[1] is None and got[2] is None


def test_limit_overall(spark):
    res = spark.createDataFrame([(q, i, r, 0.5) for q in (1, 2) for r, i in enumerate([10, 11, 12], 1)],
                                "query_id int, vec_id long, rank int, similarity double")
    got = [(r.query_id, r.rank) for r in vector.limit_overall(res, 4).collect()]
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_payload_and_text_search(spark):
    messages = [(1, "Red car leads the race"), (2, "the red car leads the race"), (3, "rain at turn nine"), (4, None), (5, ""), (6, "RED CAR!"), (7, "x " * 100_000)]
    corpus = spark.createDataFrame([(i, m, "extra") for i, m in messages], "vec_id long, message string, rank string")
    queries = spark.createDataFrame([(1, "red car"), (2, "Turn nine?"), (3, None), (4, " !? ")], "id int, query string")
    got = vector.text_search(queries, corpus, 2, q_id="id").collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.similarity, r.message) for r in got)[0] == (1, 1, 6, 1.0, "RED CAR!")
    assert {r.query_id for r in got} == {1, 2} and len(got) == 4
    assert [r.message for r in got if r.query_id == 2 and r.rank == 1] == ["rain at turn nine"]


def test_embedding_in_the_jvm_equals_python(spark):
    texts = ["", "One two_three two", "été ÉTÉ 99 a-b", None, "tab\tnew\nline", "漢字 漢字 x"]
    df = ai.embed(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "e")
    assert "Python" not in df._jdf.queryExecution().toString()
    assert [r.e for r in df.orderBy("i").collect()] == [None if v is None else [float(x) for x in v] for v in ai.hashed_bow(texts)]
