"""Exact cosine top-k search of query vectors against a corpus.

Plan: the queries are taken in blocks of about ``block_queries``; each block's normalised
matrix is broadcast, and one scan of the corpus scores its Arrow batches by matrix products.
A task keeps the ``k`` best rows per query over all its batches and emits them once. A final
``row_number() <= k`` per query (Spark adds a partial WindowGroupLimit before its shuffle)
picks the global top-k. Every corpus row is scored, so the result is exact; no pair table is
ever materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.operators import ai

BLOCK_QUERIES = 2_000       # query vectors broadcast with one scan of the corpus
MOST_BROADCAST = 200_000    # hits broadcast to fetch their payload
QUANT = 1_000_000           # centroid components are exact sums of 1e-6 units


def centroids(corpus: DataFrame, label_col: str = "label", vec_col: str = "embedding",
              dim: int | None = None) -> DataFrame:
    """One query vector per label: the mean vector, from exact integer sums."""
    if dim is None:
        dim = corpus.select(F.size(vec_col).alias("d")).where("d > 0").limit(1).collect()[0]["d"]
    sums = [F.sum(F.round(F.col(vec_col)[i].cast("double") * QUANT).cast("long")).alias(f"_s{i}")
            for i in range(dim)]
    g = corpus.groupBy(label_col).agg(F.count(F.lit(1)).alias("_n"), *sums)
    vec = F.array(*[F.col(f"_s{i}").cast("double") / F.col("_n").cast("double") / float(QUANT)
                    for i in range(dim)])
    return g.select(F.col(label_col).alias("query_id"), vec.alias("vector"))


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, sims), ties by the smaller id."""
    if len(ids) > k:
        at = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
        ids, sims = ids[at], sims[at]
    order = np.lexsort((ids, -sims))[:k]
    return ids[order], sims[order]


def _score(bq, k: int, c_id: str, c_vec: str, rank_digits: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_mat = bq.value
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q_ids]
        for b in batches:
            vecs = b[c_vec].tolist()
            ok = np.array([v is not None and len(v) == q_mat.shape[1] for v in vecs], dtype=bool)
            if not ok.any():
                continue
            ids = b[c_id].to_numpy()[ok]
            m = np.vstack([np.asarray(v, dtype=np.float64) for v, o in zip(vecs, ok) if o])
            norms = np.sqrt((m * m).sum(axis=1))
            nz = norms > 0
            ids, sims = ids[nz], (m[nz] @ q_mat.T) / norms[nz, None]
            if rank_digits is not None:
                sims = np.round(sims, rank_digits)
            for j, (old_ids, old_sims) in enumerate(best):
                new = sims[:, j]
                at = np.flatnonzero(new >= old_sims[-1]) if len(old_sims) == k else np.arange(len(new))
                best[j] = _best(np.concatenate([old_ids, ids[at]]), np.concatenate([old_sims, new[at]]), k)
        yield pd.DataFrame({"query_id": [q for q, (i, _) in zip(q_ids, best) for _ in i],
                            "vec_id": np.concatenate([i for i, _ in best]),
                            "similarity": np.concatenate([s for _, s in best])})
    return run


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, q_id: str = "query_id", q_vec: str = "vector",
          c_id: str = "vec_id", c_vec: str = "embedding", block_queries: int = BLOCK_QUERIES,
          digits: int | None = 6, rank_digits: int | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, vec_id, rank, similarity) for the ``k`` most similar corpus rows per
    query; ties broken by the smaller corpus id; zero/missing vectors never match, nor
    vectors of another length than the query's. Similarities that agree in
    ``rank_digits`` digits are ties. ``payload``: columns of the corpus to return with each hit
    (its ids must then be unique)."""
    spark = corpus.sparkSession
    qs = queries.select(F.col(q_id).alias("query_id"), F.col(q_vec).alias("vector")).where(F.col("vector").isNotNull())
    q_type = qs.schema["query_id"].dataType.simpleString()
    out = f"query_id {q_type}, vec_id long, similarity double"
    n_queries = qs.count()
    blocks = max(1, -(-n_queries // block_queries))
    block = F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks))
    slim = corpus.select(F.col(c_id).cast("long").alias(c_id), F.col(c_vec))
    cand = spark.createDataFrame([], out)
    for i in range(blocks):
        rows = qs.where(block == i).collect()          # one block of queries
        if not rows:
            continue
        q_mat = np.array([np.asarray(r["vector"], dtype=np.float64) for r in rows])
        qn = np.sqrt((q_mat * q_mat).sum(axis=1))
        good = qn > 0
        q_ids = [r["query_id"] for r, g in zip(rows, good) if g]
        if not q_ids:
            continue
        bq = spark.sparkContext.broadcast((q_ids, q_mat[good] / qn[good][:, None]))
        found = slim.mapInPandas(_score(bq, k, c_id, c_vec, rank_digits), out)
        cand = found if i == 0 else cand.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vec_id").asc())
    top = cand.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    sim = F.round("similarity", digits) if digits is not None else F.col("similarity")
    top = top.select("query_id", "vec_id", "rank", sim.alias("similarity"))
    if not payload:
        return top
    # the hits are at most k a query: broadcast while that is few, so that the corpus stays where it is
    top = F.broadcast(top) if n_queries * k <= MOST_BROADCAST else top
    return corpus.select(F.col(c_id).cast("long").alias("vec_id"), *payload).join(top, "vec_id").select(*top.columns, *payload)


def text_search(queries: DataFrame, corpus: DataFrame, k: int = 5, q_id: str = "query_id", q_text: str = "query", c_id: str = "vec_id",
                c_text: str = "message", model: ai.ModelSpec = ai.EMBED_MODEL) -> DataFrame:
    """Query texts and corpus texts embedded by one model, the ``k`` nearest messages of every query with their
    text: query_id, vec_id, rank, similarity, and the corpus' text column."""
    q = ai.embed(queries.select(F.col(q_id).alias("query_id"), F.col(q_text).alias("_t")), "_t", "vector", model).drop("_t")
    c = ai.embed(corpus.select(c_id, c_text), c_text, "embedding", model)
    return top_k(q, c, k, c_id=c_id, rank_digits=6, payload=(c_text,))


def limit_overall(result: DataFrame, n: int = 5) -> DataFrame:
    """LIMIT over the whole search result (deterministic: by query, then rank)."""
    return result.orderBy("query_id", "rank").limit(n)


def similarity(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Cosine similarity of two array columns of the same row (JVM expression)."""
    return df.withColumn(out, X.cosine(a, b))


def queries_from(spark, rows: list[tuple], with_vectors: bool = False) -> DataFrame:
    """Inline query rows (``INSERT ... VALUES``): (query) or (query_id, vector)."""
    if with_vectors:
        return spark.createDataFrame(rows, "query_id string, vector array<double>")
    return spark.createDataFrame(rows, "query string")
