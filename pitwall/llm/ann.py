"""Approximate nearest neighbours (operator 4): few stable projections, a kd-tree, a chi-square stop.

Largest inner product becomes smallest distance by one more coordinate: a row x gets
sqrt(M^2 - |x|^2), a query gets 0 (M: the largest norm). Gaussian projections to ``dims``
coordinates keep distances in the mean, and projected squared distance over true squared distance
follows a chi-square law with ``dims`` degrees. Rows are dealt evenly by a hash of their id to
shards; each shard projects its rows into a kd-tree whose leaves hold up to ``leaf`` rows. A query
takes leaves in order of projected distance and verifies their rows on the original vectors, until
the chi-square test says that a closer row would have come before with probability ``confidence``
(equal distances are still visited). Every shard's best ``k`` are merged.

Queries stream past each shard in blocks, so memory is one shard and one block. A copy's score is
computed the same way in any place, so ties are exact and go to the smaller id.

Rows whose vector is null, empty, zero or holds null or non-finite components take no part, nor do
rows with a null id; the vector of the smallest id sets the length, and vectors of another length take no
part. Repeated ids are rows of their own, but a
query never meets rows of its own id. Fewer candidates than ``k``: all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.llm import common as C

SCHEMA = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Params:
    k: int = 20
    dims: int = 10
    leaf: int = 128
    confidence: float = 0.97
    rows_per_shard: int = 8_192
    seed: int = 11


def chi_square_quantile(dims: int, p: float) -> float:
    """Smallest x whose chi-square distribution function reaches p (even ``dims``: a finite sum), by bisection."""
    half = dims // 2

    def cdf(x):
        term, total = 1.0, 1.0
        for i in range(1, half):
            term *= (x / 2) / i
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 40.0 * dims
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of each leaf: halved at the median of the widest coordinate (copies are split, too)."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = points[rows]
        axis = int((own.max(0) - own.min(0)).argmax())
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float, p: Params):
        self.ids, self.x, self.p = ids, x, p
        self.norm2 = norm * norm
        self.proj = np.random.default_rng(p.seed).standard_normal((x.shape[1] + 1, p.dims))
        extra = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        y = x @ self.proj[:-1] + extra[:, None] * self.proj[-1]
        leaves = kd_leaves(y, p.leaf)
        self.rows = np.concatenate(leaves)
        self.edge = np.concatenate([[0], np.cumsum([len(r) for r in leaves])])
        self.ids, self.x = ids[self.rows], x[self.rows]
        self.low = np.stack([y[r].min(0) for r in leaves])
        self.high = np.stack([y[r].max(0) for r in leaves])
        self.bound = chi_square_quantile(p.dims, p.confidence)

    def search(self, qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vec_id, score) of the best rows found for each query."""
        n, k = len(qid), self.p.k
        at = q @ self.proj[:-1]
        gap = np.zeros((n, len(self.low)))
        for d in range(self.p.dims):
            g = np.maximum(self.low[:, d] - at[:, d, None], 0) + np.maximum(at[:, d, None] - self.high[:, d], 0)
            gap += g * g
        order = np.argsort(gap, axis=1, kind="stable")
        qq = (q * q).sum(1) + self.norm2
        best_s = np.full((n, k), -np.inf)
        best_r = np.full((n, k), -1)
        active = np.arange(n)
        for rank in range(order.shape[1]):
            leaf = order[active, rank]
            reach = np.maximum(qq[active] - 2 * best_s[active, -1], 0)
            # test of the chi-square stop; rounding is given away on the side of going on
            go = gap[active, leaf] <= reach * self.bound * (1 + 1e-9) + 1e-9 * qq[active]
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            for group in np.split(by, cuts):
                a, z = self.edge[leaf[group[0]]], self.edge[leaf[group[0]] + 1]
                who = active[group]
                s = q[who] @ self.x[a:z].T
                s[qid[who][:, None] == self.ids[None, a:z]] = -np.inf
                eps = 1e-12 * qq[who]
                for j in np.flatnonzero(s.max(1) >= best_s[who, -1] - eps):
                    i = who[j]
                    new = np.flatnonzero((s[j] >= best_s[i, -1] - eps[j]) & (s[j] > -np.inf))
                    rows = np.concatenate([best_r[i][best_r[i] >= 0], a + new])
                    exact = np.concatenate([best_s[i][best_r[i] >= 0], self.exact(q[i], a + new)])
                    top = np.lexsort((self.ids[rows], -exact))[:k]
                    best_s[i, :len(top)], best_r[i, :len(top)] = exact[top], rows[top]
        who, place = np.nonzero(best_r >= 0)
        return who, self.ids[best_r[who, place]], best_s[who, place]

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products summed the same way for every row, so that equal vectors get equal scores."""
        return (self.x[rows] * q).sum(1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(
        F.forall("v", lambda x: x.isNotNull()) & F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))


def search(vectors: DataFrame, queries: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's nearest rows: query_id, rank (from 1), vec_id, score."""
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    # the most frequent length (the smaller of two as frequent) is the length of a vector
    facts = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).orderBy(
        F.col("n").desc(), "d").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not facts:
        return empty
    facts = facts[0]
    rows, asked = rows.filter(F.size("v") == facts.d), asked.filter(F.size("v") == facts.d).groupBy("id").agg(F.min("v").alias("v"))
    d, norm = facts.d, float(facts.norm)
    shards = max(1, -(-facts.n // p.rows_per_shard))
    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v"))

    def run(batches):
        own_id, own_x, at, tree = [], [], None, None
        for b in batches:
            shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids = b.column(2).to_numpy()
            v = b.column(3)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            cuts = np.flatnonzero(np.diff(shard * 2 + kind)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if hi <= lo:
                    continue
                if shard[lo] != at:
                    at, own_id, own_x, tree = shard[lo], [], [], None
                if kind[lo] == 0:
                    own_id.append(ids[lo:hi].copy())
                    own_x.append(x[lo:hi].copy())
                    continue
                if tree is None and own_id:
                    tree = Shard(np.concatenate(own_id), np.concatenate(own_x), norm, p)
                    own_id, own_x = [], []
                for q in range(lo, hi if tree else lo, 1024):
                    z = min(q + 1024, hi)
                    who, vec, s = tree.search(ids[q:z], x[q:z])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q:z][who]), pa.array(vec.astype(np.int64)), pa.array(s)], ["query_id", "vec_id", "score"])

    near = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
