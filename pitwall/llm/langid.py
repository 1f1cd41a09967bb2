"""Language identification (operator 10): nearest centroid over character n-gram vectors.

Texts become normalised TF-IDF vectors of hashed letter n-grams (2 and 3 bytes; lower case;
whatever is no letter is one blank). Document frequencies come from all learnable rows. Each language gets
several centroids by spherical k-means over a bounded sample of labelled rows
(``Fit.per_language`` rows expected for each language, chosen by a hash of the id). A text goes
to the language of the nearest centroid by cosine; it is rejected when it is further away than
training texts of its length are (``Fit.quantile`` plus ``Fit.slack``).

Null text, or text without a letter: ``und``, score 0, rejected. Null labels are never learned.
Ties go to the language first in order. Without any labelled row all texts are ``und``. Repeated
ids and extra columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm import common as C

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, distance double, rejected boolean"
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_BUCKETS = 20


@dataclass(frozen=True)
class Fit:
    per_language: int = 500
    centroids: int = 4
    dims: int = 2048
    #: Clusters that hold less than this share of a language's sample are dropped (stray labels).
    min_share: float = 0.08
    rounds: int = 12
    quantile: float = 0.999
    slack: float = 0.15
    #: Sharpness of the score.
    sharpness: float = 25.0


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centers: np.ndarray
    owner: np.ndarray
    limit: np.ndarray
    fit: Fit


def counts(buf: np.ndarray, off: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts, n-grams) of each text; the buffer holds lower-case text."""
    m, n = len(off) - 1, len(buf)
    if n < 2:
        return np.zeros((m, dims), np.float32), np.zeros(m, np.int64)
    b = _LETTER[buf].astype(np.uint32)
    row = np.repeat(np.arange(m), np.diff(off))
    out, total = np.zeros(m * dims, np.float32), np.zeros(m, np.int64)
    for k in (2, 3):
        if n < k:
            continue
        code = (b[:-1] << np.uint32(8) | b[1:]) if k == 2 else (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])
        ok = (row[k - 1:] == row[:n - k + 1]) & (code != (0x2020 if k == 2 else 0x202020))
        r = row[:n - k + 1][ok]
        h = ((code[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(dims)
        out += np.bincount(r * dims + h.astype(np.int64), minlength=m * dims)
        total += np.bincount(r, minlength=m)
    return out.reshape(m, dims), total


def vectors(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows (1 + log of the count)."""
    v = np.log1p(x) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _text(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"),
                       F.col("text").rlike(r"\p{L}").alias("has_letter"), *more)


def fit(docs: DataFrame, how: Fit = Fit()) -> Model | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that are labelled and not held out."""
    train = docs.filter(~C.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r.lang: min(1.0, how.per_language / r.n) for r in
             train.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    if not share:
        return None
    dims = how.dims

    def frequencies(batches):
        df, n = np.zeros(dims, np.int64), 0
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                x, total = counts(buf, off, dims)
                df += (x > 0).sum(0)
                n += int((total > 0).sum())
        yield pa.RecordBatch.from_pydict({"i": np.arange(dims + 1), "n": np.append(df, n)})

    seen = np.zeros(dims + 1)
    for r in _text(train).mapInArrow(frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        seen[r.i] = r.n
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 0.1

    rate = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang").cast("string"))
    pick = (F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1_000_003)) < rate * 1_000_003)

    def sample(batches):
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                x, total = counts(buf, off, dims)
                yield pa.RecordBatch.from_arrays(
                    [b.column(3).slice(lo, hi - lo), pa.array(total), pa.array([r.astype(np.float32).tobytes() for r in vectors(x, idf)])],
                    ["lang", "total", "v"])

    got = _text(train.filter(pick), F.col("lang").cast("string").alias("lang")).mapInArrow(sample, "lang string, total long, v binary").collect()
    got = sorted((r for r in got if r.total), key=lambda r: (r.lang, r.v))
    if not got:
        return None
    x = np.stack([np.frombuffer(r.v, np.float32) for r in got])
    lang = np.array([r.lang for r in got])
    languages = sorted(set(lang))
    centers, owner = [], []
    for i, name in enumerate(languages):
        own = x[lang == name]
        for c in _spherical_means(own, how):
            centers.append(c)
            owner.append(i)
    centers, owner = np.stack(centers), np.array(owner)
    # how far training texts of a length lie from their language's nearest centroid
    near = np.where(owner[None, :] == np.searchsorted(languages, lang)[:, None], x @ centers.T, -1).max(1)
    size = _bucket(np.array([r.total for r in got]))
    limit = np.full(_BUCKETS, np.nan)
    for k in range(_BUCKETS):
        if (size == k).sum() >= 5:
            limit[k] = np.quantile(1 - near[size == k], how.quantile) + how.slack
    # a shorter text may lie as far away as a longer one; lengths never seen get no stricter limit than their neighbours
    limit = np.fmax.accumulate(limit[::-1])[::-1]
    known = np.flatnonzero(~np.isnan(limit))
    limit = np.where(np.isnan(limit), limit[known[-1]] if len(known) else 1.0, limit)
    if len(known):
        limit[:known[0]] = 1.0
    return Model(languages, idf, centers, owner, limit, how)


def _bucket(total: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(total, 1)).astype(int), 0, _BUCKETS - 1)


def _spherical_means(x: np.ndarray, how: Fit) -> np.ndarray:
    """Centroids of normalised rows: farthest-first start, cosine k-means, small clusters dropped."""
    mean = x.mean(0)
    c = [x[int((x @ mean).argmax())]]
    while len(c) < min(how.centroids, len(x)):
        c.append(x[int((x @ np.stack(c).T).max(1).argmin())])
    c = np.stack(c)
    for _ in range(how.rounds):
        at = (x @ c.T).argmax(1)
        new = np.stack([x[at == k].sum(0) if (at == k).any() else c[k] for k in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    keep = size >= min(max(how.min_share * len(x), 1), size.max())
    return c[keep]


def _judge(model: Model | None, text: pa.Array, has: np.ndarray):
    """(first row, end row, language, score, distance, rejected) by slice of lower-case texts."""
    for lo, hi, buf, off in C.text_slices(text):
        m, letters = hi - lo, has[lo:hi]
        if model is None:
            yield lo, hi, np.full(m, "und", object), np.zeros(m), np.ones(m), np.ones(m, bool)
            continue
        x, total = counts(buf, off, model.fit.dims)
        cos = vectors(x, model.idf) @ model.centers.T
        best = np.stack([cos[:, model.owner == i].max(1) for i in range(len(model.languages))], 1)
        p = np.exp(model.fit.sharpness * (best - best.max(1, keepdims=True)))
        far = 1 - best.max(1).astype(float)
        name = np.where(letters, np.array(model.languages, object)[best.argmax(1)], "und")
        yield lo, hi, name, np.where(letters, 1 / p.sum(1), 0.0).astype(float), far, ~letters | (far > model.limit[_bucket(total)])


def _has_letter(col: pa.Array) -> np.ndarray:
    return np.array(col.fill_null(False).to_numpy(zero_copy_only=False), bool)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): SCHEMA."""

    def run(batches):
        for b in batches:
            for lo, hi, name, score, far, out in _judge(model, b.column(1), _has_letter(b.column(2))):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo), pa.array(name.tolist(), pa.string()),
                     pa.array(score), pa.array(far), pa.array(out)], ["doc_id", "held_out", "lang_pred", "score", "distance", "rejected"])

    return _text(docs, C.held_out().alias("held_out")).mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with ``lang`` set to the language found; all columns as they were."""
    names = docs.columns
    schema = docs.schema
    at = names.index("lang")

    def run(batches):
        for b in batches:
            for lo, hi, name, _, _, out in _judge(model, b.column(len(names)), _has_letter(b.column(len(names) + 1))):
                cols = [c.slice(lo, hi - lo) for c in b.columns[:len(names)]]
                cols[at] = pa.array(name.tolist(), pa.string())
                yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(~out))

    return docs.select("*", F.lower(F.col("text").cast("string")).alias("__lower"), F.col("text").rlike(r"\p{L}").alias("__letter")).mapInArrow(run, schema)
