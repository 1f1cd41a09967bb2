"""Mixing to target weights (operator 5): soft membership and projected-gradient least squares.

Domains are the classes of a labelled table. Hashed words are counted by domain, over all labelled
rows but a fifth (texts that hold a word, and places). A text's log likelihoods come from all its
words, over the root of their number since words of one text are not independent, and from the
telling words alone, whose texts in a domain differ from their expected number by four standard
deviations or more. A softmax regression over these, the number of words and that of different
words, fitted on about ``max_fit`` rows of the fifth left out, makes them a posterior over domains. Nonnegative rates per document are then fitted: the expected domain token totals, sum of rate x tokens x posterior,
shall equal target weight x total. The least squares (relative to each domain's present size, with
a small pull to rate 1) is solved by accelerated projected gradients. A document's rate
depends on its posterior and on the few numbers per domain that each step broadcasts, so a step is
one scan that adds up one total per domain; rates are never gathered.

By default the total is the one at which the domain with the largest target (the anchor) keeps its
tokens: others shrink to their share of it, scarce ones are repeated, and documents that are most
likely of the anchor have a rate of 1 or more. ``resample`` turns rates
into whole copies: floor(rate + a hash of the id in [0, 1)).

Null or empty texts have no tokens and get the labels' shares as posterior; null labels are not
learned; repeated ids are documents of their own, extra columns stay. Domains without a target
weigh 0; targets of domains that no label has are left out (the rest is scaled up). Without labels
or tokens all rates are 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.llm import common as C

_BUCKETS = 1 << 16
_DEVIATIONS = 4.0


@dataclass(frozen=True)
class Fit:
    targets: dict[str, float] = field(default_factory=lambda: {"q1t0": 0.90, "q0t0": 0.06, "q1t1": 0.04})
    tokens: float | None = None
    pull: float = 1e-3
    steps: int = 60
    tolerance: float = 1e-4
    max_fit: int = 20_000


@dataclass
class Classifier:
    domains: list[str]
    prior: np.ndarray
    logs: np.ndarray
    told: np.ndarray
    weights: np.ndarray

    def features(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, features) of each text; the last three: log of words and of different words, 1."""
        m = len(off) - 1
        bucket, row = word_buckets(buf, off)
        n = np.bincount(row, minlength=m)
        every = np.stack([np.bincount(row, logs[bucket], minlength=m) for logs in self.logs], 1) / np.sqrt(np.maximum(n, 1))[:, None]
        bucket, row = held(bucket, row)
        told = np.stack([np.bincount(row, logs[bucket], minlength=m) for logs in self.told], 1)
        sizes = np.stack([np.log1p(n), np.log1p(np.bincount(row, minlength=m)), np.ones(m)], 1)
        return n, np.concatenate([np.arcsinh(told), every, sizes], 1)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        out = softmax(x @ self.weights)
        out[x[:, -3] == 0] = np.exp(self.prior)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def regression(x: np.ndarray, who: np.ndarray, prior: np.ndarray, ridge: float = 1e-4, steps: int = 1500) -> np.ndarray:
    """Weights of a softmax regression by accelerated gradients, from the prior on."""
    w = np.zeros((x.shape[1], len(prior)))
    w[-1] = prior
    if not len(x):
        return w
    width = np.maximum(x.std(0), 1e-9)
    width[-1] = 1
    mid = np.append(x[:, :-1].mean(0), 0)
    z = (x - mid) / width
    y = np.eye(len(prior))[who]
    step = 1 / (0.5 * np.linalg.eigvalsh(z.T @ z / len(z))[-1] + ridge)
    free = np.append(np.ones(x.shape[1] - 1), 0)[:, None]
    ahead, t = w, 1.0
    for _ in range(steps):
        new = ahead - step * (z.T @ (softmax(z @ ahead) - y) / len(z) + ridge * free * ahead)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / u * (new - w), new, u
    w = w / width[:, None]
    w[-1] -= mid @ w
    return w


def word_buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = C.words(buf, off)
    return (C.span_hashes(buf, start, end, lower=True) % np.uint64(_BUCKETS)).astype(np.int64), row


def held(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (bucket, row) once."""
    both = np.unique(row * _BUCKETS + bucket)
    return both % _BUCKETS, both // _BUCKETS


def telling(seen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each word, by domain, to that over all domains; 0 where chance could make it."""
    share = (size / max(size.sum(), 1))[:, None]
    held_by = seen.sum(0)
    expected = held_by * share
    far = np.abs(seen - expected) >= _DEVIATIONS * np.sqrt(expected * (1 - share) + 1)
    ratio = np.log((seen + 0.5) / (size + 1)[:, None]) - np.log((held_by + 0.5) / (size.sum() + 1))
    return np.where(far, ratio, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, domain) -> DataFrame:
    """(domain, text, part) of every labelled document; part is a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).filter("doc_id is not null and domain is not null")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marked.hint("merge"), "doc_id").select("domain", "text", F.xxhash64(F.lit("mixing fit"), "doc_id").alias("part"))


def quality_toxic():
    """Domain of the labels table: q<quality>t<toxic>."""
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


def classify(train: DataFrame, how: Fit = Fit()) -> Classifier | None:
    """The classifier of (domain, text, part) rows."""
    train = C.stored(train, "labelled")
    names = sorted(r.domain for r in train.select("domain").distinct().collect())  # domains, not documents
    if not names:
        return None
    number, k = {d: i for i, d in enumerate(names)}, len(names)
    fifth = F.pmod("part", F.lit(5)) == 0

    def who(b, lo, hi):
        return np.array([number[d] for d in b.column(0).slice(lo, hi - lo).to_pylist()])

    def count(batches):
        out, n = np.zeros((2, k, _BUCKETS), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                kind = who(b, lo, hi)
                bucket, row = word_buckets(buf, off)
                for j, (w, r) in enumerate(((bucket, row), held(bucket, row))):
                    out[j] += np.bincount(kind[r] * _BUCKETS + w, minlength=out[j].size).reshape(out[j].shape)
                n += np.bincount(kind, minlength=k)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"i": np.concatenate([at, out.size + np.arange(k)]), "n": np.concatenate([out.ravel()[at], n])})

    counts = np.zeros(2 * k * _BUCKETS + k)
    for r in train.filter(~fifth).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a bounded table of counts
        counts[r.i] = r.n
    (places, texts), size = counts[:-k].reshape(2, k, -1), counts[-k:]
    logs = np.log((places + 0.5) / (places.sum(1, keepdims=True) + 0.5 * _BUCKETS))
    prior = np.log((size + 1) / (size + 1).sum())
    model = Classifier(names, prior, logs - logs.mean(0), telling(texts, size), np.zeros((2 * k + 3, k)))

    def describe(batches):
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                n, x = model.features(buf, off)
                yield pa.RecordBatch.from_pydict({"who": who(b, lo, hi)[n > 0], "x": list(x[n > 0])})

    left = train.filter(fifth)
    parts = max(1, -(-left.count() // how.max_fit))
    rows = left.filter(F.pmod(F.floor(F.col("part") / 5), F.lit(parts)) == 0).mapInArrow(describe, "who long, x array<double>").orderBy("who", "x").collect()  # about max_fit rows
    model.weights = regression(np.array([r.x for r in rows]).reshape(-1, 2 * k + 3), np.array([r.who for r in rows], np.int64), prior)
    return model


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words) and posterior of each row."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                n, x = model.features(buf, off)
                post = model.posterior(x)
                k = post.shape[1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                                                  pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * k, k, dtype=np.int32), post.ravel())], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


@dataclass
class Rates:
    """The steps' broadcast numbers: a document's rate follows from its posterior alone."""

    pull: float
    forces: list[np.ndarray] = field(default_factory=list)
    anchor: int | None = None

    def trace(self, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rate, point of the next gradient) after all steps so far."""
        rate = ahead = np.ones(len(post))
        least = 0.0 if self.anchor is None else (post[:, self.anchor] >= post.max(1, initial=0)).astype(float)
        t = 1.0
        for force in self.forces:
            new = np.maximum(least, ahead - (post @ force + self.pull * (ahead - 1)) / (1 + self.pull))
            u = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, rate, t = new + (t - 1) / u * (new - rate), new, u
        return rate, ahead


def fit_rates(members: DataFrame, domains: list[str], how: Fit = Fit()) -> Rates:
    """Rates for a stored table of ``memberships``."""
    k = len(domains)

    def totals(rates: Rates) -> np.ndarray:
        def run(batches):
            out = np.zeros(2 * k)
            for b in batches:
                post = b.column(1).flatten().to_numpy().reshape(-1, k)
                rate, ahead = rates.trace(post)
                tok = b.column(0).to_numpy()
                out += np.concatenate([(tok * rate) @ post, (tok * np.maximum(ahead, 0)) @ post])
            yield pa.RecordBatch.from_pydict({"i": np.arange(2 * k), "x": out})

        got = {r.i: r.x for r in members.select("n_tokens", "posterior").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        return np.array([got.get(i, 0.0) for i in range(2 * k)]).reshape(2, k)

    rates = Rates(how.pull)
    have = totals(rates)[0]
    want = np.array([max(0.0, how.targets.get(d, 0.0)) for d in domains])
    if not want.sum() or not have.sum():
        return rates
    want = want / want.sum()
    if how.tokens is None:
        rates.anchor = int(want.argmax())
    total = have[want.argmax()] / want.max() if how.tokens is None else how.tokens
    goal, scale = want * total, np.maximum(have, 1e-9 * have.sum())
    at = have
    for _ in range(how.steps):
        rates.forces.append((at - goal) / scale)
        got, at = totals(rates)
        if np.abs(got - goal).max() <= how.tolerance * total:
            break
    return rates


def _copies(rate, ids, tag: str):
    unit = F.pmod(F.xxhash64(F.lit(tag), ids), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + unit).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, posterior (by domain, in order), rate, copies."""
    model = classify(labelled(docs, labels, quality_toxic()), how)
    if model is None:
        model = Classifier(["none"], np.zeros(1), np.zeros((1, _BUCKETS)), np.zeros((1, _BUCKETS)), np.zeros((5, 1)))
    members = C.stored(memberships(docs, model), "memberships")
    rates, k = fit_rates(members, model.domains, how), len(model.domains)

    def run(batches):
        for b in batches:
            rate = rates.trace(b.column(2).flatten().to_numpy().reshape(-1, k))[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate)], ["doc_id", "n_tokens", "posterior", "rate"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double").withColumn("copies", _copies(F.col("rate"), F.col("doc_id"), "mixing"))


def resample(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """``docs`` with every row as often as its copies say, all columns as they were."""
    model = classify(labelled(docs, labels, quality_toxic()), how)
    if model is None:
        return docs
    rates = fit_rates(C.stored(memberships(docs, model), "memberships"), model.domains, how)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(at)):
                rate = rates.trace(model.posterior(model.features(buf, off)[1]))[0]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), pa.array(rate)], [*names, "__rate"])

    rated = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__rate", T.DoubleType())]))
    n = _copies(F.col("__rate"), F.col("doc_id"), "mixing")
    return rated.withColumn("__n", n).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*names)
