"""Toxicity (operator 8): a lexicon trie searched by Levenshtein automata, scored in context.

Learning, from a sample of about ``max_train`` labelled rows that are not held out (all of them where there are
fewer): a word, or a stem of 4 to 6 letters, joins the lexicon when the lower confidence bound of its toxic
share (counts over the different texts of those rows) exceeds ``min_share``; a stem stands for every
word that begins with it. That bound is the term's certainty, and a hit's weight.
Scoring: a word hits when the automaton of the word, intersected with the trie of the lexicon, accepts a term within one
edit: a letter put in, left out or replaced (by a digit or sign, too: ``id1ot``, ``i*diot``), or two neighbours
swapped. Terms of three letters must match exactly, those of four and five keep their first letter.
A word that is itself ordinary, that is, in ``min_clean`` clean texts of the sample, is no misspelling. A hit's context
window tells quotation (quote marks around it, or a reporting verb before it) from use. A logistic
model over the certainty of hits by (exact or misspelled) x (used or quoted) gives the score; where the
sample says nothing about a kind of hit, its weight stays near ``PRIOR``.

Null and empty texts have no hits and get the score of a text without hits. Null labels are not
learned. The lexicon counts equal texts once for each kind of label; the model's weights count
every row. Repeated ids are scored each. Without labels of both kinds the score is the toxic share (0 without labels).
Extra columns are ignored, whatever their names. A text of any length is one string to a task.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm import common as C

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_hits int, n_misspelled int, n_quoted int"
#: Features: certainty of hits exact and used, misspelled and used, exact and quoted, misspelled and quoted; hits per 100 words; 1.
FEATURES = 6
PRIOR = (3.0, 2.0, 1.0, 0.7, 0.3)
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_]+(?:[\d@$*!]+[^\W\d_]+)+")
_ODD_THERE = re.compile(r"[^\W\d_][\d@$*!]+[^\W\d_]")
_QUOTES = "\"'“”„«»‘’‹›"
#: Words that report what somebody else said (fixed list).
REPORTING = {"said", "says", "say", "called", "calls", "wrote", "writes", "quoted", "quote", "told", "word", "term", "dijo", "dice", "dit", "sagte", "sagt"}


@dataclass(frozen=True)
class Fit:
    min_docs: int = 6
    min_share: float = 0.5
    min_clean: int = 2
    z: float = 2.3
    max_train: int = 100_000
    window: int = 3
    threshold: float = 0.3


def units(text: str) -> set[str]:
    """Distinct words of three letters or more, and their stems of 4 to 6 letters (with a star)."""
    found = {w for w in set(_WORD.findall(text.lower())) if len(w) > 2}
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}


def _counted(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    names = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_pydict({"unit": pa.array(names, pa.string()), "toxic": pa.array([toxic[u] for u in names], pa.int64()), "clean": pa.array([clean[u] for u in names], pa.int64())})


class Lexicon:
    """Trie of terms, searched by the Levenshtein automaton of a word (one edit).

    The automaton's states are (letters of the word read, edits made). Without an edit it follows
    the word down the trie; at each node on that path it may substitute, insert, delete or swap, after which
    it accepts only the rest as it stands."""

    def __init__(self, terms):
        self.terms = sorted(set(terms))
        self.exact = set(self.terms)
        self.root: dict = {}
        self.halves: dict[int, tuple[set[str], set[str]]] = {}
        for t in self.terms:
            if self.edits(t):
                at = self.root
                for ch in t:
                    at = at.setdefault(ch, {})
                at[""] = t
                # one edit leaves the first or the second half of a term as it is, unless it swaps the letters where they meet
                heads, tails = self.halves.setdefault(len(t), (set(), set()))
                k = len(t) // 2
                heads |= {t[:k], t[:k - 1] + t[k]}
                tails.add(t[k:])

    @staticmethod
    def edits(term: str) -> int:
        return 1 if len(term) >= 4 else 0

    @staticmethod
    def accepts(word: str, term: str) -> bool:
        return len(term) >= 6 or word[:1] == term[0]

    def may_match(self, word: str) -> bool:
        m = len(word)
        for n in (m - 1, m, m + 1):
            if n in self.halves:
                heads, tails = self.halves[n]
                if word[:n // 2] in heads or word[m - n + n // 2:] in tails:
                    return True
        return False

    @staticmethod
    def _rest(node: dict, word: str, i: int) -> str | None:
        for ch in word[i:]:
            node = node.get(ch)
            if node is None:
                return None
        return node.get("")

    def _edited(self, node: dict, word: str, i: int):
        """Terms accepted with the one edit at letter ``i``, below ``node``."""
        n = len(word)
        if i < n:
            yield self._rest(node, word, i + 1)                       # the word's letter is one too many
        if i + 1 < n and word[i] != word[i + 1] and word[i + 1] in node:
            swapped = node[word[i + 1]].get(word[i])
            if swapped is not None:
                yield self._rest(swapped, word, i + 2)
        for ch, child in node.items():
            if ch:
                yield self._rest(child, word, i)                      # the term's letter is missing here
                if i < n and ch != word[i]:
                    yield self._rest(child, word, i + 1)

    def search(self, word: str) -> tuple[str, int] | None:
        """(term, distance) of the nearest accepted term, the first in order among equals."""
        if word in self.exact:
            return word, 0
        found: str | None = None
        node = self.root
        for i in range(len(word) + 1):
            for got in self._edited(node, word, i):
                if got is not None and (found is None or got < found) and self.accepts(word, got):
                    found = got
            if i == len(word) or word[i] not in node:
                break
            node = node[word[i]]
        return (found, 1) if found is not None else None


@dataclass
class Model:
    #: Certainty of every term, above 0 up to 1.
    certainty: dict[str, float]
    weights: np.ndarray
    fit: Fit
    #: Ordinary words within one edit of a term.
    ordinary: set[str] = field(default_factory=set)

    @property
    def terms(self) -> list[str]:
        return list(self.certainty)


class Matcher:
    """Hits of words, each distinct word searched once and remembered (bounded)."""

    def __init__(self, certainty: dict[str, float], ordinary: set[str] = frozenset(), keep: int = 2_000_000):
        self.certainty, self.ordinary, self.keep = certainty, ordinary, keep
        self.stems = {t[:-1] for t in certainty if t.endswith("*")}
        self.lexicon = Lexicon([t for t in certainty if not t.endswith("*")])
        self.hit: dict[str, tuple[str, int]] = {}
        self.none: set[str] = set()

    def look(self, found: set[str]) -> None:
        if len(self.none) + len(self.hit) > self.keep:
            self.none.clear()
            self.hit.clear()
        for w in found - self.none - self.hit.keys():
            got = (w, 0) if w in self.lexicon.exact else None
            if not got:
                stem = next((w[:k] for k in STEMS if w[:k] in self.stems and len(w) > k), "")
                got = (stem + "*", 0) if stem else None
            if not got and w not in self.ordinary and self.lexicon.may_match(w):
                got = self.lexicon.search(w)
            if got:
                self.hit[w] = got
            else:
                self.none.add(w)

    def features(self, texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of FEATURES, and how many distinct terms there are by exact/misspelled x used/quoted."""
        texts = [t.lower() for t in texts]
        listed = [_WORD.findall(t) for t in texts]
        odd = [_ODD.findall(t) if _ODD_THERE.search(t) else [] for t in texts]
        every = set().union(*listed, *odd) if listed else set()
        self.look(every)
        here = {w for w in every if w in self.hit}
        out, count = np.zeros((len(texts), FEATURES)), np.zeros((len(texts), 4), np.int32)
        out[:, -1] = 1
        for row, (text, ws, strange) in enumerate(zip(texts, listed, odd)):
            hits = here.intersection(ws)
            if strange:
                hits |= here.intersection(strange)
            if not hits:
                continue
            groups: list[set[str]] = [set(), set(), set(), set()]
            n = 0
            spans = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
            if here.intersection(strange):
                odd_spans = [(m.start(), m.end(), m[0]) for m in _ODD.finditer(text) if m[0] in hits]
                cover = [(a, z) for a, z, _ in odd_spans]
                spans = sorted([x for x in spans if not any(a <= x[0] < z for a, z in cover)] + odd_spans)
            for i, (a, z, w) in enumerate(spans):
                if w in hits:
                    n += 1
                    term, d = self.hit[w]
                    before = text[spans[max(0, i - window)][0]:a]
                    after = text[z:spans[min(len(spans) - 1, i + window)][1]]
                    quoted = (any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)) or \
                        any(x[2] in REPORTING for x in spans[max(0, i - window):i])
                    groups[2 * quoted + (d > 0)].add(term)
            out[row, :4] = np.log1p([sum(self.certainty[t] for t in g) for g in groups])
            count[row] = [len(g) for g in groups]
            out[row, 4] = 100.0 * n / (len(ws) + 20)
        return out, count


def sample(labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the learnable ``labels`` (doc_id, toxic), all if there are fewer; chosen by a hash of the id."""
    marked = labels.filter(~C.held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    n = marked.count()
    return marked.filter(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_003)) < 1_000_003 * min(1.0, most / max(n, 1)))


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    texts = docs.filter(~C.held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample has about ``max_train`` rows of 12 bytes whatever the input, so the texts stay where they are
    train = C.stored(texts.join(F.broadcast(sample(labels, how.max_train)), "doc_id").withColumns({"h": F.xxhash64("text"), "size": F.length("text")}), "toxicity-train")

    def count(batches):
        """Toxic and clean texts that hold each unit."""
        toxic, clean = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if y == 1 else clean).update(units(t or ""))
                if len(toxic) + len(clean) > 1_000_000:
                    yield _counted(toxic, clean)
                    toxic, clean = Counter(), Counter()
        yield _counted(toxic, clean)

    # many copies of one text are one witness; of the bounded sample one id a text is sent back
    witness = train.groupBy("toxic", "h", "size").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    different = train.join(F.broadcast(witness), ["doc_id", "toxic"], "left_semi").dropDuplicates(["doc_id", "toxic"]).select("text", "toxic")
    counts = C.stored(different.mapInArrow(count, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-units")
    z2, n = how.z * how.z, F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    lower = (share + z2 / (2 * n) - how.z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    # every candidate is judged in Spark; only terms are collected, of which a sample of texts holds few
    chosen = counts.filter(F.col("toxic") >= how.min_docs).withColumn("lower", lower).filter(F.col("lower") > how.min_share).orderBy("unit").select("unit", "lower").collect()
    certainty = {r.unit: (r.lower - how.min_share) / (1 - how.min_share) for r in chosen}
    both = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(both.values())
    base = np.zeros(FEATURES)
    rate = min(max(both.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 1e-6
    base[-1] = np.log(rate / (1 - rate))
    if not certainty or len(both) < 2:
        return Model(certainty, base, how)

    def near(batches):
        """Words that a term's automaton accepts."""
        lexicon = Lexicon([t for t in certainty if not t.endswith("*")])
        for b in batches:
            got = [w for w in b.column(0).to_pylist() if w not in lexicon.exact and lexicon.may_match(w) and lexicon.search(w)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], ["unit"])

    plain = counts.filter(~F.col("unit").endswith("*") & (F.col("clean") >= how.min_clean)).select("unit")
    ordinary = {r.unit for r in plain.mapInArrow(near, "unit string").collect()}

    def rows(batches):
        matcher = Matcher(certainty, ordinary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                x, _ = matcher.features([t or "" for t in b.column(0).slice(lo, 256).to_pylist()], how.window)
                yield pa.RecordBatch.from_pydict({"y": b.column(1).slice(lo, 256), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})

    # equal rows of features are one row with a weight
    got = train.select("text", "toxic").mapInArrow(rows, "y int, x array<double>").groupBy("y", "x").agg(F.count("*").alias("n")).collect()
    if len({r.y for r in got}) < 2:
        return Model(certainty, base, how, ordinary)
    return Model(certainty, _logistic(np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.n for r in got], float)), how, ordinary)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 2.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression of rows that count ``n`` times by Newton steps, weights drawn to PRIOR; a kind of hit never speaks against toxicity (its weight would become 0)."""
    use = np.arange(x.shape[1])
    prior = np.append(PRIOR, 0.0)
    while True:
        w = _newton(x[:, use], y, n, prior[use], ridge, rounds)
        bad = w[:-1] < 0
        if not bad.any():
            out = np.zeros(x.shape[1])
            out[use] = w
            return out
        use = np.append(use[:-1][~bad], use[-1])


def _newton(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w = prior.copy()
    w[-1] = -2.0
    pen = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + pen, x.T @ (n * (y - p)) - pen @ (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): SCHEMA."""
    certainty, ordinary, weights, how = model.certainty, model.ordinary, model.weights, model.fit

    def run(batches):
        matcher = Matcher(certainty, ordinary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                x, n = matcher.features([t or "" for t in b.column(1).slice(lo, 256).to_pylist()], how.window)
                s = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, 256), b.column(2).slice(lo, 256), pa.array(s), pa.array((s >= how.threshold).astype(np.int32)),
                     pa.array(n.sum(1, dtype=np.int32)), pa.array(n[:, 1] + n[:, 3]), pa.array(n[:, 2] + n[:, 3])],
                    ["doc_id", "held_out", "score", "predicted", "n_hits", "n_misspelled", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       C.held_out().alias("held_out")).mapInArrow(run, SCHEMA)
