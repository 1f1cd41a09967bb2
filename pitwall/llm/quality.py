"""Repetition coverage (operator 9): rolling n-gram hashes measure text that repeats itself.

A word is a maximal run without white space. Base counts come with each text; the method's
verdict bounds the share of word characters inside later copies of n-grams, for several n, and
inside lines that repeat an earlier line. The bounds are those published for web text.

Null text counts as empty: no words, ``base_failed``. Rows stand alone, so repeated ids, ties and
extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitwall.llm import common as C

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share array<double>")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat are the base; the rest bounds coverage, by n-gram length in words."""

    min_words: int = 50
    max_repeat: float = 0.5
    line_share: float = 0.20
    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.15, 7: 0.13, 10: 0.10})


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return C.mix(h + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _copies(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, equal to an earlier one) of each key."""
    n = len(key)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice |= later
    return twice, later


def _covered(marked: np.ndarray, k: int, n: int) -> np.ndarray:
    """Words inside a marked window of k words."""
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marked)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:n]) > 0


def measure(buf: np.ndarray, off: np.ndarray, lengths=(5, 7, 10)) -> dict[str, np.ndarray]:
    """Counts and coverage of each text of a flat buffer."""
    m = len(off) - 1
    start, end, row = C.words(buf, off)
    head = C.code_points(buf)
    chars_to = np.concatenate([[0], np.cumsum(head)])
    chars = chars_to[end] - chars_to[start]
    per = lambda r, w=None: np.bincount(r, w, minlength=m)[:m]
    symbol_to = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    out = {"n_words": per(row), "word_chars": per(row, chars).astype(np.int64), "n_symbols": symbol_to[off[1:]] - symbol_to[off[:-1]]}

    h = C.span_hashes(buf, start, end)
    # lines: every text begins one; each \n ends one
    breaks = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([off[:-1], breaks + 1]))
    line_start = line_start[line_start < len(buf)]
    of_word = np.searchsorted(line_start, start, "right") - 1
    full = np.unique(of_word)
    stop = np.append(line_start[1:], len(buf))[full] if len(full) else full
    begin = line_start[full] if len(full) else full
    line_row = np.searchsorted(off, begin, "right") - 1
    if len(full):
        stop = np.where(buf[stop - 1] == 10, stop - 1, stop)
    line_h = C.span_hashes(buf, begin, stop)
    _, later = _copies(_keyed(line_h, line_row))
    out["n_dup_lines"] = per(line_row[later])
    line_chars = np.bincount(of_word, chars, minlength=len(line_start))[full] if len(full) else np.zeros(0)
    whole = np.maximum(out["word_chars"], 1)
    out["dup_line_share"] = per(line_row[later], line_chars[later]) / whole

    def windows(k):
        if len(h) < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        ok = row[k - 1:] == row[:len(row) - k + 1]
        key = _keyed(C.word_windows(h, k), row[:len(row) - k + 1])
        # windows that cross texts get a key of their own
        cross = np.flatnonzero(~ok)
        key[cross] = C.mix(cross.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        return key, ok

    key, ok = windows(3)
    twice, _ = _copies(key)
    out["n_repeat_words"] = per(row, _covered(twice & ok, 3, len(h))).astype(np.int64)
    shares = []
    for k in lengths:
        key, ok = windows(k)
        _, later = _copies(key)
        shares.append(per(row, _covered(later & ok, k, len(h)) * chars) / whole)
    out["dup_ngram_share"] = np.stack(shares, 1) if shares else np.zeros((m, 0))
    return out


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): SCHEMA."""
    lengths, bounds = tuple(rules.ngram_share), np.array(list(rules.ngram_share.values()))

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                x = measure(buf, off, lengths)
                failed = (x["n_words"] < rules.min_words) | (x["n_repeat_words"] > rules.max_repeat * x["n_words"])
                kept = ~failed & (x["dup_line_share"] <= rules.line_share) & (x["dup_ngram_share"] <= bounds).all(1)
                long = lambda k: pa.array(x[k].astype(np.int64))  # noqa: B023, E731
                share = pa.ListArray.from_arrays(np.arange(0, (hi - lo) * len(bounds) + 1, max(1, len(bounds)), dtype=np.int32)
                                                 if len(bounds) else np.zeros(hi - lo + 1, np.int32), x["dup_ngram_share"].ravel())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), long("n_words"), long("word_chars"), long("n_symbols"),
                     long("n_dup_lines"), long("n_repeat_words"), pa.array(failed), pa.array(kept),
                     pa.array(x["dup_line_share"]), share],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     "kept", "dup_line_share", "dup_ngram_share"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
