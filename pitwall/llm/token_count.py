"""Token counts (operator 2): greedy longest-match pieces by a linear automaton.

A trie over the vocabulary has failure links: where no child fits, the automaton pops the pieces
that are certain by then and goes on at the linked node. How many pieces each link pops is
computed with the trie, so a text is counted in one step a byte and no piece is ever built. The
links are folded into one table (node, byte) -> (next node, pieces popped).

A word is a maximal run without white space and is matched as bytes behind one space. The
vocabulary is a file of base64 byte strings with ranks, whose path is a parameter; every single
byte must be in it, so each word has a segmentation. Null text counts as empty (0 tokens). Rows
stand alone: repeated ids, ties and extra columns change nothing.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitwall.llm import common as C

SCHEMA = "doc_id long, n_bytes long, n_words long, n_tokens long, longest_word long"
_SHIFT = 24


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class PieceAutomaton:
    """``step[node * 256 + byte]`` = next node + popped pieces << 24; ``last[node]`` = pieces still to pop at a word's end."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                nxt = children[at].get(byte)
                if nxt is None:
                    nxt = children[at][byte] = len(children)
                    children.append({})
                    final.append(False)
                at = nxt
            final[at] = bool(piece)
        if len(children) >= 1 << _SHIFT:
            raise ValueError("the vocabulary has too many prefixes for the packed table")
        if not all(b in children[0] and final[children[0][b]] for b in range(256)):
            raise ValueError("every single byte must be in the vocabulary")
        n = len(children)
        step = np.zeros((n, 256), np.int32)
        fail, pops, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        is_final = np.array(final)
        for byte, child in children[0].items():
            step[0, byte] = child
        level = [0]
        while level:
            parent = np.array([v for v in level for _ in children[v]], np.int64)
            byte = np.array([b for v in level for b in children[v]], np.int64)
            child = np.array([c for v in level for c in children[v].values()], np.int64)
            if not len(child):
                break
            # a piece ends here: pop it and restart; else what the parent's link pops, then the link's own step
            moved = step[fail[parent], byte].astype(np.int64)
            whole = is_final[child]
            fail[child] = np.where(whole, 0, moved & ((1 << _SHIFT) - 1))
            pops[child] = np.where(whole, 1, pops[parent] + (moved >> _SHIFT))
            last[child] = pops[child] + last[fail[child]]
            if pops[child].max() > 63:
                raise ValueError("a link pops too many pieces for the packed table")
            step[child] = step[fail[child]] + (pops[child] << _SHIFT).astype(np.int32)[:, None]
            for v in child.tolist():
                for b, c in children[v].items():
                    step[v, b] = c
            level = child.tolist()
        self.step, self.last = step.ravel(), last
        self.first = int(step[0, 32])

    def count(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each span [start, end) behind one space: all spans advance a byte at a time together."""
        length = end - start
        order = np.argsort(-length, kind="stable")
        left = np.sort(length)
        at = start[order]
        state = np.full(len(start), self.first, np.int64)
        total = np.zeros(len(start), np.int64)
        for t in range(int(left[-1]) if len(left) else 0):
            k = len(left) - int(np.searchsorted(left, t, "right"))
            moved = self.step[state[:k] * 256 + buf[at[:k] + t]]
            state[:k] = moved & ((1 << _SHIFT) - 1)
            total[:k] += moved >> _SHIFT
        out = np.empty(len(start), np.int64)
        out[order] = total + self.last[state]
        return out


_built: dict[str, PieceAutomaton] = {}


def automaton(path: str) -> PieceAutomaton:
    """Once per worker process."""
    if path not in _built:
        _built[path] = PieceAutomaton(read_vocabulary(path))
    return _built[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Greedy piece counts of each row of ``docs`` (doc_id, text): SCHEMA."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in C.text_slices(b.column(1)):
                m = hi - lo
                start, end, row = C.words(buf, off)
                tokens = np.bincount(row, automaton(vocabulary).count(buf, start, end), minlength=m).astype(np.int64)
                longest = np.zeros(m, np.int64)
                np.maximum.at(longest, row, end - start)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, m), pa.array(np.diff(off)), pa.array(np.bincount(row, minlength=m).astype(np.int64)),
                     pa.array(tokens), pa.array(longest)], ["doc_id", "n_bytes", "n_words", "n_tokens", "longest_word"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
