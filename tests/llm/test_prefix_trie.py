"""Operator 12 against brute force and edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from pitwall.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract, said over: every node by its sequence of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(int)
    for t in members:
        if t:
            kids[t[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for t, m in members.items():
        for d in range(len(t) + 1):
            leaves[t[:d]] += not kids[t]
            saved[t[:d]] += (len(m) - 1) * len(t[-1][1]) if t else 0
    sha = lambda t: hashlib.sha256(",".join(str(c) for c in sorted(members[t]) if len(full[c]) == len(t)).encode()).hexdigest()
    return sorted((min(m), len(t), min(members[t[:-1]]) if t else None, len(m), kids[t], leaves[t], saved[t], sha(t)) for t, m in members.items())


def check(spark, rows, p=prefix_trie.Params(), parts=3):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts), p).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def made(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 400), convs):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", rng.choice(["hi", "yes", "no", "é", ""])))
    rng.shuffle(rows)
    return rows


def test_random_conversations(spark):
    check(spark, made(1))


def test_nulls_ties_repeats_long(spark):
    rows = [(0, None, None, None), (0, None, "u", "b"), (0, 1, "u", "a"), (0, 1, "u", "a"), (0, 1, "a", "z"), (None, 1, "u", "lost"), (7, 3, "u", "x" * 300_000), (-103, 1, "u", "neg"),
            (-103, 2, "u", "neg2"), (105, 0, "u", "no root"), (205, 0, "u", "c"), (205, 1, "u", "d"), (200, 0, "u", "only turn"), (9_000_000_000_000_000_123, 0, "u", "far")]
    check(spark, rows + [(300, 0, "u", "one"), (301, 5, "u", "p"), (302, 5, "u", "p"), (303, 5, "u", "p")])


def test_one_conversation_with_most_rows(spark):
    """A conversation far longer than a chunk, and a node under which nearly everything ends."""
    rows = [(600, i, "u", f"{i % 3}") for i in range(150)] + [(601, i, "u", f"{i % 3}") for i in range(60)]
    rows += [(c, t, "u", "same") for c in range(700, 790) for t in range(2)]
    check(spark, rows, prefix_trie.Params(chunk=8, hot=3, ids_at_once=4), parts=5)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, 0, "u", "t", 5, 6)], SCHEMA + ", conv long, found long")
    assert prefix_trie.prefix_trie(docs).count() == len(plain([(1, 0, "u", "t")]))


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_contraction(spark, shape):
    rng = random.Random(5)
    n = 90
    up = {i: {"path": i - 1, "star": 0, "random": rng.randint(max(0, i - 4), i - 1) if i else 0}[shape] for i in range(1, n)}
    value = [rng.randint(-5, 50) for _ in range(n)]
    want = list(value)
    for i in range(n - 1, 0, -1):
        want[up[i]] += want[i]
    rows = [(i, 1, up.get(i), 1 if i else None, value[i]) for i in range(n)]
    got = prefix_trie.subtree_totals(spark.createDataFrame(rows, "a long, b long, pa long, pb long, v long"), ["v"]).collect()
    assert sorted((r.a, int(r.v)) for r in got) == list(enumerate(want))
