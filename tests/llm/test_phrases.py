"""Operator 13 against brute force and edge cases."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitwall.llm import phrases

LOWER = {i: i + 32 for i in range(65, 91)}


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    return f, n


def plain(rows, least, top):
    f, n = counted(rows)
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    gone = set()
    for (lang, w), a in cand.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and a >= cand[lang, w[i:j]]:
                    gone.add((lang, w[i:j]))
    by = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, le, ri = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), le, ri))
    return sorted((lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for lang, v in by.items() for i, (s, a, p, le, ri) in enumerate(sorted(v)[:top]))


def check(spark, rows, p, parts=3):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    want = plain(rows, p.min_count, p.top)
    assert sorted(tuple(r) for r in phrases.top_collocations(docs, p).collect()) == want
    return want


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "Cat", "dog", "(x", "the", "of"] + [f"w{rng.randint(0, 300)}"])
    out = []
    for _ in range(n):
        t = [rng.choice(["the big red dog", "a a a a a a a", "of the house", "x"]) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 40))]
        out.append((rng.choice([" ", "  ", "\t"]).join(t) + rng.choice([".", ", ", "\n", ""]) + " ".join(t[:3]), rng.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize("p", [phrases.Params(min_count=4, shard_words=150), phrases.Params(min_count=9, top=5, most_broadcast=0)])
def test_equals_brute_force(spark, p):
    assert len(check(spark, made(2), p, parts=4)) > 10


def test_edges(spark):
    rows = [(None, "en"), ("", "en"), (" ., \n", None), ("one", "en")] + [("Same Words here", "en")] * 6 + [("same words here", None)] * 6
    rows += [("x y " * 20_000, "long"), ("a.b " * 50, "en"), ("no break", "en"), ("É é\x0bé É", "en")]
    check(spark, rows, phrases.Params(min_count=5))
    check(spark, rows[:5], phrases.Params(min_count=5))


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.top_collocations(empty).count() == 0
    rows = [("u v w", "en", 1, "x", 3)] * 4
    docs = spark.createDataFrame(rows, "text string, lang string, f long, phrase string, shard long")
    assert [r.phrase for r in phrases.top_collocations(docs, phrases.Params(min_count=2)).collect()] == ["u v w"]


def test_index_intervals():
    """Growing to either side keeps both intervals right."""
    rng = np.random.default_rng(4)
    t = rng.integers(0, 4, 300).astype(np.int32)
    t[0] = 0
    fore, back = phrases.index(t, 5)
    total = np.bincount(t, minlength=4)
    lo = np.concatenate([[0], np.cumsum(total)])[:-1]
    have = {(c,): (int(lo[c]), int(lo[c]), int(total[c])) for c in (1, 2, 3)}
    for k in range(2, 6):
        names = list(have)
        a, b, n = (np.array([have[x][i] for x in names]) for i in range(3))
        left = k % 2 == 0
        which, symbol, count, here, there = phrases.extend(fore if left else back, a if left else b, b if left else a, n, k > 2)
        have = {}
        for w, s, c, h, o in zip(which, symbol, count, here, there):
            have[(int(s), *names[w]) if left else (*names[w], int(s))] = (int(h), int(o), int(c)) if left else (int(o), int(h), int(c))
        want = Counter(tuple(t[i:i + k].tolist()) for i in range(len(t) - k + 1) if t[i:i + k].all())
        assert {x: v[2] for x, v in have.items()} == dict(want)


def test_shards_meet_in_blocks(spark, monkeypatch):
    """Counts and answers travel as one row a shard and bucket, however many words and phrases a shard has; the shards are removed once indexed."""
    seen, paths = {}, []
    kept, kept_at = phrases.C.stored, phrases.C.stored_at

    def stored(df, name):
        out = kept(df, name)
        seen.setdefault(name, []).append(out)
        return out

    def stored_at(df, name):
        out, path = kept_at(df, name)
        if name == "phrase-shards":
            seen[name] = out.count()
            paths.append(path)
        return out, path

    monkeypatch.setattr(phrases.C, "stored", stored)
    monkeypatch.setattr(phrases.C, "stored_at", stored_at)
    rows = [(" ".join(f"w{(i * 7 + j) % 300}" for j in range(400)), "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    p = phrases.Params(min_count=5)
    assert sorted(tuple(r) for r in phrases.top_collocations(docs, p).collect()) == plain(rows, 5, p.top)
    shards, buckets = 2, phrases._LEAST_BUCKETS
    assert seen["phrase-shards"] <= shards * (buckets + 1)
    assert seen["phrase-index"][0].count() <= shards * (buckets + 1)
    assert all(x.count() <= shards * (buckets + 1) for x in seen["phrases-found"])
    assert all(x.filter("id is null").count() <= shards * buckets for x in seen["phrases-frequent"])
    assert not any(os.path.exists(x.replace("file:", "")) for x in paths)
