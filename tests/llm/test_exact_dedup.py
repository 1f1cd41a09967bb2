"""Operator 11 against brute force and edge cases."""

import hashlib
import random
from collections import defaultdict

import pytest

from pitwall.llm import exact_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows):
    """(doc_id, text) to sorted (doc_id, keep_id, size, sha) and the number of rows that stay of each text."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def check(spark, rows, p=exact_dedup.Params(), parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = exact_dedup.mark_duplicates(docs, p).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r)
    assert {k: len(v) for k, v in kept.items()} == {k: 1 for k in {r.text_sha256 for r in got}}
    assert all(v[0].doc_id == v[0].keep_id for v in kept.values())


ROWS = [(1, None), (2, ""), (3, "É"), (4, "é"), (5, "Abc"), (6, "aBC"), (7, "abc "), (None, "ABC"), (None, None), (8, "x"), (8, "x"), (8, "y"), (9, "X"),
        (None, "only null ids"), (None, "only NULL ids"), (10, "long " * 200_000), (11, "LONG " * 200_000), (12, "long " * 200_000 + ".")]


def test_edges(spark):
    check(spark, ROWS)


@pytest.mark.parametrize("p", [exact_dedup.Params(), exact_dedup.Params(cells_per_row=1, most_bits=32768, bits_per_cell=1, hot_groups=1),
                               exact_dedup.Params(hot_groups=1_000_000)])
def test_equals_brute_force(spark, p):
    """A third of all rows are one text; full filters and every way of joining give the same."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["Hot text", "hot TEXT"]) if i % 3 == 0 else f"text {rng.randint(0, 400)}".title()) for i in range(900)]
    rows += [(rng.randint(0, 50), "Repeated Row") for _ in range(200)] + [(51, "repeated row")] * 40
    check(spark, rows, p, parts=7)


def test_filters_hold_every_copy(spark):
    keys = exact_dedup.keyed(spark.createDataFrame([(i, f"t{i % 300}" if i % 2 else f"u{i}") for i in range(1200)], "doc_id long, text string"))
    flagged = exact_dedup.flagged(keys.drop("row"), exact_dedup.Params())
    sizes = flagged.groupBy("text_sha256").agg({"doc_id": "count", "maybe": "min"}).collect()
    assert all(r["min(maybe)"] for r in sizes if r["count(doc_id)"] > 1)
    assert sum(r["min(maybe)"] for r in sizes if r["count(doc_id)"] == 1) < 30


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert exact_dedup.mark_duplicates(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns


def test_columns_with_the_operators_names(spark):
    rows = [(1, "A", "k1", 7, 0, "x"), (2, "a", "k2", 8, 1, "y"), (3, "b", None, 9, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, row long, maybe int, bitmap0 string")
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r) for r in left.collect()) == rows[1:]
    assert exact_dedup.mark_duplicates(docs).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.mark_duplicates(spark.createDataFrame(ROWS[:8], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "MapIn", "InPandas"))
