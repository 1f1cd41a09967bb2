"""The merging table and the fan-out of one subscription: retries, compaction, snapshots, tombstones."""

import os
import random
import uuid

import pytest

from pitwall import schemas
from pitwall.session import scratch_path
from pitwall.sources import decode, topics
from pitwall.streaming import fanout
from pitwall.streaming.upsert import UpsertTable

SCHEMA = "k string, at long, v int, gone boolean"


def _table(spark, **kw):
    return UpsertTable(spark, scratch_path(spark, f"upsert-{uuid.uuid4().hex}"), SCHEMA, ["k"], "at",
                       **{"buckets": 4, "max_deltas": 2, "deleted": "gone", **kw})


def _batches(n, seed=1):
    """Rows in any order over ``n`` batches, some keys null, some rows tombstones, one batch empty."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, *"abcdefgh"]), i, rng.randrange(9), rng.random() < 0.2) for i in range(20 * n)]
    rng.shuffle(rows)
    cut = [rows[i::n] for i in range(n)]
    cut[n // 2] = []
    return cut


def _expected(batches):
    last = {}
    for b in batches:
        for k, at, v, gone in b:
            if k not in last or at > last[k][0]:
                last[k] = (at, v, gone)
    return sorted(((k, at, v) for k, (at, v, gone) in last.items() if not gone), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("k", "at", "v").collect()), key=str)


def _folders(path):
    return [os.path.join(d, s) for d, subs, _ in os.walk(path.replace("file:", "")) for s in subs]


def test_merge_equals_last_row_per_key_and_retries_change_nothing(spark):
    t, batches = _table(spark), _batches(8)
    most = 0
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, SCHEMA)
        t.process(df, i)
        if i % 3 == 2:
            before = _rows(t.read())
            t.process(df, i)                                    # the same batch once more
            assert _rows(t.read()) == before
        assert _rows(t.read()) == _expected(batches[:i + 1])
        assert t.snapshots() == list(range(max(0, i - 1), i + 1))
        entries = t.manifest(i)
        assert len(entries) <= 4 * 3
        most = max(most, len(_folders(t.path)))
        if i:
            assert _rows(t.read(i - 1)) == _expected(batches[:i])
    # both snapshots, with their deltas and bases: bounded by buckets and deltas whatever the number of batches
    assert most <= 3 + 2 * (4 * 3 + 2 * 3)
    assert {e.is_base for e in t.manifest(7)} != {False}


def test_compaction_rewrites_touched_buckets_only(spark):
    t = _table(spark, max_deltas=1, ratio=100.0)
    t.process(spark.createDataFrame([(c, 0, 0, False) for c in "abcdefghijkl"], SCHEMA), 0)
    first = {e.bucket: e.folder for e in t.manifest(0)}
    assert len(first) > 1
    t.process(spark.createDataFrame([("a", 1, 1, False)], SCHEMA), 1)
    changed = {e.bucket for e in t.manifest(1) if e.folder != first.get(e.bucket)}
    assert len(changed) == 1 and [e.is_base for e in t.manifest(1) if e.bucket in changed] == [True]
    assert _rows(t.read())[0] == ("a", 1, 1)


def test_older_row_after_a_tombstone_stays_out(spark):
    t = _table(spark)
    t.process(spark.createDataFrame([("a", 5, 1, True)], SCHEMA), 0)
    t.process(spark.createDataFrame([("a", 3, 2, False), ("b", 4, 3, None)], SCHEMA), 1)
    assert _rows(t.read()) == [("b", 4, 3)]


def test_empty_table_unknown_snapshot_and_a_gap(spark):
    t = _table(spark)
    assert t.read().count() == 0
    t.process(spark.createDataFrame([], SCHEMA), 0)
    assert t.read().count() == 0
    with pytest.raises(ValueError):
        t.read(7)
    t.process(spark.createDataFrame([("a", 1, 1, False)], SCHEMA), 1)
    with pytest.raises(ValueError):
        t.process(spark.createDataFrame([("a", 2, 2, False)], SCHEMA), 5)
    assert _rows(t.read()) == [("a", 1, 1)]


class _Failing:
    """A sink that fails once."""

    def __init__(self, inner):
        self.inner, self.left = inner, 1

    def process(self, batch, batch_id):
        if self.left:
            self.left -= 1
            raise OSError("no room")
        self.inner.process(batch, batch_id)


def test_fanout_retry_after_a_sink_failed(spark):
    base = scratch_path(spark, f"fanout-{uuid.uuid4().hex}")
    comments = fanout.AppendTable(spark, f"{base}/comments", "id string, message string, arrival long")
    alerts = fanout.AppendTable(spark, f"{base}/alerts", "team_name string, is_anomaly boolean, arrival long")
    same = lambda df: df
    f = fanout.Fanout(spark, base, [
        fanout.Route("said", schemas.COMMENTARY_WIRE, decode.commentary, ((same, comments),)),
        fanout.Route("alerts", schemas.ANOMALY_WIRE, decode.anomalies, ((same, _Failing(alerts)),)),
    ])
    rows = [("said", '{"id":"1","message":"m","timestamp":1.0,"type":null}', 1), ("said", '{"id":"2","message":null,"timestamp":1.0}', 2),
            ("said", '{"id":"3"', 3), ("said", None, 4), ("alerts", '{"team_name":"T","is_anomaly":true}', 5), ("alerts", "", 6),
            ("other", "{}", 7), (None, "{}", 8)]
    batch = spark.createDataFrame([(t, None, v, a) for t, v, a in rows], fanout.RECORD)
    with pytest.raises(OSError):
        f.process(batch, 0)
    f.process(batch, 0)
    assert [tuple(r) for r in comments.read().collect()] == [("1", "m", 1)]
    assert [tuple(r) for r in alerts.read().collect()] == [("T", True, 5)]
    assert sorted((r.topic, r.arrival) for r in f.dead.read().collect()) == [("alerts", 6), ("said", 3)]
    assert sorted(r.arrival for r in f.unrouted.read().collect()) == [7, 8]


def test_sinks_refuse_other_types_and_routes_are_unique(spark):
    sink = fanout.AppendTable(spark, scratch_path(spark, "never"), "id long")
    with pytest.raises(schemas.ContractError):
        sink.process(spark.createDataFrame([("x",)], "id string"), 0)
    route = fanout.Route("a", schemas.ANOMALY_WIRE, decode.anomalies, ())
    with pytest.raises(ValueError):
        fanout.Fanout(spark, "x", [route, route])


def test_one_subscription_for_all_topics():
    o = topics.kafka_options("b:1", topics.subscribed_topics("p", "c", "a", True), group_id="g")
    assert o["subscribe"] == "p,c,a" and o["kafka.group.id"] == "g"
