"""Streaming forms equal the batch operators; restart resumes from the checkpoint."""

import datetime as dt
import os
import random
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pitwall import sinks
from pitwall.operators import anomaly, leaderboard as lb
from pitwall.schemas import ContractError
from pitwall.session import scratch_path
from pitwall.sources import topics
from pitwall.streaming import alerts, anomaly as sanom, batches, leaderboard as slb, runner

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
M_SCHEMA = pa.schema([("arrival", pa.int64()), ("key", pa.string()), ("ts", pa.timestamp("us", tz="UTC")),
                      ("team_name", pa.string()), ("engine_temperature", pa.float64())])
P_SCHEMA = pa.schema([("arrival", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("race_id", pa.string()),
                      ("driver_name", pa.string()), ("position", pa.int32()), ("team_name", pa.string()),
                      ("speed", pa.float64())])


def _metrics_rows(n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        team = rng.choice(["A", "B", "C"])
        v = round(rng.uniform(80, 100), 2)
        if rng.random() < 0.05:
            v = round(v * 1.4, 2)
        rows.append((i, "race", T0 + dt.timedelta(milliseconds=i * 250 + rng.randrange(0, 3)), team, v))
    return rows


def _write_files(directory, rows, schema, n_files, start=0, rng=None):
    """Consecutive slices of ``rows`` (in order) as files with increasing mtimes; rows
    inside each file are shuffled."""
    os.makedirs(directory, exist_ok=True)
    size = -(-len(rows) // n_files)
    for i in range(n_files):
        part = rows[i * size:(i + 1) * size]
        if rng:
            part = part[:]
            rng.shuffle(part)
        cols = list(zip(*part)) if part else [[] for _ in schema]
        t = pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
        p = os.path.join(directory, f"part-{start + i:04d}.parquet")
        pq.write_table(t, p)
        os.utime(p, (1_700_000_000 + start + i, 1_700_000_000 + start + i))


def _spark_schema(spark, directory):
    return spark.read.parquet(directory).schema


def _detect(spark, src, base, method="gaussian", drain=True, **kw):
    """Run the detector over the files of ``src``, one a batch."""
    stream = topics.files_stream(spark, src, _spark_schema(spark, src), max_files_per_trigger=1)
    d = sanom.Detector(spark, base, method, **kw)
    q = d.start(stream, f"{base}/checkpoint")
    runner.finish(q)
    if drain:
        d.drain(runner.next_batch(q))
    return d


@pytest.fixture
def base(spark):
    return scratch_path(spark, "test-streams", uuid.uuid4().hex[:12])


def _scored(d):
    return {r.arrival: (r.n, r.is_anomaly, r.forecast, r.lower, r.upper) for r in d.scored().collect()}


def _batch(spark, src, method="gaussian", where="true"):
    rows = spark.read.parquet(src).where(where)
    return {r.arrival: (r.n, r.is_anomaly, r.forecast, r.lower, r.upper) for r in anomaly.detect(rows, method).collect()}


@pytest.mark.parametrize("method", ["gaussian", "ar1"])
def test_detector_stream_equals_batch_out_of_order(spark, tmp_dir, base, method):
    """Rows come up to 10 s after their time, across files, with nulls and a null team: results are those of one batch."""
    rng = random.Random(1)
    rows = [r[:4] + (None,) if i % 17 == 3 else r[:3] + (None,) + r[4:] if i % 11 == 5 else r for i, r in enumerate(_metrics_rows(400))]
    rows.sort(key=lambda r: r[2] + dt.timedelta(milliseconds=rng.randrange(10_000)))
    src = f"{tmp_dir}/src"
    _write_files(src, rows, M_SCHEMA, 5, rng=rng)
    d = _detect(spark, src, base, method, delay_ms=10_000)
    assert _scored(d) == _batch(spark, src, method)
    assert d.late().count() == 0
    kept = {t: sorted(x for x in os.listdir(f"{base.removeprefix('file:')}/{t}")) for t in ("held", "carry", "mark")}
    assert all(len(v) == 2 for v in kept.values())


def test_detector_restart_from_checkpoint(spark, tmp_dir, base):
    rows = _metrics_rows(300, seed=9)
    src = f"{tmp_dir}/src"
    _write_files(src, rows[:150], M_SCHEMA, 2)
    _detect(spark, src, base)                                # drained, then taken back
    _write_files(src, rows[150:], M_SCHEMA, 2, start=2)
    assert _scored(_detect(spark, src, base)) == _batch(spark, src)


def test_a_retried_batch_changes_nothing(spark, tmp_dir, base):
    src = f"{tmp_dir}/src"
    _write_files(src, _metrics_rows(200, seed=3), M_SCHEMA, 2)
    parts = [spark.read.parquet(f"{src}/part-000{i}.parquet") for i in (0, 1)]
    d = sanom.Detector(spark, base, delay_ms=5_000)
    for batch_id in (0, 0, 1, 1):
        d.process(parts[batch_id], batch_id)
    d.drain(2)
    assert _scored(d) == _batch(spark, src)


def test_late_rows_are_an_output(spark, tmp_dir, base):
    rows = _metrics_rows(60, seed=2)
    late = [(999, "race", T0, "A", 500.0), (1000, "race", None, "B", 1.0)]     # before all that was scored; without a time
    src = f"{tmp_dir}/src"
    _write_files(src, rows, M_SCHEMA, 2)
    _write_files(src, late, M_SCHEMA, 1, start=2)
    d = _detect(spark, src, base, delay_ms=1_000)
    assert _scored(d) == _batch(spark, src, where="arrival < 999")
    assert sorted((r.arrival, r.team_name, r.batch_id) for r in d.late().collect()) == [(999, "A", 2), (1000, "B", 2)]


def test_rows_wait_for_the_watermark(spark, tmp_dir, base):
    rows = [(i, "race", T0 + dt.timedelta(seconds=i), "A", 90.0 + i % 3) for i in range(30)]
    src = f"{tmp_dir}/src"
    _write_files(src, rows, M_SCHEMA, 1)
    d = _detect(spark, src, base, drain=False, delay_ms=9_500)
    assert sorted(r.arrival for r in d.scored().collect()) == list(range(20))
    assert sorted(r.arrival for r in d.held.of(0).collect()) == list(range(20, 30))


def test_detector_state_expires_after_ttl(spark, tmp_dir, base):
    import time
    d = sanom.Detector(spark, base, delay_ms=0, ttl_ms=2_000)
    row = lambda i, team="A": (i, "race", T0 + dt.timedelta(seconds=i), team, 90.0 + i % 3)
    make = lambda rows: spark.createDataFrame(rows, sanom.ROW)
    d.process(make([row(i) for i in range(20)]), 0)
    time.sleep(2.5)                                              # no data for longer than the TTL
    d.process(make([row(100 + i) for i in range(3)]), 1)
    got = {r.arrival: r.n for r in d.scored().collect()}
    assert got[19] == 19 and [got[100], got[101], got[102]] == [0, 1, 2]


def _positions_rows(n=500, seed=6):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(seconds=i), rng.choice(["r1", "r2", None]), f"d{rng.randrange(13)}",
             rng.randrange(1, 11), None, None) for i in range(n)]


def test_leaderboard_streams_equal_batch(spark, tmp_dir):
    rows = _positions_rows()
    src = f"{tmp_dir}/src"
    _write_files(src, rows, P_SCHEMA, 5)
    schema = _spark_schema(spark, src)
    batch_df = spark.read.parquet(src)

    out, ck = f"{tmp_dir}/latest", f"{tmp_dir}/ck1"
    runner.finish(slb.start_latest(topics.files_stream(spark, src, schema, max_files_per_trigger=1), out, ck))
    got = sinks.read_upserted(spark, out, list(lb.KEYS), slb.LATEST_COLS)
    key = ["race_id", "driver_name", "arrival", "position"]
    assert sorted(map(tuple, got.select(*key).collect()), key=str) == \
        sorted(map(tuple, lb.latest(batch_df).select(*key).collect()), key=str)


def _lists(df):
    return sorted(map(tuple, df.select("race_id", "driver_name", "slot", "arrival").collect()), key=str)


def test_bounded_lists_over_batches_equal_batch(spark, tmp_dir, base):
    rng = random.Random(3)
    rows, src = _positions_rows(), f"{tmp_dir}/src"
    _write_files(src, rows, P_SCHEMA, 4, rng=rng)
    stream = topics.files_stream(spark, src, _spark_schema(spark, src), max_files_per_trigger=1)
    keeper = slb.BoundedLists(spark, base, chunk=64)
    runner.finish(keeper.start(stream, f"{base}/checkpoint"))
    assert _lists(keeper.lists()) == _lists(lb.bounded(spark.read.parquet(src)))
    again = slb.BoundedLists(spark, base, chunk=64)
    again.process(spark.read.parquet(f"{src}/part-0003.parquet"), 3)             # a retried batch
    assert _lists(again.lists()) == _lists(keeper.lists())


def test_streams_refuse_other_types(spark, base):
    stream = spark.readStream.format("rate").load().selectExpr("value arrival", "'k' key", "timestamp ts", "'A' team_name", "'hot' engine_temperature")
    with pytest.raises(ContractError):
        sanom.Detector(spark, base).start(stream, f"{base}/checkpoint")
    with pytest.raises(ContractError):
        slb.BoundedLists(spark, base).start(stream, f"{base}/checkpoint")


def test_last_rows_per_key_over_batches(spark, base):
    keeper = batches.LastN(spark, base, "k string, i long, v string", ["k"], ["i"], 3)
    make = lambda rows: spark.createDataFrame(rows, "k string, i long, v string")
    parts = [make([("a", i, "x") for i in (5, 1, 9)] + [(None, 2, None)]), make([("a", 7, "y"), ("b", 1, None)]), make([])]
    for batch_id in (0, 1, 1, 2):
        keeper.process(parts[batch_id], batch_id)
    assert sorted((r.k or "", r.i) for r in keeper.rows().collect()) == [("", 2), ("a", 5), ("a", 7), ("a", 9), ("b", 1)]


def test_idle_races_are_evicted(spark, base):
    make = lambda rows: spark.createDataFrame(rows, slb.ROW)
    row = lambda i, s, race, d: (i, T0 + dt.timedelta(seconds=s), race, d, 1, None, None)
    keeper = slb.BoundedLists(spark, base, idle_ms=3_600_000)
    keeper.process(make([row(0, 0, "old", "a"), row(1, 10, "new", "b"), row(2, 20, None, "c")]), 0)
    assert keeper.lists().count() == 3
    keeper.process(make([row(3, 4000, "new", "d")]), 1)
    assert _lists(keeper.lists()) == [("new", "b", 1, 1), ("new", "d", 2, 3)]
    keeper.process(make([row(4, 4001, "old", "e")]), 2)                          # starts over
    assert _lists(keeper.lists().where("race_id = 'old'")) == [("old", "e", 1, 4)]


def test_dedupe_within_watermark(spark, tmp_dir):
    rows = [(i, T0 + dt.timedelta(seconds=i), "r1", f"d{i % 3}", 1, None, None) for i in range(30)]
    src = f"{tmp_dir}/src"
    _write_files(src, rows, P_SCHEMA, 3)
    s = topics.files_stream(spark, src, _spark_schema(spark, src), max_files_per_trigger=1)
    d = alerts.dedupe(s, ["driver_name"], "ts", "1 hour")
    out, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"
    runner.finish(runner.start_files(d.select("driver_name", "arrival"), out, ck))
    got = sorted((r.driver_name, r.arrival) for r in spark.read.parquet(out).collect())
    assert got == [("d0", 0), ("d1", 1), ("d2", 2)]


def test_lifecycle_timer(spark, tmp_dir):
    rows = [(0, T0, "r1", "a", 1, None, None), (1, T0 + dt.timedelta(seconds=30), "r2", "b", 1, None, None),
            (2, T0 + dt.timedelta(seconds=200), "r3", "c", 1, None, None)]
    src = f"{tmp_dir}/src"
    _write_files(src, rows, P_SCHEMA, 1)
    s = topics.files_stream(spark, src, _spark_schema(spark, src))
    out, ck = f"{tmp_dir}/out", f"{tmp_dir}/ck"
    runner.finish(runner.start_files(alerts.lifecycle(s, 60, "10 seconds"), out, ck))
    got = sorted((r.race_id, r.status) for r in spark.read.parquet(out).collect())
    # the watermark (200 s - 10 s) has passed the ends of r1 (60 s) and r2 (90 s) only
    assert got == [("r1", "finished"), ("r1", "in_progress"), ("r2", "finished"), ("r2", "in_progress"),
                   ("r3", "in_progress")]


def test_lifecycle_over_many_batches_finishes_each_race_once(spark, tmp_dir):
    rows = [(i, T0 + dt.timedelta(seconds=7 * i), f"r{i % 3}", "d", 1, None, None) for i in range(120)]
    src, out, ck = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    _write_files(src, rows, P_SCHEMA, 6)
    stream = topics.files_stream(spark, src, _spark_schema(spark, src), max_files_per_trigger=1)
    runner.finish(runner.start_files(alerts.lifecycle(stream, delay="10 seconds"), out, ck))
    got = sorted((r.race_id, r.status) for r in spark.read.parquet(out).collect())
    assert got == sorted((f"r{i}", s) for i in range(3) for s in ("in_progress", "finished"))


def test_settled_lifecycle_starts_with_the_earliest_row_of_any_batch(spark, tmp_dir):
    at = lambda i, s, race: (i, T0 + dt.timedelta(seconds=s), race, "d", 1, None, None)
    # r1's earliest row comes in the second batch; r2's start is never passed
    rows = [at(0, 30, "r1"), at(1, 35, "r1"), at(2, 10, "r1"), at(3, 40, "r1"), at(4, 500, "x"), at(5, 501, "r2")]
    src, out, ck = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    _write_files(src, rows, P_SCHEMA, 3)
    stream = topics.files_stream(spark, src, _spark_schema(spark, src), max_files_per_trigger=1)
    runner.finish(runner.start_files(alerts.lifecycle(stream, 60, "60 seconds", settled=True), out, ck))
    got = sorted((r.race_id, r.status, r.at) for r in spark.read.parquet(out).select("race_id", "status", F.unix_seconds("at").alias("at")).collect())
    base = int(T0.timestamp())
    assert got == [("r1", "finished", base + 70), ("r1", "in_progress", base + 10)]


def test_finish_raises_when_a_query_does_not_end(spark, tmp_dir):
    q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_dir}/ck").start()
    with pytest.raises(TimeoutError):
        runner.finish(q, timeout_s=1.0)
    assert not q.isActive
