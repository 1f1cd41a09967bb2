import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from pitwall.operators import capped, leaderboard as lb
from pitwall.sources import decode

SCHEMA = "arrival long, ts timestamp, race_id string, driver_name string, position int, team_name string, speed double"
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _pos(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _row(arrival, race, driver, position, sec=None, speed=None):
    return (arrival, T0 + dt.timedelta(seconds=arrival if sec is None else sec), race, driver, position, None, speed)


def fifo(seq, cap):
    """Plain Python statement of the capped list: update keeps the slot, new driver is
    appended, the oldest slot goes when the list is longer than ``cap``."""
    slots = []
    for d in seq:
        if d in slots:
            continue
        slots.append(d)
        if len(slots) > cap:
            slots.pop(0)
    return slots


def test_latest_is_by_arrival_not_event_time(spark):
    rows = [_row(1, "r1", "a", 3, sec=10), _row(2, "r1", "a", 5, sec=5),   # later arrival, older ts
            _row(3, "r1", "b", 1, sec=7), _row(4, "r1", "b", 2, sec=7)]   # equal ts, arrival decides
    got = {r.driver_name: r.position for r in lb.latest(_pos(spark, rows)).collect()}
    assert got == {"a": 5, "b": 2}


def test_null_race_is_its_own_list(spark):
    rows = [_row(1, None, "a", 1), _row(2, "r1", "a", 2), _row(3, None, "a", 4)]
    b = lb.latest(_pos(spark, rows))
    assert {(r.race_id, r.position) for r in b.collect()} == {(None, 4), ("r1", 2)}
    assert [r.position for r in lb.snapshot(b, None).collect()] == [4]
    assert [r.position for r in lb.snapshot(b, "r1").collect()] == [2]
    assert [r.position for r in lb.snapshot(b, "").collect()] == [4]


def test_capped_list_eviction_and_reentry(spark):
    seq = [f"d{i}" for i in range(1, 11)] + ["d11", "d5", "d1"]
    rows = [_row(i, "r1", d, (i % 10) + 1) for i, d in enumerate(seq)]
    got = lb.bounded(_pos(spark, rows)).orderBy("slot").collect()
    assert [r.driver_name for r in got] == fifo(seq, 10)
    assert [r.driver_name for r in got][-1] == "d1"          # re-entered at the end
    assert "d2" not in [r.driver_name for r in got]          # evicted by the re-entry
    assert [r.slot for r in got] == list(range(1, 11))


def test_capped_list_matches_python_fold_on_random_input(spark):
    rng = random.Random(7)
    rows, expect = [], {}
    arrival = 0
    for race in ["r1", "r2", None]:
        seq = [f"d{rng.randrange(14)}" for _ in range(rng.randrange(5, 120))]
        for d in seq:
            rows.append(_row(arrival, race, d, rng.randrange(1, 11)))
            arrival += 1
        expect[race] = fifo(seq, 10)
    rng.shuffle(rows)  # arrival order is carried by the offset, not by the input order
    got = {}
    for r in lb.bounded(_pos(spark, rows)).orderBy("slot").collect():
        got.setdefault(r.race_id, []).append(r.driver_name)
    assert got == expect


def test_decode_positions_empty_race_and_tombstone(spark):
    df = spark.createDataFrame([
        ('{"driver_name":"a","position":2,"timestamp":1704067200123,"race_id":"","team_name":null,"speed":null}', 1),
        ('{"driver_name":"b","position":3,"timestamp":1704067200456,"race_id":"r9","team_name":"t","speed":1.5}', 2),
        (None, 3),
        ("not json", 4),
    ], "value string, arrival long").withColumn("key", F.lit(None).cast("binary"))
    out = {r.arrival: r for r in decode.positions(df).collect()}
    assert set(out) == {1, 2}
    assert out[1].race_id is None and out[2].race_id == "r9"
    assert out[1].ts == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert "team_name" not in decode.positions(df).columns
    good, bad = decode.split_corrupt(df, decode.S.POSITION_WIRE)
    assert [r.arrival for r in bad.collect()] == [4]


def test_encode_positions_coercions(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, 1)],
                               "driver_name string, position int, ts timestamp, race_id string, "
                               "team_name string, speed double, arrival long")
    v = decode.encode_positions(df).collect()[0].value
    assert '"driver_name":""' in v and '"position":0' in v and '"timestamp":0' in v


def test_final_positions_validity(spark):
    full = [_row(i, "ok", f"d{i}", i) for i in range(1, 11)]
    dup = [_row(100 + i, "dup", f"d{i}", min(i, 9)) for i in range(1, 11)]
    out_of_range = [_row(200 + i, "bad", f"d{i}", i - 1) for i in range(1, 11)]
    short = [_row(300 + i, "short", f"d{i}", i) for i in range(1, 10)]
    running = [_row(400 + i, "running", f"d{i}", i) for i in range(1, 11)]
    done = spark.createDataFrame([("ok",), ("dup",), ("bad",), ("short",)], "race_id string")
    final = lb.final_positions(lb.bounded(_pos(spark, full + dup + out_of_range + short + running)), done)
    flags = {(r.race_id, r.valid, r.valid_strict) for r in final.collect()}
    assert flags == {("ok", True, True), ("dup", True, False), ("bad", False, False), ("short", False, False)}
    assert [r.driver_name for r in lb.winner(final).where("race_id = 'ok'").collect()] == ["d1"]


def test_changes_and_baseline(spark):
    rows = [_row(1, "r", "a", 5), _row(2, "r", "a", 5), _row(3, "r", "a", 3), _row(4, "r", "a", 7),
            _row(5, "r", "b", 2)]
    ch = lb.changes(_pos(spark, rows), chunk_rows=2).orderBy("arrival").collect()
    assert [(r.arrival, r.prev_position, r.change, r.direction) for r in ch] == [(3, 5, 2, "gain"), (4, 3, -4, "loss")]
    bd = {r.driver_name: (r.baseline_position, r.position, r.direction)
          for r in lb.baseline_delta(_pos(spark, rows)).collect()}
    assert bd == {"a": (5, 7, "loss"), "b": (None, 2, "")}           # b was not in the first snapshot
    bd = {r.driver_name: (r.baseline_position, r.position, r.change)
          for r in lb.baseline_delta(_pos(spark, rows + [_row(6, "r", "c", 9)]), since=5).collect()}
    assert bd == {"a": (7, 7, 0), "b": (2, 2, 0), "c": (None, 9, None)}


def test_enrich_defaults_badge_and_selection(spark, roster):
    rows = [_row(1, "r", "Ada Quill", 1), _row(2, "r", "Nobody", 5), _row(3, "r", "Jo Lark", 9)]
    e = {r.driver_name: r for r in lb.enrich(lb.latest(_pos(spark, rows)), roster, "Jo Lark").collect()}
    assert e["Nobody"].driver_label == "Unknown Driver" and e["Nobody"].team_color == "#000000"
    assert e["Nobody"].team_label == "Unknown Team"
    assert (e["Ada Quill"].badge, e["Nobody"].badge, e["Jo Lark"].badge) == ("podium", "points", "regular")
    assert e["Jo Lark"].is_selected and not e["Ada Quill"].is_selected


def test_avg_speed_exact(spark):
    rows = [_row(1, "r", "a", 1, speed=0.1), _row(2, "r", "a", 1, speed=0.2), _row(3, "r", "a", 1, speed=None)]
    r = lb.avg_speed(_pos(spark, rows)).collect()[0]
    assert r.n == 2 and r.avg_speed == 0.15


def test_hot_race_without_eviction_and_crowded_race(spark):
    rng = random.Random(13)
    rows, seqs, arrival = [], {"hot": [], "crowded": []}, 0
    for _ in range(600):                              # hot race: 6 drivers, many messages
        d = f"h{rng.randrange(6)}"
        rows.append(_row(arrival, "hot", d, rng.randrange(1, 11)))
        seqs["hot"].append(d)
        arrival += 1
    for _ in range(80):                               # crowded race: 15 drivers
        d = f"c{rng.randrange(15)}"
        rows.append(_row(arrival, "crowded", d, rng.randrange(1, 11)))
        seqs["crowded"].append(d)
        arrival += 1
    got = {}
    for r in lb.bounded(_pos(spark, rows)).orderBy("slot").collect():
        got.setdefault(r.race_id, []).append(r.driver_name)
    assert got == {k: fifo(v, 10) for k, v in seqs.items()}


def _race_rows(seed, n, drivers):
    rng = random.Random(seed)
    rows, seqs = [], {"a": [], "b": [], None: []}
    for arrival in range(n):
        race = rng.choice(["a", "a", "b", None])
        d = f"d{rng.randrange(drivers)}"
        rows.append(_row(arrival, race, d, rng.randrange(1, 11)))
        seqs[race].append(d)
    return rows, seqs


@pytest.mark.parametrize("chunk", [16, 64, 10 ** 9])
@pytest.mark.parametrize("drivers", [7, 16])
def test_chunks_with_repair_equal_the_fold(spark, chunk, drivers):
    """Races with and without eviction, in chunks from a few messages to all."""
    rows, seqs = _race_rows(17, 900, drivers)
    expect = {k: fifo(v, 10) for k, v in seqs.items()}
    got = {}
    for r in lb.bounded(_pos(spark, rows), chunk_offsets=chunk).orderBy("slot").collect():
        got.setdefault(r.race_id, []).append(r.driver_name)
    assert got == expect


def test_repair_mends_wrong_starts(spark):
    """Re-entries inside chunks defeat the guesses; repair still gives every chunk's exact start."""
    rows, seqs = _race_rows(5, 600, 13)
    lists, rounds = capped.chunk_lists(_pos(spark, rows), 10, 80)
    assert rounds > 0
    got = {(r.rk, r.chunk): (r.start, r.end) for r in lists.collect()}
    for race, rk in (("a", "ra"), ("b", "rb"), (None, "-")):
        mine = [(r[0], r[3]) for r in rows if r[2] == race]
        for (k, c), (start, end) in got.items():
            if k == rk:
                assert start == fifo([d for a, d in mine if a < c * 80], 10)
                assert end == fifo([d for a, d in mine if a < (c + 1) * 80], 10)


def test_list_after_every_message_and_initial_lists(spark):
    rows, seqs = _race_rows(6, 200, 13)
    pos = _pos(spark, rows)
    log = {(r.race_id, r.arrival): r.slots for r in capped.list_log(pos, 10, 32).collect()}
    names = {"a": [], "b": [], None: []}
    for r in rows:
        names[r[2]].append(r[3])
        assert log[r[2], r[0]] == fifo(names[r[2]], 10)
    first, rest = pos.where("arrival < 90"), pos.where("arrival >= 90")
    lists, _ = capped.chunk_lists(first, 10, 16)
    held = capped.members(lists).groupBy(capped.race_of(F.col("rk")).alias("race_id")).agg(F.expr("transform(sort_array(collect_list(struct(slot, driver_name))), x -> x.driver_name) slots"))
    held = held.unionByName(spark.createDataFrame([("idle", ["x", "y"])], held.schema))
    lists, _ = capped.chunk_lists(rest, 10, 16, held)
    got = {}
    for r in capped.members(lists, held).orderBy("slot").collect():
        got.setdefault(r.rk, []).append(r.driver_name)
    assert got == {"ra": fifo(seqs["a"], 10), "rb": fifo(seqs["b"], 10), "-": fifo(seqs[None], 10), "ridle": ["x", "y"]}
