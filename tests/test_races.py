import datetime as dt

from pitwall.operators import races

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
PS = "arrival long, ts timestamp, race_id string, driver_name string, position int, team_name string, speed double"


def _pos(spark, rows):
    return spark.createDataFrame(rows, PS)


def _race_df(spark):
    rows = [(1, T0, "r1", "Ada Quill", 1, None, None), (2, T0 + dt.timedelta(seconds=25), "r1", "Ben Marsh", 2, None, None),
            (3, T0 + dt.timedelta(seconds=100), "r2", "Cy Rowe", 1, None, None)]
    return _pos(spark, rows), races.races(_pos(spark, rows), 60)


def test_status_progress_over_time(spark):
    _, r = _race_df(spark)
    at = {}
    for off in [-10, 0, 30, 60, 90]:
        st = {x.race_id: x for x in races.status(r, T0 + dt.timedelta(seconds=off)).collect()}
        at[off] = st["r1"]
    assert at[-10].status == "not_started" and at[-10].progress == 0.0 and at[-10].elapsed_s == 0.0
    assert at[0].status == "in_progress" and at[0].progress == 0.0 and at[0].remaining_s == 60.0
    assert at[30].status == "in_progress" and at[30].progress == 0.5 and at[30].remaining_s == 30.0
    assert at[60].status == "finished" and at[60].progress == 1.0 and at[60].remaining_s == 0.0
    assert at[90].remaining_s == 0.0
    assert at[0].selected_driver == "Ada Quill"
    assert at[0].end_time == T0 + dt.timedelta(seconds=60)


def test_eviction_after_an_hour(spark):
    _, r = _race_df(spark)
    asof = T0 + dt.timedelta(hours=1, seconds=90)
    ev = {x.race_id for x in races.evicted(races.status(r, asof), asof).collect()}
    assert ev == {"r1"}          # r1 ended 01:00:30 before asof, r2 only 00:00:10 + ... ends later


def test_laps_history_lifecycle(spark):
    p, r = _race_df(spark)
    laps = {x.arrival: x.lap for x in races.laps(p, r).collect()}
    assert laps == {1: 1, 2: 3, 3: 1}
    hist = {x.arrival: (x.seq, x.progress) for x in races.history(p, r, chunk_rows=1).collect()}
    assert hist[1] == (1, 0.0) and hist[2][0] == 1
    lc = sorted((x.race_id, x.status) for x in races.lifecycle(r).collect())
    assert lc == [("r1", "finished"), ("r1", "in_progress"), ("r2", "finished"), ("r2", "in_progress")]


def test_validate_known_unknown(spark, roster):
    req = spark.createDataFrame([(1, "Ada Quill"), (2, "Nobody"), (3, None)], "request_id long, driver_name string")
    ok, bad = races.validate(req, roster)
    assert [x.request_id for x in ok.collect()] == [1]
    assert sorted(x.request_id for x in bad.collect()) == [2, 3]
