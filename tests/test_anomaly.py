import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.operators import anomaly

SCHEMA = "arrival long, key string, ts timestamp, team_name string, engine_temperature double"
T0 = dt.datetime(2024, 1, 1)
Z90 = 1.6448536269514722


def _m(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _series(team, values, start=0, step_s=1, key="race"):
    return [(start + i, key, T0 + dt.timedelta(seconds=i * step_s), team, v) for i, v in enumerate(values)]


def brute_gaussian(rows, min_training=16):
    """Per row: history = same team, strictly earlier millisecond."""
    out = {}
    for a, _, ts, team, v in rows:
        hist = [w for (_, _, t2, tm2, w) in rows if tm2 == team and t2 < ts and w is not None]
        if len(hist) < min_training or v is None:
            out[a] = None
            continue
        mean = statistics.fmean(hist)
        sd = statistics.stdev(hist)
        half = Z90 * sd * math.sqrt(1 + 1 / len(hist))
        out[a] = v < mean - half or v > mean + half
    return out


def test_z_value():
    assert abs(anomaly.z_value(90) - Z90) < 1e-14
    assert abs(anomaly.z_value(95) - 1.959963984540054) < 1e-12


def test_min_training_threshold(spark):
    rng = random.Random(1)
    vals = [round(rng.uniform(80, 100), 2) for _ in range(17)] + [150.0]
    got = {r.arrival: (r.n, r.is_anomaly) for r in anomaly.gaussian(_m(spark, _series("A", vals))).collect()}
    assert got[15] == (15, None)       # 15 earlier points: not enough
    assert got[16][0] == 16 and got[16][1] is not None
    assert got[17] == (17, True)       # the spike


def test_gaussian_matches_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for team in ["A", "B"]:
        vals = [round(rng.uniform(80, 100), 2) for _ in range(60)]
        vals[30] = round(vals[30] * 1.4, 2)   # spike
        vals[45] = round(vals[45] * 0.6, 2)   # drop
        vals[50] = None                       # missing value
        rows += _series(team, vals, start=len(rows))
    # peers: two rows at the same millisecond share one history
    rows.append((999, "race", rows[40][2], "A", 95.5))
    got = {r.arrival: r.is_anomaly for r in anomaly.gaussian(_m(spark, rows), chunk_ms=7_000).collect()}
    assert got == brute_gaussian(rows)
    assert got[30] is True and got[45] is True


def test_constant_series_flags_any_change(spark):
    vals = [90.0] * 20 + [90.01]
    got = {r.arrival: r.is_anomaly for r in anomaly.gaussian(_m(spark, _series("A", vals))).collect()}
    assert got[19] is False and got[20] is True


def test_ar1_fits_and_flags(spark):
    rng = random.Random(5)
    v, vals = 90.0, []
    for _ in range(80):
        v = min(100.0, max(80.0, v * rng.uniform(0.99, 1.01)))
        vals.append(round(v, 2))
    vals[60] = round(vals[60] * 1.3, 2)
    res = {r.arrival: r for r in anomaly.ar1(_m(spark, _series("A", vals)), chunk_ms=9_000).collect()}
    assert res[16].is_anomaly is None          # 15 pairs of history
    assert res[17].n == 16
    assert res[60].is_anomaly is True


def test_severity_grid(spark):
    rows = []
    for c in [0.0, 0.90, 0.91, 0.95, 0.96]:
        for name, vals in [("Engine Temperature", [59.9, 60, 120, 120.1]), ("Tyre Pressure", [1.4, 1.5, 2.5, 2.6]),
                           ("Other", [0.0])]:
            rows += [(c, name, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "c double, name string, v double")
    got = {(r.c, r.name, r.v): r.s for r in df.select("c", "name", "v", X.severity("c", "name", "v").alias("s")).collect()}
    assert got[(0.0, "Other", 0.0)] == "info" and got[(0.90, "Other", 0.0)] == "info"
    assert got[(0.91, "Engine Temperature", 59.9)] == "warning"
    assert got[(0.95, "Engine Temperature", 120.1)] == "warning"      # 0.95 is not above 0.95
    assert got[(0.96, "Engine Temperature", 120.1)] == "critical"
    assert got[(0.96, "Engine Temperature", 59.9)] == "critical"
    assert got[(0.96, "Engine Temperature", 60.0)] == "warning"
    assert got[(0.96, "Tyre Pressure", 2.6)] == "critical" and got[(0.96, "Tyre Pressure", 2.5)] == "warning"
    assert got[(0.96, "Other", 0.0)] == "warning"


def test_enrich_team_lead_and_defaults(spark, roster):
    rows = [(1, "k", T0, "Lyra", 130.0, True), (2, "k", T0, "Deneb", None, None), (3, "k", T0, "Unknown", 50.0, False),
            (4, "k", T0, None, 70.0, True)]
    df = spark.createDataFrame(rows, "arrival long, key string, ts timestamp, team_name string, "
                                     "engine_temperature double, is_anomaly boolean").withColumn("ts_ms", F.unix_millis("ts"))
    got = {r.arrival: r for r in anomaly.enrich(df, roster).collect()}
    assert got[1].driver_name == "Cy Rowe"                 # first Lyra driver in roster order
    assert got[2].driver_name == "Jo Lark" and got[2].metric_value == 0.0 and got[2].confidence_score == 0.0
    assert got[3].driver_name == "Unknown"                 # no roster team: the team name
    assert got[4].driver_name is None
    assert got[1].confidence_score == 0.95 and got[1].severity == "warning"
    assert got[1].metric_name == "Engine Temperature"


def test_dedupe_and_recent(spark):
    rows = [(1, 100, "A", "m", 1.0), (2, 100, "A", "m", 2.0), (3, 100, "B", "m", 3.0), (4, 200, "A", "m", 4.0)]
    df = spark.createDataFrame(rows, "arrival long, timestamp long, team_name string, metric_name string, v double")
    d = {r.arrival for r in anomaly.dedupe(df).collect()}
    assert d == {1, 3, 4}
    r = anomaly.recent(df.withColumn("ts_ms", F.col("timestamp")), 2).collect()
    assert [x.arrival for x in r] == [4, 3]
    last = anomaly.last_n_oldest_first(df.withColumn("ts_ms", F.col("timestamp")), 2).orderBy("seq").collect()
    assert [(x.seq, x.arrival) for x in last] == [(1, 3), (2, 4)]


@pytest.mark.parametrize("method", ["gaussian", "ar1"])
def test_hot_team_chunking_does_not_change_results(spark, method):
    rng = random.Random(11)
    rows = _series("HOT", [round(rng.uniform(70, 110), 2) for _ in range(300)], step_s=1)
    rows += _series("cold", [round(rng.uniform(70, 110), 2) for _ in range(40)], start=1000, step_s=7)
    df = _m(spark, rows)
    fn = getattr(anomaly, method)
    a = {r.arrival: (r.n, r.is_anomaly, r.forecast) for r in fn(df, chunk_ms=5_000).collect()}
    b = {r.arrival: (r.n, r.is_anomaly, r.forecast) for r in fn(df, chunk_ms=10 ** 12).collect()}
    assert a == b


def test_balanced_chunks_give_the_same_flags(spark):
    rng = random.Random(21)
    rows = _series("HOT", [round(rng.uniform(70, 110), 2) for _ in range(400)], step_s=1)
    rows += _series("cold", [round(rng.uniform(70, 110), 2) for _ in range(30)], start=1000, step_s=11)
    rows.append((5000, "race", rows[100][2], "HOT", 88.8))                 # a peer of row 100
    df = _m(spark, rows)
    for fn in (anomaly.gaussian, anomaly.ar1):
        a = {r.arrival: (r.n, r.is_anomaly, r.forecast) for r in fn(df, chunk_rows=37).collect()}
        b = {r.arrival: (r.n, r.is_anomaly, r.forecast) for r in fn(df, chunk_ms=10 ** 12).collect()}
        assert a == b


@pytest.mark.parametrize("method", ["gaussian", "ar1"])
def test_general_doubles_against_plain_statistics(spark, method):
    """Small spread on a large value, NaN, infinity and null; chunks so small that each holds a few rows."""
    rng = random.Random(3)
    values = [1e9 + rng.gauss(0, 1e-3) for _ in range(120)]
    values[20], values[40], values[41], values[77] = math.nan, None, math.inf, 1e9 + 1
    rows = [(i, 1000 * i, "T", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "arrival long, ms long, team_name string, engine_temperature double").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.arrival: r for r in anomaly.detect(df, method, cents=False, chunk_ms=7000).collect()}
    clean = [v if v is not None and math.isfinite(v) else None for v in values]
    z, seen = anomaly.z_value(), 0
    for i, v in enumerate(clean):
        if method == "gaussian":
            past = [c - 1e9 for c in clean[:i] if c is not None]
            if len(past) < 16 or v is None:
                assert got[i].is_anomaly is None
                continue
            fc, half = statistics.fmean(past), z * statistics.stdev(past) * math.sqrt(1 + 1 / len(past))
        else:
            pairs = [(a - 1e9, b - 1e9) for a, b in zip(clean[:i], clean[1:i]) if a is not None and b is not None]
            if len(pairs) < 16 or v is None or clean[i - 1] is None:
                assert got[i].is_anomaly is None
                continue
            b, a = statistics.linear_regression(*zip(*pairs))
            sse = sum((y - a - b * x) ** 2 for x, y in pairs)
            fc, half = a + b * (clean[i - 1] - 1e9), z * math.sqrt(sse / (len(pairs) - 2))
        assert got[i].is_anomaly == (abs(v - 1e9 - fc) > half), i
        assert abs(got[i].forecast - 1e9 - fc) < 1e-3 * max(1.0, abs(fc))
        seen += 1
    assert seen > 90 and got[77].is_anomaly
