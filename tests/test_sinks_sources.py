"""Sources and sinks not covered elsewhere: anomaly decode, SQL views, inline queries,
JSON append sink, last-n-per-key, change callback, envelopes."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pitwall import sinks
from pitwall.operators import vector
from pitwall.sources import decode, topics, views
from pitwall.streaming import runner

SF = "/root/testdata/sf0.001"


def test_decode_anomalies_ignores_key(spark):
    df = spark.createDataFrame([
        (b"k1", '{"team_name":"Lyra","engine_temperature":130.5,"is_anomaly":true}'),
        (b"k2", '{"team_name":null,"engine_temperature":null,"is_anomaly":null}'),
        (b"k3", None),
    ], "key binary, value string")
    out = decode.anomalies(df).collect()
    assert [(r.team_name, r.engine_temperature, r.is_anomaly) for r in out] == [
        ("Lyra", 130.5, True), (None, None, None)]
    assert "key" not in decode.anomalies(df).columns


def test_sql_views_and_demux(spark):
    views.register_views(spark, SF)
    n = spark.sql("SELECT count(*) AS n FROM positions WHERE race_id IS NULL").collect()[0].n
    assert n == spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'signup'").count()
    frames = spark.createDataFrame([("a", 1), ("b", 2)], "topic string, offset long")
    assert [r.offset for r in topics.demux(frames, "b").collect()] == [2]
    assert topics.subscribed_topics("p", "c", "a") == ["p", "c"]
    assert topics.subscribed_topics("p", "c", None, anomalies_enabled=True) == ["p", "c"]
    assert topics.subscribed_topics("p", "c", "a", anomalies_enabled=True) == ["p", "c", "a"]
    opts = topics.kafka_options("broker:9092", ["positions", "commentary"], max_offsets_per_trigger=500)
    assert opts["subscribe"] == "positions,commentary" and opts["startingOffsets"] == "latest"


def test_inline_queries(spark):
    q = vector.queries_from(spark, [("Comments about a driver",)])
    assert q.columns == ["query"] and q.count() == 1
    qv = vector.queries_from(spark, [("q1", [1.0, 0.0])], with_vectors=True)
    assert qv.schema["vector"].dataType.simpleString() == "array<double>"


def test_append_json_sink(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    spark.createDataFrame([("c1", "m", 1, "info")], "id string, message string, timestamp long, type string") \
        .write.parquet(src)
    s = topics.files_stream(spark, src, spark.read.parquet(src).schema)
    runner.finish(sinks.append_json(s, f"{tmp_dir}/out", f"{tmp_dir}/ck"))
    got = spark.read.json(f"{tmp_dir}/out").collect()
    assert [(r.id, r.type) for r in got] == [("c1", "info")]


def test_bounded_history_and_callback(spark):
    df = spark.createDataFrame([("k", i) for i in range(7)] + [("j", 1)], "key string, arrival long")
    got = sorted((r.key, r.arrival) for r in sinks.bounded_history(df, ["key"], ["arrival"], 3).collect())
    assert got == [("j", 1), ("k", 4), ("k", 5), ("k", 6)]
    seen = []
    sinks.on_update(lambda b, i: seen.append((b.count(), i)))(df, 7)
    assert seen == [(8, 7)]


def test_commentary_envelope_roundtrip(spark):
    df = spark.createDataFrame([("c1", "hello", dt.datetime(2024, 1, 1, 0, 0, 1, 500000), None)],
                               "id string, message string, ts timestamp, type string")
    env = sinks.envelope(df, "commentary", sinks.commentary_envelope_fields())
    msg = json.loads(env.collect()[0].message)
    assert msg == {"type": "commentary", "data": {"id": "c1", "message": "hello",
                                                  "timestamp": "2024-01-01T00:00:01.500000", "type": "info"}}
    back = sinks.parse_envelope(env, sinks.COMMENTARY_ENVELOPE_SCHEMA).collect()[0]
    assert back.kind == "commentary" and back.type == "info"


def test_encode_metrics_defaults_and_roundtrip(spark):
    df = spark.createDataFrame([
        ("race-1", "Lyra", dt.datetime(2024, 1, 1, 0, 0, 0, 250000), 91.5, 1),
        ("race-1", None, None, None, 2),
    ], "key string, team_name string, ts timestamp, engine_temperature double, arrival long")
    wire = decode.encode_metrics(df, "key", asof_ms=1_704_067_200_000)
    vals = {r.arrival: json.loads(r.value) for r in wire.collect()}
    assert vals[2] == {"team_name": "", "timestamp": 1_704_067_200_000, "engine_temperature": 0.0}
    back = {r.arrival: r for r in decode.metrics(wire).collect()}
    assert back[1].key == "race-1" and back[1].ts == dt.datetime(2024, 1, 1, 0, 0, 0, 250000)
    assert back[2].team_name == "" and back[2].engine_temperature == 0.0


def test_registry_frames(spark):
    from pitwall.sources import decode
    rows = [("a", '{"x":1}', 1), ("b", None, 2), ("c", "", 3), ("d", "é" * 50_000, 4)]
    df = spark.createDataFrame(rows, "key string, value string, arrival long")
    good, bad = decode.unframed(decode.framed(df, F.lit(70_001)))
    got = {r.arrival: (r.schema_id, None if r.value is None else bytes(r.value).decode()) for r in good.collect()}
    assert got == {1: (70_001, '{"x":1}'), 2: (None, None), 3: (70_001, ""), 4: (70_001, "é" * 50_000)} and bad.count() == 0
    raw = [(bytearray(b"\x01\x00\x00\x00\x01x"), 1), (bytearray(b"\x00\x00\x00"), 2), (bytearray(b""), 3), (bytearray(b"\x00\xff\xff\xff\xff"), 4)]
    good, bad = decode.unframed(spark.createDataFrame(raw, "value binary, arrival long"))
    assert [(r.schema_id, bytes(r.value)) for r in good.collect()] == [(2**32 - 1, b"")]
    assert sorted(r.arrival for r in bad.collect()) == [1, 2, 3]
