"""Registered streaming queries.

Each replays the events table as a file stream (the stand-in for the topic), runs the
streaming operator with ``availableNow`` into a sink in the shared checkpoint folder, and
returns the sink's current state as a DataFrame. The oracle for each is the batch
semantics (the stream must equal the batch operator on the same input).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall import schemas, sinks
from pitwall.operators import anomaly, commentary, leaderboard as lb
from pitwall.plans.catalog import RACE_SECONDS, ntz
from pitwall.sources import decode, tables, topics, views as V
from pitwall.streaming import alerts, anomaly as sanom, batches, fanout, leaderboard as slb, runner
from pitwall.streaming.upsert import UpsertTable


def _positions_stream(spark, sf):
    return V.positions_from(topics.table_stream(spark, sf, "events"), V.roster(spark, sf))


def stream_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    out, ck = runner.locations(spark, "leaderboard")
    runner.finish(slb.start_latest(_positions_stream(spark, sf), out, ck))
    state = sinks.read_upserted(spark, out, list(lb.KEYS), slb.LATEST_COLS)
    return ntz(lb.ranked(state))


def stream_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """G3 over several micro-batches of messages in arrival order, with any order inside a batch."""
    e = tables.load(spark, sf, "events")
    lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
    slot = F.floor((F.col("event_id") - F.lit(lo)) * REPLAY_SLOTS / F.lit((hi or 0) - (lo or 0) + 1))
    stream = V.positions_from(topics.replay(spark, e, slot, REPLAY_SLOTS, "positions"), V.roster(spark, sf))
    base, ck = runner.locations(spark, "bounded")
    keeper = slb.BoundedLists(spark, base)
    runner.finish(keeper.start(stream, ck))
    return ntz(keeper.lists())


ANOMALY_COLS = ["team_name", "engine_temperature", "is_anomaly", "arrival"]
#: The replay of the detector's input: batches, how much later than its event time a row may come, and the watermark.
REPLAY_SLOTS, JITTER_MS, SHORT_DELAY_MS = 4, 86_400_000, 6 * 3_600_000


def _shuffled(spark, sf):
    """Events in several batches, by event time plus a delay of up to a day that differs from row to row."""
    e = tables.load(spark, sf, "events")
    came = F.unix_millis("ts") + (F.col("event_id") * 7919) % JITTER_MS
    lo, hi = e.agg(F.min(came), F.max(came)).first()
    slot = F.floor((came - F.lit(lo)) * REPLAY_SLOTS / F.lit((hi or 0) - (lo or 0) + 1))
    return topics.replay(spark, e, slot, REPLAY_SLOTS, "events")


def _shuffled_metrics(spark, sf):
    return V.metrics_from(_shuffled(spark, sf), V.roster(spark, sf))


def _detector(spark, sf, method, delay_ms) -> sanom.Detector:
    base, ck = runner.locations(spark, f"anomaly-{method}")
    return sanom.run(sanom.Detector(spark, base, method, delay_ms), _shuffled_metrics(spark, sf), ck)


def _stream_anomaly(spark: SparkSession, sf: str, method: str) -> DataFrame:
    scored = _detector(spark, sf, method, JITTER_MS).scored()
    # the sink table holds flagged rows keyed by (key, ts at ms precision)
    flagged = scored.where(F.col("is_anomaly") == F.lit(True)).withColumn("ts", F.timestamp_millis("ts_ms"))
    return ntz(sinks.latest_per_key(flagged, ["key", "ts"], "arrival", ANOMALY_COLS).drop("arrival"))


def stream_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_anomaly(spark, sf, "gaussian")


def stream_anomaly_ar1(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_anomaly(spark, sf, "ar1")


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """H6: rows per team that came after a watermark of a quarter of the largest delay had passed them, and rows scored."""
    d = _detector(spark, sf, "gaussian", SHORT_DELAY_MS)
    both = d.late().select("team_name", F.lit(1).alias("late")).unionByName(d.scored().select("team_name", F.lit(0).alias("late")))
    return both.groupBy("team_name").agg(F.sum("late").cast("long").alias("late_rows"), F.sum(1 - F.col("late")).cast("long").alias("scored_rows"))


LAST_N = 7


def stream_last_n(spark: SparkSession, sf: str) -> DataFrame:
    """The last messages of every race, over batches that come out of order."""
    e = tables.load(spark, sf, "events")
    stream = V.positions_from(topics.replay(spark, e, F.pmod(F.xxhash64("event_id"), F.lit(REPLAY_SLOTS)), REPLAY_SLOTS, "last-n"), V.roster(spark, sf))
    base, ck = runner.locations(spark, "last-n")
    keeper = batches.LastN(spark, base, "race_id string, arrival long, driver_name string, position int", ["race_id"], ["arrival"], LAST_N)
    runner.finish(runner.start_foreach(stream, lambda batch, batch_id: keeper.process(batch, batch_id), ck, "append"))
    return keeper.rows()


#: A position of this value takes the driver out of the table.
RETIRED = 10
UPSERT_BUCKETS = 8


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K3: the current position of every (race, driver) in a table that merges, over batches out of order; a driver whose last message
    is ``RETIRED`` is removed."""
    e = tables.load(spark, sf, "events")
    stream = V.positions_from(topics.replay(spark, e, F.pmod(F.xxhash64("event_id"), F.lit(REPLAY_SLOTS)), REPLAY_SLOTS, "upsert"), V.roster(spark, sf))
    base, ck = runner.locations(spark, "upsert")
    table = UpsertTable(spark, base, "race_id string, driver_name string, arrival long, ts timestamp, position int, gone boolean", lb.KEYS,
                        "arrival", UPSERT_BUCKETS, max_deltas=2, deleted="gone")
    runner.finish(runner.start_foreach(stream.withColumn("gone", F.col("position") == RETIRED), table.process, ck, "append"))
    return ntz(table.read())


#: Every so many-th record of each topic of the log is cut short; every so many-th is a tombstone.
LOG_CUT, LOG_EMPTY = 11, 13
LOG_TOPICS = ("positions", "commentary", "anomalies")


def _log(spark: SparkSession, sf: str, race_alerts: DataFrame) -> DataFrame:
    """Positions, commentary and anomalies as records of one log, some of them damaged, plus a topic that nobody asked for."""
    positions = V.positions(spark, sf)
    said = commentary.generate(positions).withColumn("timestamp", F.col("timestamp").cast("double"))
    flags = race_alerts.select(F.col("key").cast("binary").alias("key"), F.to_json(F.struct("team_name", "engine_temperature", "is_anomaly")).alias("value"), "arrival")
    records = topics.log({
        "positions": decode.encode_positions(positions),
        "commentary": decode.encode_commentary(said.select("id", "message", "timestamp", "type", "arrival")),
        "anomalies": flags,
        "audit": decode.encode_metrics(V.metrics(spark, sf), "key", 0),
    })
    at = F.col("arrival")
    return records.withColumn("value", F.when(at % LOG_EMPTY == 0, F.lit(None)).when(at % LOG_CUT == 0, F.expr("left(value, length(value) - 1)"))
                              .otherwise(F.col("value")))


def _subscribed(spark: SparkSession, sf: str) -> tuple[fanout.Fanout, dict]:
    """The log replayed in batches into: the positions table, the commentary table, the alerts table, dead letters, unrouted."""
    roster = V.roster(spark, sf)
    flags = anomaly.flagged(anomaly.gaussian(V.metrics(spark, sf)))
    log = _log(spark, sf, flags)
    records = topics.replay(spark, log, F.pmod(F.xxhash64("topic", "arrival"), F.lit(REPLAY_SLOTS)), REPLAY_SLOTS, "log")
    base, ck = runner.locations(spark, "fanout")
    board = UpsertTable(spark, f"{base}/board", "race_id string, driver_name string, arrival long, ts timestamp, position int", lb.KEYS, "arrival", UPSERT_BUCKETS)
    comments = fanout.AppendTable(spark, f"{base}/comments", "id string, message string, ts timestamp, type string, arrival long")
    notices = fanout.AppendTable(spark, f"{base}/alerts", "arrival long, team_name string, driver_name string, metric_name string, metric_value double, "
                                                         "confidence_score double, severity string")
    same = lambda df: df
    # the consumer doesn't read the alert's time; its place in the log stands for it
    shaped = lambda df: anomaly.enrich(df.withColumn("ts_ms", F.col("arrival")), roster)
    both = fanout.Fanout(spark, base, [
        fanout.Route("positions", schemas.POSITION_WIRE, decode.positions, ((same, board),)),
        fanout.Route("commentary", schemas.COMMENTARY_WIRE, decode.commentary, ((same, comments),)),
        fanout.Route("anomalies", schemas.ANOMALY_WIRE, decode.anomalies, ((shaped, notices),)),
    ])
    runner.finish(both.start(records, ck))
    return both, {"board": board, "comments": comments, "alerts": notices}


def log_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Producer, topic, decoder, merged table, ranking."""
    return ntz(lb.ranked(_subscribed(spark, sf)[1]["board"].read()))


def log_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Detector, topic, decoder, enrichment and severity, alerts table."""
    return _subscribed(spark, sf)[1]["alerts"].read()


def log_commentary(spark: SparkSession, sf: str) -> DataFrame:
    """Generation, topic, decoder with its null rules, commentary table, first message of an id."""
    return ntz(commentary.dedupe(_subscribed(spark, sf)[1]["comments"].read()))


def log_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """A7 and A3 for the whole subscription: records that couldn't be parsed, and those that nobody asked for, by topic."""
    both, _ = _subscribed(spark, sf)
    dead = both.dead.read().select("topic", F.lit("dead").alias("kind"), "arrival")
    other = both.unrouted.read().select("topic", F.lit("unrouted").alias("kind"), "arrival")
    return dead.unionByName(other).groupBy("topic", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))


def stream_avg_speed(spark: SparkSession, sf: str) -> DataFrame:
    """G7 running: average speed per (race, driver) as an update-mode aggregation, upserted
    per micro-batch; the final state equals the batch average."""
    out, ck = runner.locations(spark, "avg-speed")
    agg = (_positions_stream(spark, sf).groupBy(*lb.KEYS)
           .agg(F.count("speed").alias("n"), F.sum(lb.cents("speed")).alias("_s")))
    runner.finish(runner.start_foreach(agg, sinks.upsert_batch(out, list(lb.KEYS), "n", ["n", "_s"]), ck, "update"))
    state = sinks.read_upserted(spark, out, list(lb.KEYS), ["n", "_s"])
    return state.select(*lb.KEYS, "n", (F.col("_s").cast("double") / F.col("n").cast("double") / 100.0)
                        .alias("avg_speed"))


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    out, ck = runner.locations(spark, "dedupe")
    gen = commentary.generate(_positions_stream(spark, sf)).withColumn("ts", F.timestamp_millis("timestamp"))
    d = alerts.dedupe(gen, ["id"], "ts")
    runner.finish(runner.start_files(d.select("id", "driver_name"), out, ck))
    return spark.read.parquet(out)


#: Messages of a race go on long after its end in the given tables: a year of event time before a finished race is forgotten.
LIFECYCLE_KEEP_S = 366 * 86_400


def stream_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    out, ck = runner.locations(spark, "lifecycle")
    rows = V.positions_from(_shuffled(spark, sf), V.roster(spark, sf))
    lc = alerts.lifecycle(rows, RACE_SECONDS, f"{JITTER_MS} milliseconds", settled=True, evict_after_s=LIFECYCLE_KEEP_S)
    runner.finish(runner.start_files(lc, out, ck))
    return ntz(spark.read.parquet(out))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in [stream_leaderboard, stream_bounded, stream_anomaly, stream_anomaly_ar1, stream_late_rows, stream_last_n,
                            stream_upsert, log_leaderboard, log_alerts, log_commentary, log_dead_letters,
                            stream_avg_speed, stream_dedupe, stream_lifecycle]
}
