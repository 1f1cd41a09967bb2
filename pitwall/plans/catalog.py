"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the given tables (through ``pitwall.sources.views``) in full. Output
timestamps are TIMESTAMP_NTZ (UTC wall clock) so results compare across engines.
Parameters (selected driver, as-of instants, race length) are fixed per query below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall import schemas, sinks
from pitwall.operators import anomaly, capped, commentary, dims, index, leaderboard as lb, races, vector, ai
from pitwall.session import scratch_path
from pitwall.sources import decode, views as V

# --- Query parameters --------------------------------------------------------------------
SNAPSHOT_RACE = "click"
SELECTED_DRIVER = "NATION_7"
RESULT_DRIVER = "NATION_3"
MENTION_DRIVER = "NATION_2"
#: A name of three words: only its first and last one must be in the message.
MENTION_LONG_NAME = "Nation_1 Middle RUNNING"
RACE_SECONDS = 600
STATUS_ASOF = "2024-01-01 00:10:00"
EVICT_ASOF = "2024-01-01 01:12:00"
METRICS_ASOF_MS = 1_704_067_200_000          # 2024-01-01T00:00:00Z, stands in for "now"
TOP_K = 5
# -----------------------------------------------------------------------------------------


def ntz(df: DataFrame) -> DataFrame:
    """Cast TIMESTAMP columns to TIMESTAMP_NTZ (UTC session zone) for output."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                       for f in df.schema.fields])


def _pos(spark, sf):
    return V.positions(spark, sf)


def _bounded(spark, sf):
    return lb.bounded(_pos(spark, sf))


#: The first snapshot was seen after this offset.
BASELINE_SEEN = 60
#: So few offsets a chunk that starting lists are guessed wrong and mended.
REPAIR_CHUNK = 100


def _race_df(spark, sf):
    return races.races(_pos(spark, sf), RACE_SECONDS)


def _gauss(spark, sf):
    return anomaly.gaussian(V.metrics(spark, sf))


def _public(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def _enriched(spark, sf):
    return anomaly.enrich(anomaly.flagged(_gauss(spark, sf)), V.roster(spark, sf))


def _generated(spark, sf):
    return commentary.generate(_pos(spark, sf))


def _decoded_comments(spark, sf):
    return decode.commentary(decode.encode_commentary(V.comments(spark, sf)))


def _requests(spark, sf):
    e = V.load(spark, sf, "events").select("event_id", "props")
    return e.select(F.col("event_id").alias("request_id"),
                    F.concat(F.lit("NATION_"), F.get_json_object("props", "$.k")).alias("driver_name"))


# --- queries -------------------------------------------------------------------------------

def positions_decode(spark, sf):
    return ntz(decode.positions(decode.encode_positions(_pos(spark, sf))))


def _damaged(spark, sf):
    """The whole position topic, with tombstones, cut JSON and empty values among its records."""
    kind = F.col("arrival") % 7
    return decode.encode_positions(_pos(spark, sf)).withColumn(
        "value", F.when(kind == 0, F.lit(None)).when(kind == 1, F.concat(F.lit('{"driver_name": "cut'), F.col("arrival")))
        .when(kind == 2, F.lit("")).otherwise(F.col("value")))


def positions_decode_damaged(spark, sf):
    return ntz(decode.positions(_damaged(spark, sf)))


def decode_dead_letters(spark, sf):
    return decode.dead_letters(_damaged(spark, sf), schemas.POSITION_WIRE).select("key", "value", "arrival")


#: The schema id of framed records grows by one every so many; every so many-th record has another first byte.
FRAME_IDS, FRAME_BROKEN = 1000, 9


def _framed(spark, sf):
    """The position topic as a schema registry's clients write it, some records with a header that is none."""
    wire = decode.framed(decode.encode_positions(_pos(spark, sf)), 70_000 + F.floor(F.col("arrival") / FRAME_IDS))
    broken = F.concat(F.unhex(F.lit("01")), F.substring("value", 2, 2_147_483_647))
    return decode.unframed(wire.withColumn("value", F.when(F.col("arrival") % FRAME_BROKEN == 0, broken).otherwise(F.col("value"))))


def positions_decode_framed(spark, sf):
    return ntz(decode.positions(_framed(spark, sf)[0]))


def decode_broken_frames(spark, sf):
    return _framed(spark, sf)[1].select(F.col("key").cast("string").alias("key"), "arrival", F.octet_length("value").alias("n_bytes"))


def metrics_decode(spark, sf):
    return ntz(decode.metrics(decode.encode_metrics(V.metrics(spark, sf), "key", METRICS_ASOF_MS)))


def leaderboard_latest(spark, sf):
    return ntz(lb.ranked(lb.latest(_pos(spark, sf))))


def leaderboard_snapshot_race(spark, sf):
    return ntz(lb.snapshot(lb.ranked(lb.latest(_pos(spark, sf))), SNAPSHOT_RACE))


def leaderboard_no_race(spark, sf):
    return ntz(lb.snapshot(lb.ranked(lb.latest(_pos(spark, sf))), None))


def leaderboard_bounded10(spark, sf):
    return ntz(_bounded(spark, sf))


def leaderboard_bounded_repair(spark, sf):
    """G3 in chunks of a few messages a race, so that repair has to run."""
    return ntz(lb.bounded(_pos(spark, sf), chunk_offsets=REPAIR_CHUNK))


def leaderboard_list_log(spark, sf):
    """K7: the whole list after every message."""
    log = capped.list_log(_pos(spark, sf))
    return log.select("race_id", "arrival", "driver_name", F.concat_ws(">", "slots").alias("slots"))


def leaderboard_enriched(spark, sf):
    return ntz(lb.enrich(lb.ranked(_bounded(spark, sf)), V.roster(spark, sf), SELECTED_DRIVER))


def position_changes(spark, sf):
    return ntz(lb.changes(_pos(spark, sf)))


def baseline_delta(spark, sf):
    return lb.baseline_delta(_pos(spark, sf), BASELINE_SEEN)


def _final(spark, sf):
    done = races.finished(races.status(_race_df(spark, sf), EVICT_ASOF))
    return lb.final_positions(_bounded(spark, sf), done)


def final_positions(spark, sf):
    return ntz(_final(spark, sf))


def race_winner(spark, sf):
    return ntz(lb.winner(_final(spark, sf)))


def driver_result(spark, sf):
    return ntz(lb.driver_result(_final(spark, sf), RESULT_DRIVER))


def race_status(spark, sf):
    return ntz(races.status(_race_df(spark, sf), STATUS_ASOF))


def races_evicted(spark, sf):
    return ntz(races.evicted(races.status(_race_df(spark, sf), EVICT_ASOF), EVICT_ASOF))


def race_lifecycle(spark, sf):
    return ntz(races.lifecycle(_race_df(spark, sf)))


def race_lap(spark, sf):
    p = _pos(spark, sf)
    return races.laps(p, races.races(p, RACE_SECONDS))


def race_history(spark, sf):
    p = _pos(spark, sf)
    return ntz(races.history(p, races.races(p, RACE_SECONDS)))


def driver_validate_semi(spark, sf):
    return races.validate(_requests(spark, sf), V.roster(spark, sf))[0]


def driver_validate_anti(spark, sf):
    return races.validate(_requests(spark, sf), V.roster(spark, sf))[1]


def avg_speed(spark, sf):
    return lb.avg_speed(_pos(spark, sf))


def avg_speed_tumbling(spark, sf):
    return lb.avg_speed_tumbling(_pos(spark, sf))


def anomaly_gaussian(spark, sf):
    return ntz(_public(anomaly.flagged(_gauss(spark, sf))))


def anomaly_ar1(spark, sf):
    return ntz(_public(anomaly.flagged(anomaly.ar1(V.metrics(spark, sf)))))


#: A measure whose values have all the digits of a double.
REAL_DIVISOR = 7.0


def _real(spark, sf, method):
    m = V.metrics(spark, sf).withColumn("engine_temperature", F.col("engine_temperature") / REAL_DIVISOR)
    d = anomaly.flagged(anomaly.detect(m, method, cents=False))
    return d.select("arrival", "team_name", "ts_ms", "n", *[F.round(c, 6).alias(c) for c in ("engine_temperature", "forecast", "lower", "upper")])


def anomaly_gaussian_real(spark, sf):
    """W1 over general doubles: nothing is rounded but the output's last digits."""
    return _real(spark, sf, "gaussian")


def anomaly_ar1_real(spark, sf):
    return _real(spark, sf, "ar1")


def anomaly_enriched(spark, sf):
    return ntz(_enriched(spark, sf))


def anomaly_severity(spark, sf):
    d = anomaly.real_confidence(_gauss(spark, sf)).where(F.col("forecast").isNotNull())
    return ntz(anomaly.enrich(d, V.roster(spark, sf), confidence_col="confidence_score"))


def anomaly_recent100(spark, sf):
    return ntz(anomaly.recent(_enriched(spark, sf), 100))


def anomaly_last20(spark, sf):
    return ntz(anomaly.last_n_oldest_first(_enriched(spark, sf), 20))


def anomaly_dedupe(spark, sf):
    return ntz(anomaly.dedupe(_enriched(spark, sf)))


def anomaly_feed50(spark, sf):
    """The alert feed: deduplicated, newest first, capped at 50."""
    return ntz(anomaly.recent(anomaly.dedupe(_enriched(spark, sf)), 50))


def teams_distinct(spark, sf):
    return dims.teams(V.metrics(spark, sf))


def team_lead(spark, sf):
    ro = V.roster(spark, sf)
    seen = _pos(spark, sf).select(F.col("driver_name").alias("name")).distinct()
    return dims.team_lead(ro.join(seen, "name", "left_semi"))


def commentary_generate(spark, sf):
    return _generated(spark, sf)


def commentary_decode(spark, sf):
    return ntz(_decoded_comments(spark, sf))


def commentary_mentions_long_name(spark, sf):
    """B13 for a name of several words, of which the messages hold the first and the last."""
    return commentary.with_mentions(_generated(spark, sf), MENTION_LONG_NAME)


def commentary_mentions(spark, sf):
    return commentary.with_mentions(_generated(spark, sf), MENTION_DRIVER)


def commentary_recent50(spark, sf):
    return ntz(commentary.recent(_decoded_comments(spark, sf), 50, order=("conv_id", "turn")))


def commentary_dedupe(spark, sf):
    return commentary.dedupe(_generated(spark, sf))


def commentary_feed50(spark, sf):
    """The commentary feed: deduplicated by id, newest first, capped at 50."""
    return commentary.recent(commentary.dedupe(_generated(spark, sf)), 50)


def envelope_json(spark, sf):
    env = sinks.envelope(_enriched(spark, sf), "anomaly", sinks.anomaly_envelope_fields())
    return sinks.parse_envelope(env, sinks.ANOMALY_ENVELOPE_SCHEMA)


def commentary_envelope(spark, sf):
    env = sinks.envelope(_decoded_comments(spark, sf), "commentary", sinks.commentary_envelope_fields())
    return sinks.parse_envelope(env, sinks.COMMENTARY_ENVELOPE_SCHEMA)


def upsert_latest(spark, sf):
    d = _gauss(spark, sf).where(F.col("forecast").isNotNull())
    return ntz(sinks.latest_per_key(d.withColumn("ts", F.timestamp_millis("ts_ms")),
                                    ["key", "ts"], "arrival",
                                    ["team_name", "engine_temperature", "is_anomaly"]))


def embed_queries(spark, sf):
    """The components that aren't zero of every message's embedding."""
    c = V.load(spark, sf, "conversations").select("conv_id", "turn", "text")
    e = ai.embed(c, "text").select("conv_id", "turn", F.posexplode("embedding").alias("dim", "value"))
    return e.where("value > 0").withColumn("value", F.round(F.col("value").cast("double"), 6))


def text_search_topk(spark, sf):
    """The five messages of all conversations nearest to every benchmark passage, with their text."""
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    messages = V.load(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("vec_id"), F.col("text").alias("message"))
    return vector.text_search(queries, messages, TOP_K)


def _topk(spark, sf):
    corpus = V.corpus(spark, sf)
    return vector.top_k(vector.centroids(corpus), corpus, TOP_K)


def vector_topk(spark, sf):
    return _topk(spark, sf)


def vector_topk_limit5(spark, sf):
    return vector.limit_overall(_topk(spark, sf), 5)


#: Every so many-th vector is a query; the share of exact neighbours that the index is set up to find.
INDEX_EVERY, INDEX_TARGET = 50, 0.95


def vector_topk_indexed(spark, sf):
    """A10: the nearest vectors by a stored index, probed for as many candidates as the wanted recall asks for."""
    corpus = V.corpus(spark, sf)
    queries = corpus.where(F.col("vec_id") % INDEX_EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    built = index.Index.build(corpus, scratch_path(spark, "indexes", f"vectors-{uuid.uuid4().hex}"))
    return built.search(queries, TOP_K, built.candidates_for(queries, TOP_K, INDEX_TARGET))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in [
        positions_decode, positions_decode_damaged, decode_dead_letters, positions_decode_framed, decode_broken_frames, metrics_decode, leaderboard_latest, leaderboard_snapshot_race,
        leaderboard_no_race, leaderboard_bounded10, leaderboard_bounded_repair, leaderboard_list_log, leaderboard_enriched, position_changes,
        baseline_delta, final_positions, race_winner, driver_result, race_status,
        races_evicted, race_lifecycle, race_lap, race_history, driver_validate_semi,
        driver_validate_anti, avg_speed, avg_speed_tumbling, anomaly_gaussian, anomaly_ar1,
        anomaly_gaussian_real, anomaly_ar1_real, anomaly_enriched, anomaly_severity, anomaly_recent100, anomaly_last20, anomaly_dedupe,
        anomaly_feed50, teams_distinct, team_lead, commentary_generate, commentary_decode,
        commentary_mentions, commentary_mentions_long_name, commentary_recent50, commentary_dedupe, commentary_feed50,
        envelope_json, commentary_envelope, upsert_latest, embed_queries, vector_topk,
        vector_topk_limit5, text_search_topk, vector_topk_indexed,
    ]
}
