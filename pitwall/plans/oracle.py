"""DuckDB SQL for each registered query (the correctness oracle).

The shared CTEs restate the view mapping of ``pitwall.sources.views`` in SQL. Column
names and types are aliased to match the Spark results.
"""

from __future__ import annotations

from pitwall.plans import catalog as C, streams as S
from pitwall.operators.anomaly import z_value

Z = repr(z_value())

ROSTER = """roster AS (
  SELECT n.n_nationkey AS id, n.n_name AS name, r.r_name AS team,
         '#' || substr(md5(r.r_name), 1, 6) AS team_color
  FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey)"""

POSITIONS = ROSTER + """,
positions AS (
  SELECT e.event_id AS arrival, CAST(e.ts AS TIMESTAMP) AS ts,
         CASE WHEN e.event_type <> 'signup' THEN e.event_type END AS race_id,
         ro.name AS driver_name, CAST(e.event_id % 10 + 1 AS INTEGER) AS position,
         ro.team AS team_name, e.value AS speed
  FROM events e JOIN roster ro ON ro.id = e.user_id % 25)"""

METRICS = ROSTER + """,
metrics AS (
  SELECT e.event_id AS arrival, e.event_type AS key, CAST(e.ts AS TIMESTAMP) AS ts,
         ro.team AS team_name, e.value AS engine_temperature
  FROM events e JOIN roster ro ON ro.id = e.user_id % 25)"""

MS = "make_timestamp((epoch_us({c}) // 1000) * 1000)"

LATEST = """latest AS (
  SELECT race_id, driver_name, arrival, ts, position, team_name, speed FROM positions
  QUALIFY row_number() OVER (PARTITION BY race_id, driver_name ORDER BY arrival DESC) = 1)"""

RANKED = """ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY race_id ORDER BY position, driver_name) AS INTEGER) AS rank
  FROM latest)"""

BOUNDED = """seq AS (
  SELECT race_id, driver_name, arrival,
         dense_rank() OVER (ORDER BY race_id NULLS FIRST) AS g,
         row_number() OVER (PARTITION BY race_id ORDER BY arrival) AS i
  FROM positions),
fold(g, i, slots) AS (
  SELECT g, i, [driver_name] FROM seq WHERE i = 1
  UNION ALL
  SELECT s.g, s.i,
         CASE WHEN list_contains(f.slots, s.driver_name) THEN f.slots
              WHEN len(f.slots) >= 10 THEN list_append(f.slots[2:], s.driver_name)
              ELSE list_append(f.slots, s.driver_name) END
  FROM fold f JOIN seq s ON s.g = f.g AND s.i = f.i + 1),
fin AS (SELECT g, slots FROM fold QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1),
mem AS (SELECT g, unnest(slots) AS driver_name, generate_subscripts(slots, 1) AS slot FROM fin),
grp AS (SELECT DISTINCT g, race_id FROM seq),
bounded AS (
  SELECT grp.race_id, mem.driver_name, CAST(mem.slot AS INTEGER) AS slot,
         l.arrival, l.ts, l.position, l.team_name, l.speed
  FROM mem JOIN grp USING (g)
  JOIN latest l ON l.race_id IS NOT DISTINCT FROM grp.race_id AND l.driver_name = mem.driver_name)"""

FINAL = """final AS (
  SELECT *,
    (count(*) OVER w = 10 AND min(CASE WHEN position BETWEEN 1 AND 10 THEN 1 ELSE 0 END) OVER w = 1) AS valid,
    (count(*) OVER w = 10 AND min(CASE WHEN position BETWEEN 1 AND 10 THEN 1 ELSE 0 END) OVER w = 1
       AND count(DISTINCT position) OVER w = 10) AS valid_strict,
    CAST(row_number() OVER (PARTITION BY race_id ORDER BY position, driver_name) AS INTEGER) AS rank
  FROM bounded WHERE race_id IN (SELECT race_id FROM status WHERE status = 'finished')
  WINDOW w AS (PARTITION BY race_id))"""

RACES = """races AS (
  SELECT race_id, arg_min(driver_name, arrival) AS selected_driver, min(ts) AS start_time,
         min(ts) + INTERVAL {secs} SECOND AS end_time, CAST({secs} AS INTEGER) AS duration
  FROM positions WHERE race_id IS NOT NULL GROUP BY race_id)""".format(secs=C.RACE_SECONDS)


def _status(asof: str) -> str:
    now = f"TIMESTAMP '{asof}'"
    el = (f"CASE WHEN {now} < start_time THEN CAST(0.0 AS DOUBLE) "
          f"ELSE CAST(epoch_us({now}) - epoch_us(start_time) AS DOUBLE) / 1000000.0 END")
    return f"""st0 AS (SELECT *, {el} AS elapsed_s FROM races),
st1 AS (SELECT *, CASE WHEN start_time IS NULL OR {now} < start_time THEN 'not_started'
                       WHEN elapsed_s >= duration THEN 'finished' ELSE 'in_progress' END AS status FROM st0),
status AS (
  SELECT race_id, selected_driver, status,
         CASE WHEN status = 'not_started' THEN CAST(0.0 AS DOUBLE) WHEN status = 'finished' THEN CAST(1.0 AS DOUBLE)
              ELSE least(CAST(1.0 AS DOUBLE), elapsed_s / CAST(duration AS DOUBLE)) END AS progress,
         elapsed_s, greatest(CAST(0.0 AS DOUBLE), CAST(duration AS DOUBLE) - elapsed_s) AS remaining_s,
         duration, start_time, end_time
  FROM st1)"""


def _gauss_cte() -> str:
    return METRICS + f""",
gd AS (SELECT *, (epoch_us(ts) // 1000) AS ts_ms, CAST(ROUND(engine_temperature * 100) AS BIGINT) AS v FROM metrics),
gw AS (SELECT *, count(v) OVER w AS n, coalesce(sum(v) OVER w, 0) AS s1, coalesce(sum(v * v) OVER w, 0) AS s2
       FROM gd WINDOW w AS (PARTITION BY team_name ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gm AS (SELECT *, CAST(s1 AS DOUBLE) / CAST(n AS DOUBLE) AS mean_c,
              '{Z}'::DOUBLE * sqrt(CAST(n * s2 - s1 * s1 AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE))
                * sqrt(1.0::DOUBLE + 1.0::DOUBLE / CAST(n AS DOUBLE)) AS half_c
       FROM gw WHERE n >= 16),
gauss AS (
  SELECT arrival, key, ts, team_name, engine_temperature, ts_ms, CAST(n AS BIGINT) AS n,
         mean_c / 100.0::DOUBLE AS forecast, (mean_c - half_c) / 100.0::DOUBLE AS lower,
         (mean_c + half_c) / 100.0::DOUBLE AS upper,
         CASE WHEN v IS NULL THEN NULL ELSE (CAST(v AS DOUBLE) < mean_c - half_c OR CAST(v AS DOUBLE) > mean_c + half_c) END AS is_anomaly,
         CASE WHEN v IS NULL THEN NULL ELSE abs(CAST(v AS DOUBLE) - mean_c) END AS dev_c, half_c
  FROM gm
  UNION ALL
  SELECT arrival, key, ts, team_name, engine_temperature, ts_ms, CAST(n AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL
  FROM gw WHERE n < 16)"""


def _ar1_cte() -> str:
    return METRICS + f""",
ad AS (SELECT *, (epoch_us(ts) // 1000) AS ts_ms, CAST(ROUND(engine_temperature * 100) AS BIGINT) AS y FROM metrics),
al AS (SELECT *, lag(y) OVER (PARTITION BY team_name ORDER BY ts_ms, arrival) AS x FROM ad),
ap AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 ELSE 0 END AS ok FROM al),
aw AS (SELECT *,
         coalesce(sum(ok) OVER w, 0) AS n,
         coalesce(sum(CASE WHEN ok = 1 THEN x ELSE 0 END) OVER w, 0) AS sx,
         coalesce(sum(CASE WHEN ok = 1 THEN y ELSE 0 END) OVER w, 0) AS sy,
         coalesce(sum(CASE WHEN ok = 1 THEN x * x ELSE 0 END) OVER w, 0) AS sxx,
         coalesce(sum(CASE WHEN ok = 1 THEN y * y ELSE 0 END) OVER w, 0) AS syy,
         coalesce(sum(CASE WHEN ok = 1 THEN x * y ELSE 0 END) OVER w, 0) AS sxy
       FROM ap WINDOW w AS (PARTITION BY team_name ORDER BY ts_ms, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ab AS (SELECT *, n * sxx - sx * sx AS dxx, n * sxy - sx * sy AS dxy, n * syy - sy * sy AS dyy FROM aw WHERE n >= 16 AND x IS NOT NULL),
ac AS (SELECT *, CASE WHEN dxx = 0 THEN 0.0::DOUBLE ELSE CAST(dxy AS DOUBLE) / CAST(dxx AS DOUBLE) END AS b FROM ab),
ae AS (SELECT *, (CAST(sy AS DOUBLE) - b * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS a,
              (CAST(dyy AS DOUBLE) - b * CAST(dxy AS DOUBLE)) / CAST(n AS DOUBLE) AS sse FROM ac),
af AS (SELECT *, a + b * CAST(x AS DOUBLE) AS fc,
              '{Z}'::DOUBLE * sqrt(greatest(sse, 0.0::DOUBLE) / (CAST(n AS DOUBLE) - 2.0::DOUBLE)) AS half_c FROM ae),
ar1 AS (
  SELECT arrival, key, ts, team_name, engine_temperature, ts_ms, CAST(n AS BIGINT) AS n,
         fc / 100.0::DOUBLE AS forecast, (fc - half_c) / 100.0::DOUBLE AS lower, (fc + half_c) / 100.0::DOUBLE AS upper,
         CASE WHEN y IS NULL THEN NULL ELSE (CAST(y AS DOUBLE) < fc - half_c OR CAST(y AS DOUBLE) > fc + half_c) END AS is_anomaly
  FROM af)"""


GAUSS_COLS = "arrival, key, ts, team_name, engine_temperature, ts_ms, n, forecast, lower, upper, is_anomaly"

ENRICH = """leads AS (SELECT team, arg_min(name, id) AS lead_driver FROM roster GROUP BY team),
enriched AS (
  SELECT {cols}, coalesce(l.lead_driver, g.team_name) AS driver_name, g.ts_ms AS timestamp,
         'Engine Temperature' AS metric_name, coalesce(g.engine_temperature, 0.0::DOUBLE) AS metric_value,
         {conf} AS confidence_score
  FROM {src} g LEFT JOIN leads l ON l.team = g.team_name),
alerts AS (
  SELECT *, CASE
      WHEN coalesce(confidence_score, 0.0) > 0.95 THEN
        CASE WHEN coalesce(lower(metric_name), '') LIKE '%temperature%' THEN
               CASE WHEN coalesce(metric_value, 0.0) > 120 OR coalesce(metric_value, 0.0) < 60 THEN 'critical' ELSE 'warning' END
             WHEN coalesce(lower(metric_name), '') LIKE '%pressure%' THEN
               CASE WHEN coalesce(metric_value, 0.0) > 2.5 OR coalesce(metric_value, 0.0) < 1.5 THEN 'critical' ELSE 'warning' END
             ELSE 'warning' END
      WHEN coalesce(confidence_score, 0.0) > 0.90 THEN 'warning' ELSE 'info' END AS severity
  FROM enriched)"""

FLAG_CONF = "CASE WHEN g.is_anomaly THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END"
REAL_CONF = """CASE WHEN g.dev_c IS NULL OR g.half_c IS NULL THEN NULL WHEN g.dev_c = 0 THEN 0.0::DOUBLE
       WHEN g.half_c = 0 THEN 0.999::DOUBLE
       ELSE greatest(0.0::DOUBLE, least(0.999::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * g.half_c / g.dev_c)) END"""


def _gcols(prefix: str = "g.") -> str:
    return ", ".join(prefix + c for c in GAUSS_COLS.split(", "))


def _alerts_flagged() -> str:
    return "WITH " + _gauss_cte() + ",\nflag AS (SELECT * FROM gauss WHERE is_anomaly = TRUE),\n" + \
        ENRICH.format(cols=_gcols(), conf=FLAG_CONF, src="flag")


ALERT_COLS = GAUSS_COLS + ", driver_name, timestamp, metric_name, metric_value, confidence_score, severity"

COMMENTS = """comments AS (
  SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text AS message,
         CAST(conv_id * 1000 + turn AS DOUBLE) AS timestamp,
         CASE WHEN role = 'system' THEN 'highlight' WHEN role = 'assistant' THEN 'warning' END AS type
  FROM conversations),
decoded AS (
  SELECT id, message, make_timestamp(CAST(timestamp AS BIGINT) * 1000) AS ts, coalesce(type, 'info') AS type, conv_id, turn
  FROM comments WHERE id IS NOT NULL AND message IS NOT NULL AND timestamp IS NOT NULL)"""

GENERATED = """generated AS (
  SELECT 'comment-' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '-' || replace(driver_name, ' ', '_') AS id,
         left(split_part(split_part(p, ', Position: ', 1), 'Driver: ', 2) || ' is running P'
              || split_part(split_part(p, ', Position: ', 2), '.', 1) || '!', 80) AS message,
         (epoch_us(ts) // 1000) AS timestamp,
         CASE WHEN position = 1 THEN 'highlight' WHEN position <= 3 THEN 'warning' ELSE 'info' END AS type,
         arrival, race_id, driver_name
  FROM (SELECT *, 'Driver: ' || driver_name || ', Position: ' || CAST(position AS VARCHAR)
                  || '. Generate exciting F1 commentary. Keep it under 80 characters.' AS p FROM positions))"""

REQUESTS = """requests AS (
  SELECT event_id AS request_id, 'NATION_' || json_extract_string(props, '$.k') AS driver_name FROM events)"""

CENTROIDS = """cq AS (
  SELECT label, i, CAST(sum(CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT)) AS DOUBLE)
                   / CAST(count(*) AS DOUBLE) / 1000000.0::DOUBLE AS c
  FROM embeddings CROSS JOIN range(1, 65) AS r(i) GROUP BY label, i),
q AS (SELECT label AS query_id, list(c ORDER BY i) AS qv FROM cq GROUP BY label),
sims AS (
  SELECT q.query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.qv) AS sim
  FROM embeddings e CROSS JOIN q),
topk AS (
  SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS INTEGER) AS rank,
         round(sim, 6) AS similarity
  FROM sims WHERE sim IS NOT NULL QUALIFY rank <= 5)"""


def _embedded(table: str, keys: str, name: str) -> str:
    """(keys, text, v): hashed bag-of-words vectors of a table's texts; null where there is no text."""
    return f"""{name}_c AS (
  SELECT {keys}, text, list_transform(range(0, 64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c FROM (
    SELECT {keys}, text, list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda t: ('0x' || substr(md5(t), 1, 2))::INTEGER % 64) AS b FROM {table})),
{name}_n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM {name}_c),
{name} AS (SELECT {keys}, text, CASE WHEN text IS NOT NULL THEN list_transform(c, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END::FLOAT) END AS v FROM {name}_n)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["positions_decode"] = f"WITH {POSITIONS} SELECT driver_name, position, {MS.format(c='ts')} AS ts, race_id, arrival FROM positions"
    q["positions_decode_damaged"] = q["positions_decode"] + " WHERE arrival % 7 NOT IN (0, 1, 2)"
    q["decode_dead_letters"] = (f"WITH {POSITIONS} SELECT race_id AS key, arrival, CASE WHEN arrival % 7 = 1 THEN "
                                f"'{{\"driver_name\": \"cut' || arrival ELSE '' END AS value FROM positions WHERE arrival % 7 IN (1, 2)")
    q["positions_decode_framed"] = (f"WITH {POSITIONS} SELECT driver_name, position, {MS.format(c='ts')} AS ts, race_id, arrival, "
                                    f"70000 + arrival // {C.FRAME_IDS} AS schema_id FROM positions WHERE arrival % {C.FRAME_BROKEN} <> 0")
    wire = """'{"driver_name":"' || driver_name || '","position":' || position || ',"timestamp":' || (epoch_us(ts) // 1000)
      || CASE WHEN race_id IS NULL THEN '' ELSE ',"race_id":"' || race_id || '"' END || ',"team_name":"' || team_name || '","speed":' || speed || '}'"""
    q["decode_broken_frames"] = (f"WITH {POSITIONS} SELECT race_id AS key, arrival, CAST(5 + strlen({wire}) AS INTEGER) AS n_bytes "
                                 f"FROM positions WHERE arrival % {C.FRAME_BROKEN} = 0")
    q["metrics_decode"] = f"WITH {METRICS} SELECT key, team_name, {MS.format(c='ts')} AS ts, engine_temperature, arrival FROM metrics"
    q["leaderboard_latest"] = f"WITH {POSITIONS}, {LATEST}, {RANKED} SELECT * FROM ranked"
    q["leaderboard_snapshot_race"] = (f"WITH {POSITIONS}, {LATEST}, {RANKED} SELECT * FROM ranked "
                                      f"WHERE race_id = '{C.SNAPSHOT_RACE}'")
    q["leaderboard_no_race"] = f"WITH {POSITIONS}, {LATEST}, {RANKED} SELECT * FROM ranked WHERE race_id IS NULL"
    q["leaderboard_bounded10"] = f"WITH RECURSIVE {POSITIONS}, {LATEST}, {BOUNDED} SELECT * FROM bounded"
    q["leaderboard_bounded_repair"] = q["leaderboard_bounded10"]
    q["leaderboard_list_log"] = (f"WITH RECURSIVE {POSITIONS}, {LATEST}, {BOUNDED} SELECT seq.race_id, seq.arrival, seq.driver_name, "
                                 f"array_to_string(fold.slots, '>') AS slots FROM fold JOIN seq ON seq.g = fold.g AND seq.i = fold.i")
    q["leaderboard_enriched"] = f"""WITH RECURSIVE {POSITIONS}, {LATEST}, {BOUNDED},
rb AS (SELECT *, CAST(row_number() OVER (PARTITION BY race_id ORDER BY position, driver_name) AS INTEGER) AS rank FROM bounded)
SELECT rb.*, coalesce(ro.name, 'Unknown Driver') AS driver_label, coalesce(ro.team, 'Unknown Team') AS team_label,
       coalesce(ro.team_color, '#000000') AS team_color,
       CASE WHEN rb.position <= 3 THEN 'podium' WHEN rb.position <= 6 THEN 'points' ELSE 'regular' END AS badge,
       coalesce(rb.driver_name = '{C.SELECTED_DRIVER}', FALSE) AS is_selected
FROM rb LEFT JOIN roster ro ON rb.driver_name = ro.name"""
    q["position_changes"] = f"""WITH {POSITIONS},
c AS (SELECT *, lag(position) OVER (PARTITION BY race_id, driver_name ORDER BY arrival) AS prev_position FROM positions)
SELECT *, CAST(prev_position - position AS INTEGER) AS change,
       CASE WHEN prev_position - position > 0 THEN 'gain' WHEN prev_position - position < 0 THEN 'loss' ELSE '' END AS direction
FROM c WHERE prev_position IS NOT NULL AND prev_position <> position"""
    q["baseline_delta"] = f"""WITH {POSITIONS},
b AS (SELECT race_id, driver_name, arg_max(position, arrival) FILTER (arrival <= {C.BASELINE_SEEN}) AS baseline_position, arg_max(position, arrival) AS position
      FROM positions GROUP BY race_id, driver_name)
SELECT *, CAST(baseline_position - position AS INTEGER) AS change,
       CASE WHEN baseline_position - position > 0 THEN 'gain' WHEN baseline_position - position < 0 THEN 'loss' ELSE '' END AS direction
FROM b"""
    q["final_positions"] = f"WITH RECURSIVE {POSITIONS}, {LATEST}, {BOUNDED}, {RACES}, {_status(C.EVICT_ASOF)}, {FINAL} SELECT * FROM final"
    q["race_winner"] = f"WITH RECURSIVE {POSITIONS}, {LATEST}, {BOUNDED}, {RACES}, {_status(C.EVICT_ASOF)}, {FINAL} SELECT * FROM final WHERE position = 1"
    q["driver_result"] = (f"WITH RECURSIVE {POSITIONS}, {LATEST}, {BOUNDED}, {RACES}, {_status(C.EVICT_ASOF)}, {FINAL} SELECT * FROM final "
                          f"WHERE driver_name = '{C.RESULT_DRIVER}'")
    q["race_status"] = f"WITH {POSITIONS}, {RACES}, {_status(C.STATUS_ASOF)} SELECT * FROM status"
    q["races_evicted"] = (f"WITH {POSITIONS}, {RACES}, {_status(C.EVICT_ASOF)} SELECT * FROM status "
                          f"WHERE status = 'finished' AND end_time < TIMESTAMP '{C.EVICT_ASOF}' - INTERVAL 1 HOUR")
    q["race_lifecycle"] = (f"WITH {POSITIONS}, {RACES} SELECT race_id, 'in_progress' AS status, start_time AS at FROM races "
                           f"UNION ALL SELECT race_id, 'finished', end_time FROM races")
    el = "CAST(epoch_us(p.ts) - epoch_us(r.start_time) AS DOUBLE) / 1000000.0"
    q["race_lap"] = f"""WITH {POSITIONS}, {RACES}
SELECT p.arrival, p.race_id, p.driver_name, {el} AS elapsed_s,
       greatest(1, CAST(floor({el} / 10) + 1 AS INTEGER)) AS lap
FROM positions p JOIN races r ON p.race_id = r.race_id"""
    q["race_history"] = f"""WITH {POSITIONS}, {RACES}
SELECT p.arrival, p.race_id, p.driver_name, p.position, p.ts,
       least(1.0::DOUBLE, greatest(0.0::DOUBLE, {el} / CAST(r.duration AS DOUBLE))) AS progress,
       row_number() OVER (PARTITION BY p.race_id, p.driver_name ORDER BY p.arrival) AS seq
FROM positions p JOIN races r ON p.race_id = r.race_id"""
    q["driver_validate_semi"] = f"WITH {ROSTER}, {REQUESTS} SELECT * FROM requests WHERE driver_name IN (SELECT name FROM roster)"
    q["driver_validate_anti"] = (f"WITH {ROSTER}, {REQUESTS} SELECT * FROM requests r "
                                 f"WHERE NOT EXISTS (SELECT 1 FROM roster ro WHERE ro.name = r.driver_name)")
    avg = "CAST(sum(CAST(round(speed * 100) AS BIGINT)) AS DOUBLE) / CAST(count(speed) AS DOUBLE) / 100.0::DOUBLE"
    q["avg_speed"] = (f"WITH {POSITIONS} SELECT race_id, driver_name, count(speed) AS n, {avg} AS avg_speed "
                      f"FROM positions GROUP BY race_id, driver_name")
    q["avg_speed_tumbling"] = f"""WITH {POSITIONS},
b AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM positions)
SELECT race_id, driver_name, window_start, window_start + INTERVAL 1 DAY AS window_end, count(speed) AS n, {avg} AS avg_speed
FROM b GROUP BY race_id, driver_name, window_start"""
    q["anomaly_gaussian"] = f"WITH {_gauss_cte()} SELECT {GAUSS_COLS} FROM gauss WHERE is_anomaly = TRUE"
    q["anomaly_ar1"] = f"WITH {_ar1_cte()} SELECT {GAUSS_COLS} FROM ar1 WHERE is_anomaly = TRUE"
    real = f"""{METRICS},
rd AS (SELECT arrival, team_name, epoch_us(ts) // 1000 AS ts_ms, engine_temperature / {C.REAL_DIVISOR!r}::DOUBLE AS y FROM metrics)"""
    out = "arrival, team_name, ts_ms, CAST(n AS BIGINT) AS n, round(y, 6) AS engine_temperature, round(fc, 6) AS forecast, round(fc - half, 6) AS lower, round(fc + half, 6) AS upper"
    q["anomaly_gaussian_real"] = f"""WITH {real},
w AS (SELECT *, count(y) OVER w AS n, avg(y) OVER w AS fc, stddev_samp(y) OVER w AS sd
      FROM rd WINDOW w AS (PARTITION BY team_name ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, '{Z}'::DOUBLE * sd * sqrt(1.0::DOUBLE + 1.0::DOUBLE / n) AS half FROM w WHERE n >= 16)
SELECT {out} FROM b WHERE y < fc - half OR y > fc + half"""
    q["anomaly_ar1_real"] = f"""WITH {real},
l AS (SELECT *, lag(y) OVER (PARTITION BY team_name ORDER BY ts_ms, arrival) AS x FROM rd),
w AS (SELECT *, regr_count(y, x) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy
      FROM l WINDOW w AS (PARTITION BY team_name ORDER BY ts_ms, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, a + b * x AS fc, '{Z}'::DOUBLE * sqrt(greatest(syy - b * sxy, 0.0::DOUBLE) / (n - 2)) AS half FROM w WHERE n >= 16 AND x IS NOT NULL)
SELECT {out} FROM f WHERE y < fc - half OR y > fc + half"""
    q["anomaly_enriched"] = f"{_alerts_flagged()} SELECT {ALERT_COLS} FROM alerts"
    q["anomaly_severity"] = ("WITH " + _gauss_cte() + ",\nready AS (SELECT * FROM gauss WHERE forecast IS NOT NULL),\n"
                             + ENRICH.format(cols=_gcols(), conf=REAL_CONF, src="ready")
                             + f" SELECT {ALERT_COLS} FROM alerts")
    q["anomaly_recent100"] = f"{_alerts_flagged()} SELECT {ALERT_COLS} FROM alerts ORDER BY arrival DESC LIMIT 100"
    q["anomaly_last20"] = f"""{_alerts_flagged()},
top AS (SELECT {ALERT_COLS} FROM alerts ORDER BY arrival DESC LIMIT 20)
SELECT *, CAST(row_number() OVER (ORDER BY arrival) AS INTEGER) AS seq FROM top"""
    q["anomaly_dedupe"] = (f"{_alerts_flagged()} SELECT {ALERT_COLS} FROM alerts "
                           f"QUALIFY row_number() OVER (PARTITION BY timestamp, team_name, metric_name ORDER BY arrival) = 1")
    q["anomaly_feed50"] = f"""{_alerts_flagged()},
d AS (SELECT {ALERT_COLS} FROM alerts
      QUALIFY row_number() OVER (PARTITION BY timestamp, team_name, metric_name ORDER BY arrival) = 1)
SELECT * FROM d ORDER BY arrival DESC LIMIT 50"""
    q["commentary_feed50"] = f"""WITH {POSITIONS}, {GENERATED},
d AS (SELECT * FROM generated QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1)
SELECT * FROM d ORDER BY arrival DESC LIMIT 50"""
    q["teams_distinct"] = f"WITH {METRICS} SELECT DISTINCT team_name FROM metrics WHERE team_name IS NOT NULL"
    q["team_lead"] = (f"WITH {POSITIONS} SELECT team, arg_min(name, id) AS lead_driver FROM roster "
                      f"WHERE name IN (SELECT driver_name FROM positions) GROUP BY team")
    q["commentary_generate"] = f"WITH {POSITIONS}, {GENERATED} SELECT * FROM generated"
    q["commentary_decode"] = f"WITH {COMMENTS} SELECT * FROM decoded"
    mention = f"""CASE WHEN message IS NULL OR message = '' THEN TRUE
       ELSE contains(lower(message), '{C.MENTION_DRIVER.lower()}') END"""
    first, last = C.MENTION_LONG_NAME.lower().split()[0], C.MENTION_LONG_NAME.lower().split()[-1]
    q["commentary_mentions_long_name"] = (f"WITH {POSITIONS}, {GENERATED} SELECT *, coalesce(message, '') = '' OR "
                                          f"(contains(lower(message), '{first}') AND contains(lower(message), '{last}')) AS mentions FROM generated")
    q["commentary_mentions"] = f"WITH {POSITIONS}, {GENERATED} SELECT *, {mention} AS mentions FROM generated"
    q["commentary_recent50"] = f"WITH {COMMENTS} SELECT * FROM decoded ORDER BY conv_id DESC, turn DESC LIMIT 50"
    q["commentary_dedupe"] = (f"WITH {POSITIONS}, {GENERATED} SELECT * FROM generated "
                              f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1")
    q["envelope_json"] = f"""{_alerts_flagged()}
SELECT 'anomaly' AS kind, coalesce(team_name, '') AS team_name, coalesce(driver_name, '') AS driver_name,
       coalesce(key, '') AS race_id, timestamp, coalesce(metric_name, '') AS metric_name,
       coalesce(metric_value, 0.0::DOUBLE) AS metric_value, coalesce(confidence_score, 0.0::DOUBLE) AS confidence_score,
       coalesce(severity, 'info') AS severity
FROM alerts"""
    q["commentary_envelope"] = f"""WITH {COMMENTS}
SELECT 'commentary' AS kind, id, message, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
       coalesce(type, 'info') AS type FROM decoded"""
    q["upsert_latest"] = f"""WITH {_gauss_cte()}
SELECT key, make_timestamp(ts_ms * 1000) AS ts, team_name, engine_temperature, is_anomaly FROM gauss
WHERE forecast IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY key, ts_ms ORDER BY arrival DESC) = 1"""
    q["vector_topk"] = f"WITH {CENTROIDS} SELECT * FROM topk"
    q["vector_topk_limit5"] = f"WITH {CENTROIDS} SELECT * FROM topk ORDER BY query_id, rank LIMIT 5"
    q["embed_queries"] = f"""WITH {_embedded('conversations', 'conv_id, turn', 'e')},
x AS (SELECT conv_id, turn, unnest(range(0, 64)) AS dim, unnest(v) AS value FROM e WHERE v IS NOT NULL)
SELECT conv_id, turn, CAST(dim AS INTEGER) AS dim, round(CAST(value AS DOUBLE), 6) AS value FROM x WHERE value > 0"""
    q["text_search_topk"] = f"""WITH msgs AS (SELECT conv_id * 1000 + turn AS vec_id, text FROM conversations),
{_embedded('msgs', 'vec_id', 'm')},
{_embedded('benchmark', 'item_id', 'b')},
s AS (SELECT b.item_id AS query_id, m.vec_id, m.text AS message, round(list_cosine_similarity(CAST(m.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 6) AS similarity
      FROM b JOIN m ON m.v IS NOT NULL AND b.v IS NOT NULL AND list_sum(m.v) > 0 AND list_sum(b.v) > 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank, similarity, message FROM s
QUALIFY rank <= 5"""
    # streaming queries: the stream must equal the batch semantics on the same input
    q["stream_leaderboard"] = q["leaderboard_latest"]
    q["stream_bounded"] = q["leaderboard_bounded10"]
    up = ("SELECT key, make_timestamp(ts_ms * 1000) AS ts, team_name, engine_temperature, is_anomaly FROM {t} "
          "WHERE is_anomaly = TRUE QUALIFY row_number() OVER (PARTITION BY key, ts_ms ORDER BY arrival DESC) = 1")
    q["stream_anomaly"] = f"WITH {_gauss_cte()} " + up.format(t="gauss")
    q["stream_anomaly_ar1"] = f"WITH {_ar1_cte()} " + up.format(t="ar1")
    q["stream_last_n"] = (f"WITH {POSITIONS} SELECT race_id, arrival, driver_name, position FROM positions "
                          f"QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY arrival DESC) <= {S.LAST_N}")
    q["stream_upsert"] = f"""WITH {POSITIONS}, {LATEST}
SELECT race_id, driver_name, arrival, ts, position FROM latest WHERE position <> {S.RETIRED}"""
    whole = f"arrival % {S.LOG_EMPTY} <> 0 AND arrival % {S.LOG_CUT} <> 0"
    q["log_leaderboard"] = f"""WITH {POSITIONS},
sent AS (SELECT race_id, driver_name, arrival, {MS.format(c='ts')} AS ts, position FROM positions WHERE {whole}),
l AS (SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY race_id, driver_name ORDER BY arrival DESC) = 1)
SELECT *, CAST(row_number() OVER (PARTITION BY race_id ORDER BY position, driver_name) AS INTEGER) AS rank FROM l"""
    q["log_alerts"] = (f"{_alerts_flagged()} SELECT arrival, team_name, driver_name, metric_name, metric_value, confidence_score, severity "
                       f"FROM alerts WHERE {whole}")
    q["log_commentary"] = f"""WITH {POSITIONS}, {GENERATED}
SELECT id, message, make_timestamp(timestamp * 1000) AS ts, type, arrival FROM generated WHERE {whole}
QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1"""
    q["log_dead_letters"] = f"""WITH {_gauss_cte()},
cut AS (SELECT arrival FROM metrics WHERE arrival % {S.LOG_EMPTY} <> 0 AND arrival % {S.LOG_CUT} = 0),
r AS (SELECT 'positions' AS topic, 'dead' AS kind, arrival FROM cut UNION ALL SELECT 'commentary', 'dead', arrival FROM cut
      UNION ALL SELECT 'anomalies', 'dead', arrival FROM cut WHERE arrival IN (SELECT arrival FROM gauss WHERE is_anomaly)
      UNION ALL SELECT 'audit', 'unrouted', arrival FROM metrics)
SELECT topic, kind, count(*) AS n, min(arrival) AS first, max(arrival) AS last FROM r GROUP BY topic, kind"""
    q["stream_late_rows"] = f"""WITH {METRICS},
came AS (SELECT team_name, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 + (arrival * 7919) % {S.JITTER_MS} AS c FROM metrics),
span AS (SELECT min(epoch_us(ts) // 1000 + (event_id * 7919) % {S.JITTER_MS}) AS lo, max(epoch_us(ts) // 1000 + (event_id * 7919) % {S.JITTER_MS}) AS hi FROM events),
dealt AS (SELECT team_name, ms, (c - lo) * {S.REPLAY_SLOTS} // (hi - lo + 1) AS slot FROM came, span),
marks AS (SELECT slot, max(max(ms)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {S.SHORT_DELAY_MS} AS passed FROM dealt GROUP BY slot)
SELECT team_name, CAST(count(*) FILTER (passed IS NOT NULL AND ms <= passed) AS BIGINT) AS late_rows,
       CAST(count(*) FILTER (passed IS NULL OR ms > passed) AS BIGINT) AS scored_rows FROM dealt JOIN marks USING (slot) GROUP BY team_name"""
    q["stream_dedupe"] = f"WITH {POSITIONS}, {GENERATED} SELECT DISTINCT id, driver_name FROM generated"
    q["stream_lifecycle"] = q["race_lifecycle"]
    q["stream_avg_speed"] = q["avg_speed"]
    return q


ORACLE = build()
