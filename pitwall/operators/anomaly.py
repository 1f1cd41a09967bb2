"""Per-team one-step-ahead anomaly detection on a metric series, and alert shaping.

Detector (W1): for each row, a model is fitted on the team's strictly earlier history,
a one-step forecast is made, and the row is flagged when its value leaves the two-sided
``confidence`` band. Fewer than ``min_training`` history points -> flag null (so a
``WHERE is_anomaly`` drops the row, as ``= TRUE`` does in SQL).

* ``gaussian``: history = rows with a strictly smaller event-time millisecond (peers
  share one history, RANGE semantics); forecast = mean; band = z * sd * sqrt(1 + 1/n).
* ``ar1``: least squares y_t = a + b*y_{t-1} over the pairs of strictly earlier rows in
  (ts, arrival) order; forecast = a + b*y_prev; band = z * sqrt(SSE / (n - 2)).

With ``cents`` (the default) the moments are exact: the two-decimal measure is taken as integer
cents and all sums are integers (decimal(38,0) once they are combined), so every engine derives the
same doubles from them. With ``cents=False`` the measure is any double, and nothing is rounded: sums run over
distances from the middle of the team's values, which keeps the squares' digits when the spread is
small against the values. A value that isn't finite counts as missing. Running sums per team use ``sequence.prefix_sums``: the series is cut
into event-time chunks sized per team (about ``CHUNK_ROWS`` rows each), so one hot team
spreads over many tasks.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.operators import sequence
from pitwall.operators.dims import team_lead

CONFIDENCE_PCT = 90.0        # fixed values of the detector options
MIN_TRAINING = 16
HORIZON = 1
CHUNK_ROWS = 1_000_000       # target rows per event-time chunk of one team (running sums)


def z_value(confidence_pct: float = CONFIDENCE_PCT) -> float:
    """Two-sided normal quantile for a confidence percentage (90 -> 1.6448536269514722)."""
    return NormalDist().inv_cdf(0.5 + confidence_pct / 200.0)


def _d(c) -> F.Column:
    return X.col(c).cast("double")


def _prepare(metrics: DataFrame, value_col: str, team_col: str = "team_name", cents: bool = True) -> DataFrame:
    timed = metrics.withColumn("ts_ms", X.ts_to_ms("ts"))
    if cents:
        return timed.withColumn("_v", F.round(F.col(value_col) * 100).cast("long"))
    # general doubles: distances from a value in the middle of the team's (its mean as a float, one partial aggregate)
    v = _d(value_col)
    finite = F.when(F.abs(v) < F.lit(float("inf")), v)        # false for NaN, too: Spark takes NaN as the largest
    middle = metrics.groupBy(F.col(team_col).alias("_team")).agg(F.coalesce(F.avg(finite).cast("float").cast("double"), F.lit(0.0)).alias("_mid"))
    return timed.join(middle, F.col(team_col).eqNullSafe(F.col("_team")), "left").drop("_team").withColumn("_v", finite - F.col("_mid"))


def _back(c: F.Column, cents: bool) -> F.Column:
    """A value of ``_v``'s scale on the measure's."""
    return c / 100.0 if cents else c + F.col("_mid")


def _chunked(df: DataFrame, team_col: str, chunk_ms: int | None, chunk_rows: int):
    """Event-time chunks: fixed width when ``chunk_ms`` is given, else sized per team."""
    if chunk_ms:
        return df, sequence.time_chunk("ts_ms", chunk_ms)
    return sequence.balanced_time_chunk(df, [team_col], "ts_ms", chunk_rows), F.col("_tchunk")


def gaussian_sums(v) -> dict[str, F.Column]:
    return {"_n": F.when(v.isNotNull(), F.lit(1)).otherwise(F.lit(0)), "_s1": F.coalesce(v, F.lit(0)), "_s2": F.coalesce(v * v, F.lit(0))}


def ar1_sums(x, y) -> dict[str, F.Column]:
    ok = x.isNotNull() & y.isNotNull()
    terms = {"_n": F.lit(1), "_sx": x, "_sy": y, "_sxx": x * x, "_syy": y * y, "_sxy": x * y}
    return {k: F.when(ok, c).otherwise(F.lit(0)) for k, c in terms.items()}


def gaussian(metrics: DataFrame, value_col: str = "engine_temperature", team_col: str = "team_name",
             confidence_pct: float = CONFIDENCE_PCT, min_training: int = MIN_TRAINING,
             chunk_ms: int | None = None, chunk_rows: int = CHUNK_ROWS, carry: DataFrame | None = None, cents: bool = True) -> DataFrame:
    """``carry`` (team, _n, _s1, _s2): the team's sums over history that is not in ``metrics`` (with ``cents`` only)."""
    if carry is not None and not cents:
        raise ValueError("carried sums are in cents")
    z = z_value(confidence_pct)
    df, chunk = _chunked(_prepare(metrics, value_col, team_col, cents), team_col, chunk_ms, chunk_rows)
    v = F.col("_v")
    s = sequence.prefix_sums(df, [team_col], ["ts_ms"], chunk, gaussian_sums(v), range_order=True, carry=carry, exact=cents)
    n, s1, s2 = F.col("_n"), F.col("_s1"), F.col("_s2")
    nd = _d(n)
    mean_c = _d(s1) / nd
    var_c = _d(n * s2 - s1 * s1) / _d(n * (n - 1)) if cents else F.greatest(s2 - s1 * (s1 / n), F.lit(0.0)) / (n - 1.0)
    half_c = F.lit(z) * F.sqrt(var_c) * F.sqrt(F.lit(1.0) + F.lit(1.0) / nd)
    ready = n >= min_training
    out = s.select(
        *[c for c in metrics.columns], "ts_ms", n.cast("long").alias("n"),
        F.when(ready, _back(mean_c, cents)).alias("forecast"),
        F.when(ready, _back(mean_c - half_c, cents)).alias("lower"),
        F.when(ready, _back(mean_c + half_c, cents)).alias("upper"),
        F.when(ready & v.isNotNull(), (_d(v) < mean_c - half_c) | (_d(v) > mean_c + half_c)).alias("is_anomaly"),
        F.when(ready & v.isNotNull(), F.abs(_d(v) - mean_c)).alias("_dev_c"),
        F.when(ready, half_c).alias("_half_c"),
    )
    return out


def ar1(metrics: DataFrame, value_col: str = "engine_temperature", team_col: str = "team_name",
        confidence_pct: float = CONFIDENCE_PCT, min_training: int = MIN_TRAINING,
        chunk_ms: int | None = None, chunk_rows: int = CHUNK_ROWS, carry: DataFrame | None = None, cents: bool = True) -> DataFrame:
    """``carry`` (team, the six sums, _v): sums and last value of history that is not in ``metrics`` (with ``cents`` only)."""
    if carry is not None and not cents:
        raise ValueError("carried sums are in cents")
    z = z_value(confidence_pct)
    df, chunk = _chunked(_prepare(metrics, value_col, team_col, cents), team_col, chunk_ms, chunk_rows)
    order = ["ts_ms", "arrival"]
    df = sequence.previous(df, [team_col], order, chunk, ["_v"], keep_parts=True, carry=carry)
    x, y = F.col("prev__v"), F.col("_v")
    s = sequence.prefix_sums(df, [team_col], order, chunk, ar1_sums(x, y), carry=carry, exact=cents)
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy"))
    nd = _d(n)
    dxx, dxy, dyy = n * sxx - sx * sx, n * sxy - sx * sy, n * syy - sy * sy
    b = F.when(dxx == 0, F.lit(0.0)).otherwise(_d(dxy) / _d(dxx))
    a = (_d(sy) - b * _d(sx)) / nd
    fc = a + b * _d(x)
    sse = (_d(dyy) - b * _d(dxy)) / nd
    half_c = F.lit(z) * F.sqrt(F.greatest(sse, F.lit(0.0)) / (nd - 2.0))
    ready = (n >= min_training) & x.isNotNull()
    return s.select(
        *[c for c in metrics.columns], "ts_ms", n.cast("long").alias("n"),
        F.when(ready, _back(fc, cents)).alias("forecast"),
        F.when(ready, _back(fc - half_c, cents)).alias("lower"),
        F.when(ready, _back(fc + half_c, cents)).alias("upper"),
        F.when(ready & y.isNotNull(), (_d(y) < fc - half_c) | (_d(y) > fc + half_c)).alias("is_anomaly"),
        F.when(ready & y.isNotNull(), F.abs(_d(y) - fc)).alias("_dev_c"),
        F.when(ready, half_c).alias("_half_c"),
    )


def totals(metrics: DataFrame, method: str, value_col: str = "engine_temperature", team_col: str = "team_name",
           chunk_ms: int | None = None, chunk_rows: int = CHUNK_ROWS, carry: DataFrame | None = None) -> DataFrame:
    """One row per team of ``metrics`` or ``carry``: what the next piece of the series needs as its carry."""
    df, chunk = _chunked(_prepare(metrics, value_col), team_col, chunk_ms, chunk_rows)
    if method == "gaussian":
        sums = gaussian_sums(F.col("_v"))
        own = df.groupBy(team_col).agg(*[F.sum(c).cast("decimal(38,0)").alias(n) for n, c in sums.items()])
        kept = [team_col, *sums]
        return (own if carry is None else own.unionByName(carry.select(*kept))).groupBy(team_col).agg(
            *[F.sum(n).cast("decimal(38,0)").alias(n) for n in sums])
    order = ["ts_ms", "arrival"]
    df = sequence.previous(df, [team_col], order, chunk, ["_v"], carry=carry)
    sums = ar1_sums(F.col("prev__v"), F.col("_v"))
    own = df.groupBy(team_col).agg(*[F.sum(c).cast("decimal(38,0)").alias(n) for n, c in sums.items()],
                                   F.max_by(F.struct("_v"), F.struct(*order)).alias("_last"), F.lit(1).alias("_new"))
    if carry is not None:
        own = own.unionByName(carry.select(team_col, *sums, F.struct("_v").alias("_last"), F.lit(0).alias("_new")))
    return own.groupBy(team_col).agg(*[F.sum(n).cast("decimal(38,0)").alias(n) for n in sums],
                                     F.max_by("_last", "_new").alias("_last")).select(team_col, *sums, "_last._v")


def detect(metrics: DataFrame, method: str = "gaussian", **kw) -> DataFrame:
    """W1 + B7: rows with their detector result; ``flagged`` keeps ``is_anomaly = TRUE``."""
    fn = {"gaussian": gaussian, "ar1": ar1}[method]
    return fn(metrics, **kw)


def flagged(detected: DataFrame) -> DataFrame:
    return detected.where(F.col("is_anomaly") == F.lit(True))


def real_confidence(detected: DataFrame) -> DataFrame:
    """A confidence in [0, 0.999] from the detector: 0.90 at the band edge, rising with the
    distance from the forecast (1 - 0.1 * half / |deviation|)."""
    dev, half = F.col("_dev_c"), F.col("_half_c")
    conf = (F.when(dev.isNull() | half.isNull(), F.lit(None).cast("double"))
            .when(dev == 0, F.lit(0.0))
            .when(half == 0, F.lit(0.999))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.lit(1.0) - F.lit(0.1) * half / dev))))
    return detected.withColumn("confidence_score", conf)


def enrich(anoms: DataFrame, roster: DataFrame, confidence_col: str | None = None) -> DataFrame:
    """J4 + B14-B17: first driver of the team (else the team name), metric name and value
    defaults, confidence (flag -> 0.95 unless a real confidence column is given), severity.
    The alert time is the event time in ms (kept from the input, not the wall clock)."""
    leads = team_lead(roster).select(F.col("team").alias("_team"), "lead_driver")
    j = anoms.join(leads, anoms.team_name == leads._team, "left")
    conf = F.col(confidence_col) if confidence_col else X.flag_confidence("is_anomaly")
    out = j.select(
        *[c for c in anoms.columns if not c.startswith("_") and c != "confidence_score"],
        F.coalesce(F.col("lead_driver"), F.col("team_name")).alias("driver_name"),
        F.col("ts_ms").alias("timestamp"),
        F.lit(X.METRIC_NAME).alias("metric_name"),
        F.coalesce(F.col("engine_temperature"), F.lit(0.0)).alias("metric_value"),
        conf.alias("confidence_score"),
    )
    return out.withColumn("severity", X.severity("confidence_score", "metric_name", "metric_value"))


def dedupe(alerts: DataFrame, keys=("timestamp", "team_name", "metric_name"), order: str = "arrival") -> DataFrame:
    """First alert (by arrival) per (timestamp, team, metric); partial aggregation."""
    rest = [c for c in alerts.columns if c not in keys]
    return alerts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f")).select(*keys, "_f.*")


def recent(df: DataFrame, n: int, order=("arrival",)) -> DataFrame:
    """The last ``n`` rows to arrive, newest first (top-n per partition, then one merge)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def last_n_oldest_first(df: DataFrame, n: int, order=("arrival",)) -> DataFrame:
    """The newest ``n`` rows, numbered oldest -> newest (``seq``)."""
    from pyspark.sql import Window
    top = recent(df, n, order)
    return top.withColumn("seq", F.row_number().over(Window.orderBy(*[F.col(c) for c in order])).cast("int"))
