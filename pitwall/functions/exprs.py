"""Scalar column expressions.

All of these are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the behaviour being reproduced) -------------------------
COMMENT_ID_PREFIX = "comment-"
PROMPT_HEAD = "Driver: "
PROMPT_MID = ", Position: "
PROMPT_TAIL = ". Generate exciting F1 commentary. Keep it under 80 characters."
COMMENT_TYPES = ("highlight", "warning", "info")      # position 1, positions 2-3, rest
DEFAULT_COMMENT_TYPE = "info"
METRIC_NAME = "Engine Temperature"
FLAG_CONFIDENCE = 0.95                                # confidence given to a flagged row
SEVERITY_CRITICAL_CONF = 0.95                         # strictly above -> may be critical
SEVERITY_WARNING_CONF = 0.90                          # strictly above -> warning
METRIC_LIMITS = {"temperature": (60.0, 120.0), "pressure": (1.5, 2.5)}   # outside -> critical
DEFAULT_TEAM_COLOR = "#000000"
UNKNOWN_DRIVER = "Unknown Driver"
UNKNOWN_TEAM = "Unknown Team"
BADGES = ("podium", "points", "regular")              # <=3, <=6, rest
CHANGE_LABELS = ("gain", "loss", "")                  # previous - current >0, <0, 0
LAP_SECONDS = 10                                      # one lap per 10 s of race time
# -----------------------------------------------------------------------------------------


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_to_ts(c) -> Column:
    """Epoch milliseconds (long) -> TIMESTAMP."""
    return F.timestamp_millis(col(c))


def ts_to_ms(c) -> Column:
    """TIMESTAMP -> epoch milliseconds (floor)."""
    return F.unix_millis(col(c))


def empty_as_null(c) -> Column:
    """'' behaves like a missing value (truthiness of the key)."""
    c = col(c)
    return F.when(c == F.lit(""), F.lit(None).cast("string")).otherwise(c)


def comment_type(position) -> Column:
    p = col(position)
    return (F.when(p == 1, F.lit(COMMENT_TYPES[0]))
            .when(p <= 3, F.lit(COMMENT_TYPES[1]))
            .otherwise(F.lit(COMMENT_TYPES[2])))


def comment_id(epoch_seconds, driver_name) -> Column:
    return F.concat(F.lit(COMMENT_ID_PREFIX), col(epoch_seconds).cast("string"), F.lit("-"),
                    F.replace(col(driver_name), F.lit(" "), F.lit("_")))


def commentary_prompt(driver_name, position) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), col(driver_name), F.lit(PROMPT_MID),
                    col(position).cast("string"), F.lit(PROMPT_TAIL))


def mentions(message, driver_name) -> Column:
    """Case-insensitive: message contains the last token, and the first token too when the
    name has several tokens. True when either input is empty or missing."""
    text, name = (F.lower(F.coalesce(col(c), F.lit(""))) for c in (message, driver_name))
    ends = (F.substring_index(name, " ", 1), F.substring_index(name, " ", -1))
    return (text == "") | (name == "") | (text.contains(ends[0]) & text.contains(ends[1]))


def badge(position) -> Column:
    p = col(position)
    return F.when(p <= 3, F.lit(BADGES[0])).when(p <= 6, F.lit(BADGES[1])).otherwise(F.lit(BADGES[2]))


def change_direction(change) -> Column:
    c = col(change)
    return (F.when(c > 0, F.lit(CHANGE_LABELS[0])).when(c < 0, F.lit(CHANGE_LABELS[1]))
            .otherwise(F.lit(CHANGE_LABELS[2])))


def flag_confidence(flag) -> Column:
    return F.when(col(flag), F.lit(FLAG_CONFIDENCE)).otherwise(F.lit(0.0))


def severity(confidence, metric_name, metric_value) -> Column:
    """Sure alerts are critical when the value leaves the limits of its kind of metric (named
    in ``METRIC_LIMITS``), else warnings; likely ones are warnings, the others information."""
    conf = F.coalesce(col(confidence).cast("double"), F.lit(0.0))
    name = F.coalesce(F.lower(col(metric_name)), F.lit(""))
    value = F.coalesce(col(metric_value).cast("double"), F.lit(0.0))
    # limits of the first kind that the name holds; none for other metrics
    limits = F.coalesce(*[F.when(name.contains(kind), F.array(F.lit(float(lo)), F.lit(float(hi)))) for kind, (lo, hi) in METRIC_LIMITS.items()])
    outside = F.coalesce(~value.between(limits[0], limits[1]), F.lit(False))
    return (F.when((conf > SEVERITY_CRITICAL_CONF) & outside, F.lit("critical"))
            .when(conf > SEVERITY_WARNING_CONF, F.lit("warning")).otherwise(F.lit("info")))


def lap_number(elapsed_seconds) -> Column:
    return F.greatest(F.lit(1), (F.floor(col(elapsed_seconds) / LAP_SECONDS) + 1).cast("int"))


def _dsum(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _dsum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def sq_norm(a) -> Column:
    return _dsum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity of two float arrays; null for a zero/missing vector or a length
    mismatch (zip_with pads with null, which makes the sum null)."""
    na, nb = sq_norm(a), sq_norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(None).cast("double")).otherwise(
        dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))
