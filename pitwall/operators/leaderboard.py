"""Leaderboard state over position messages.

Input columns (see ``pitwall.sources.views.positions``): arrival (offset), ts, race_id
(null = no race), driver_name, position, team_name, speed.

"Latest" means arrival order: the last message of a (race, driver) wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.operators import capped, sequence

KEYS = ("race_id", "driver_name")
CAP = capped.CAP
OFFSET_CHUNK = 1 << 20        # offsets per chunk for ordered per-key work


def latest(positions: DataFrame, keys=KEYS, order: str = "arrival") -> DataFrame:
    """Latest message per key (G1; the null race is its own group, G2).

    ``max_by`` is a declarative aggregate: partial aggregation on the map side keeps a hot
    key from shipping more than one row per partition across the shuffle.
    """
    rest = [c for c in positions.columns if c not in keys]
    return (positions.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_m"))
            .select(*keys, "_m.*"))


def snapshot(board: DataFrame, race_id: str | None) -> DataFrame:
    """Rows of one race, or the no-race list when ``race_id`` is None or ''."""
    if race_id:
        return board.where(F.col("race_id") == F.lit(race_id))
    return board.where(F.col("race_id").isNull())


def ranked(board: DataFrame) -> DataFrame:
    """Order inside each race by position, ties by driver name (``rank`` column).

    A race holds one row per driver here (already aggregated), so the window is small.
    """
    w = Window.partitionBy("race_id").orderBy("position", "driver_name")
    return board.withColumn("rank", F.row_number().over(w).cast("int"))


def bounded(positions: DataFrame, cap: int = CAP, chunk_offsets: int = capped.CHUNK) -> DataFrame:
    """The per-race list capped at ``cap`` entries with FIFO eviction of slots (see ``capped``)."""
    return capped.bounded(positions, cap, chunk_offsets)


def enrich(board: DataFrame, roster: DataFrame, selected_driver: str | None = None) -> DataFrame:
    """J5 + B18 + B25: roster lookup with display defaults, badge, selected flag."""
    ro = roster.select(F.col("name").alias("_rname"), F.col("team").alias("_rteam"),
                       F.col("team_color").alias("_rcolor"))
    j = board.join(ro, board.driver_name == ro._rname, "left")
    return j.select(
        *board.columns,
        F.coalesce(F.col("_rname"), F.lit(X.UNKNOWN_DRIVER)).alias("driver_label"),
        F.coalesce(F.col("_rteam"), F.lit(X.UNKNOWN_TEAM)).alias("team_label"),
        F.coalesce(F.col("_rcolor"), F.lit(X.DEFAULT_TEAM_COLOR)).alias("team_color"),
        X.badge("position").alias("badge"),
        (F.coalesce(F.col("driver_name") == F.lit(selected_driver), F.lit(False))
         if selected_driver else F.lit(False)).alias("is_selected"),
    )


def changes(positions: DataFrame, chunk_rows: int = OFFSET_CHUNK) -> DataFrame:
    """J7 + W2 + B19: messages whose position differs from the same driver's previous
    message in the race (arrival order); change = previous - current."""
    p = sequence.previous(positions, KEYS, ["arrival"], sequence.offset_chunk("arrival", chunk_rows),
                          ["position"])
    return (p.where(F.col("prev_position").isNotNull() & (F.col("prev_position") != F.col("position")))
            .withColumn("change", (F.col("prev_position") - F.col("position")).cast("int"))
            .withColumn("direction", X.change_direction("change")))


def baseline_delta(positions: DataFrame, since: int | None = None) -> DataFrame:
    """J6 + W3: each driver's position in the first snapshot that was seen is the baseline, never
    replaced; compared with the latest position. A driver that the first snapshot did not hold has none.

    The first snapshot is the board as it stood after offset ``since``, or, without it, after
    each race's first message."""
    if since is not None:
        seen = F.col("arrival") <= since
        g = positions.groupBy(*KEYS).agg(
            F.max_by(F.when(seen, F.col("position")), F.when(seen, F.col("arrival"))).alias("baseline_position"),
            F.max_by("position", "arrival").alias("position"))
    else:
        g = positions.groupBy(*KEYS).agg(
            F.min_by("position", "arrival").alias("_p"), F.min("arrival").alias("_a"),
            F.max_by("position", "arrival").alias("position"))
        # one row per driver here
        first = F.min("_a").over(Window.partitionBy("race_id"))
        g = g.withColumn("baseline_position", F.when(F.col("_a") == first, F.col("_p"))).select(*KEYS, "baseline_position", "position")
    return (g.withColumn("change", (F.col("baseline_position") - F.col("position")).cast("int"))
            .withColumn("direction", X.change_direction("change")))


def final_positions(board: DataFrame, finished: DataFrame, cap: int = CAP) -> DataFrame:
    """Final classification per finished race (``race_id`` of ``finished``) from the
    capped list.

    ``valid``: exactly ``cap`` rows, all positions in 1..cap (duplicates not checked, as in
    the behaviour reproduced); ``valid_strict`` also requires distinct positions.
    """
    b = board.join(finished.select("race_id"), "race_id", "left_semi")
    w = Window.partitionBy("race_id")
    in_range = F.col("position").between(1, cap)
    out = (b.withColumn("n", F.count(F.lit(1)).over(w))
           .withColumn("all_in_range", F.min(in_range.cast("int")).over(w) == 1)
           .withColumn("n_distinct", F.size(F.collect_set("position").over(w))))
    out = out.withColumn("valid", (F.col("n") == cap) & F.col("all_in_range"))
    out = out.withColumn("valid_strict", F.col("valid") & (F.col("n_distinct") == cap))
    return ranked(out.drop("n", "all_in_range", "n_distinct"))


def winner(final: DataFrame) -> DataFrame:
    """The row(s) in position 1."""
    return final.where(F.col("position") == 1)


def driver_result(final: DataFrame, driver_name: str) -> DataFrame:
    """The chosen driver's row."""
    return final.where(F.col("driver_name") == F.lit(driver_name))


def cents(c) -> F.Column:
    """Two-decimal measure as exact integer cents."""
    return F.round(X.col(c) * 100).cast("long")


def avg_speed(positions: DataFrame) -> DataFrame:
    """Average speed per (race, driver); exact integer sums (cents)."""
    g = positions.groupBy(*KEYS).agg(F.count("speed").alias("n"), F.sum(cents("speed")).alias("_s"))
    return g.select(*KEYS, "n", (F.col("_s").cast("double") / F.col("n").cast("double") / 100.0)
                    .alias("avg_speed"))


def avg_speed_tumbling(positions: DataFrame, width: str = "1 day") -> DataFrame:
    """G7 per tumbling event-time window."""
    g = positions.groupBy(*KEYS, F.window("ts", width).alias("w")).agg(
        F.count("speed").alias("n"), F.sum(cents("speed")).alias("_s"))
    return g.select(*KEYS,
                    F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "n", (F.col("_s").cast("double") / F.col("n").cast("double") / 100.0).alias("avg_speed"))
