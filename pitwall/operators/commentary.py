"""Commentary: generation from position messages, filtering, dedupe, recent list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.functions import exprs as X
from pitwall.operators import ai


def generate(positions: DataFrame, model: ai.ModelSpec = ai.COMMENTARY_MODEL) -> DataFrame:
    """B1-B4 + J1: one comment per position message.

    id = 'comment-' + epoch seconds + '-' + name with spaces as '_' (event clock, so a
    replay gives the same ids; ids are not unique within a second); message = model
    completion of the prompt; timestamp = event time in ms; type from the position.
    """
    p = positions.select("arrival", "ts", "race_id", "driver_name", "position",
                         X.commentary_prompt("driver_name", "position").alias("_prompt"))
    p = ai.complete(p, "_prompt", "_completion", model)
    return p.select(
        X.comment_id(F.unix_seconds("ts"), "driver_name").alias("id"),
        F.col("_completion").alias("message"),
        X.ts_to_ms("ts").alias("timestamp"),
        X.comment_type("position").alias("type"),
        "arrival", "race_id", "driver_name")


def with_mentions(comments: DataFrame, driver_name: str | None, out: str = "mentions") -> DataFrame:
    """Does the message name the driver (see ``exprs.mentions``)."""
    return comments.withColumn(out, X.mentions("message", F.lit(driver_name).cast("string")))


def dedupe(comments: DataFrame, key: str = "id", order=("arrival",)) -> DataFrame:
    """First comment per id (by arrival); partial aggregation, skew-safe."""
    rest = [c for c in comments.columns if c != key]
    return (comments.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
            .select(key, "_f.*"))


def recent(comments: DataFrame, n: int = 50, order=("arrival",)) -> DataFrame:
    """The last ``n`` comments by arrival."""
    return comments.orderBy(*[F.col(c).desc() for c in order]).limit(n)
