"""Small dimensions: teams, first driver per team.

Dimension joins carry no hint. Spark broadcasts a side only below its threshold, from the
file sizes it reads with each plan or from the sizes adaptive execution measures, and
shuffles it otherwise; a dimension that changes or grows is read anew by the next query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def teams(df: DataFrame, team_col: str = "team_name") -> DataFrame:
    """Distinct teams (partial aggregation before the shuffle)."""
    return df.select(F.col(team_col).alias("team_name")).where(F.col("team_name").isNotNull()).distinct()


def team_lead(roster: DataFrame) -> DataFrame:
    """First driver of each team in roster order: (team, lead_driver)."""
    return roster.groupBy("team").agg(F.min_by("name", "id").alias("lead_driver"))
