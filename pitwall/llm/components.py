"""Connected components of a link table by alternating large-star and small-star steps.

Nodes are 64-bit ids. Every step is one aggregation and one join, written to the shared folder, so
no node's links meet in one task's memory and lineage stays short; a step's table is removed once the next is written. The steps end when the
edge set no longer changes; each component is then a star around its smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm import common as C
from pitwall.session import remove


def _signature(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest id reachable from each linked node."""
    edges, at = C.stored_at(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    was = _signature(edges)
    while was[0]:
        # large star: larger neighbours move to the node's smallest neighbour (or the node itself)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges, large = C.stored_at(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        remove(links.sparkSession, at)
        # small star: a node and its smaller neighbours move to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(least, "a")
        edges, at = C.stored_at(near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
                                .filter("a != b").distinct(), "small-star")
        remove(links.sparkSession, large)
        now = _signature(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
