"""Connected components of a table of links, by alternating large-star and small-star steps.

Nothing is collected: a step is a minimum by vertex (with partial minima) and a join, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b), a > b: each vertex's greater (large) or lesser neighbours are hung on its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = materialize(least, "star-least").withColumnRenamed("a", "_a")
    rows = both.join(least, F.col("a") == F.col("_a"))
    if large:
        out = rows.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = rows.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return materialize(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every vertex of links (a, b) that is not itself the least."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = None
    while True:
        edges = _star(_star(edges, True), False)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        sign = now
