"""Steps on graph edges (src, dst, dist, is_new): what a refinement superstep is made of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.rows import Row, by_vertex

EDGE = [("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())]


def reverse(edges: DataFrame) -> DataFrame:
    """For each edge the one back, as new."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", F.lit(True).alias("is_new"))


def merge_logs(edges: DataFrame, logs: DataFrame) -> DataFrame:
    """Union; of equal (src, dst) one stays, as old if any was."""
    return edges.unionByName(logs).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("is_new").alias("is_new"))


def truncate(edges: DataFrame, degree: int, limit: float | None = None) -> DataFrame:
    """The ``degree`` nearest neighbours of each vertex, within an inclusive distance."""
    kept = edges if limit is None else edges.where(F.col("dist") <= limit)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return kept.withColumn("_rank", rank).where(F.col("_rank") <= degree).drop("_rank")


def symmetric(edges: DataFrame) -> DataFrame:
    return merge_logs(edges, reverse(edges))


def degrees(edges: DataFrame) -> DataFrame:
    """degree, vertices."""
    return edges.groupBy("src").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("vertices"))


def threshold(d, rule: str, alpha: float, shift: float):
    """What a kept neighbour's distance to a candidate must be under for the candidate to go."""
    return {"origin": d, "scaled": d / alpha, "shifted": d - shift, "scaled_shifted": d / alpha - shift}[rule]


def prune(candidates: DataFrame, vectors: DataFrame, alpha: float = 1.0, shift: float = 0.0, rule: str = "scaled", degree: int | None = None, skip_old: bool = False) -> DataFrame:
    """Relative-neighbourhood pruning: candidates of a pivot from near to far; one goes if a kept one is nearer to it than its threshold.

    A pivot's candidates are bounded by what made them (a degree, k or a radius). Distances are l2. A kept one strikes out, at once, all
    later candidates that it is nearer to than their thresholds. With ``skip_old`` two candidates that are both not ``is_new`` are not compared again.
    """

    def keep(row: Row) -> list[tuple]:
        src, dst, d, new, v = row
        limit = threshold(d, rule, alpha, shift)
        alive, kept = np.ones(len(d), dtype=bool), []
        for c in range(len(d)):
            if not alive[c]:
                continue
            if degree is not None and len(kept) >= degree:
                break
            kept.append((src, dst[c], d[c]))
            later = np.flatnonzero(alive[c + 1 :]) + c + 1
            if not new[c]:
                later = later[new[later]]
            gap = v[later] - v[c]
            alive[later[np.sqrt(np.einsum("ij,ij->i", gap, gap)) < limit[later]]] = False
        return kept

    new = F.col("is_new") if skip_old else F.lit(True).alias("is_new")
    return by_vertex(candidates.select("src", "dst", "dist", new), vectors, keep, EDGE, "src long, dst long, dist double")


def row_faults(edges: DataFrame, vertices: int, degree: int | None = None) -> DataFrame:
    """One row of counts that a sound graph has at 0: loops, repeats, outside, not_numbers, and rows longer than ``degree``."""
    rows = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.max(F.isnan("dist") | F.col("dist").isNull()).alias("bad"))
    ends = (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= vertices)
    counts = rows.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.col("n") > 1).alias("repeats"), F.count_if(ends).alias("outside"), F.count_if("bad").alias("not_numbers"))
    long = edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > degree).alias("too_long") if degree is not None else F.lit(0).cast("long").alias("too_long"))
    return counts.join(F.broadcast(long))  # one row


def written_back(edges: DataFrame, level: int, upper: int, bottom: int) -> DataFrame:
    """level, src, dst, dist: a flat graph as a layer, rows cut to the capacity of the level."""
    return truncate(edges, upper if level else bottom).select(F.lit(level).alias("level"), "src", "dst", "dist")


def taken_from(layers: DataFrame, level: int, degree: int) -> DataFrame:
    """src, dst, dist, is_new: a layer as a flat graph whose edges are old, rows cut to ``degree``."""
    return truncate(layers.where(F.col("level") == level).select("src", "dst", "dist", F.lit(False).alias("is_new")), degree)
