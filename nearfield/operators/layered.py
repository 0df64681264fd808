"""Layered graphs: one graph a level, over nets or random hierarchies. All give (layers, entry, top)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.edges import prune, reverse, merge_logs, taken_from, truncate, written_back
from nearfield.operators.knn import knn
from nearfield.operators.levels import LEAST, compacted
from nearfield.operators.refine import convergent_graph, refine_layer
from nearfield.operators.probes import medoid
from nearfield.sources.snapshots import cut


def build(vectors: DataFrame, levels: DataFrame, degree: int, **options) -> tuple[DataFrame, DataFrame, int]:
    """(layers, entry, top): level, src, dst, dist; the medoid of the top level; the number of the top level, after compaction."""
    levels = cut(compacted(levels))
    top = levels.agg(F.max("highest_level")).first()[0] or 0
    layers = []
    for level in range(top + 1):
        members = cut(vectors.join(levels.where(F.col("highest_level") >= level).select("vid"), "vid", "left_semi"))
        graph = convergent_graph(members, degree if level else 2 * degree, **options)
        layers.append(graph.select(F.lit(level).alias("level"), "src", "dst", "dist"))
        last = members
    out = layers[0]
    for one in layers[1:]:
        out = out.unionByName(one)
    return out, cut(medoid(last).select("vid")), top


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def _members(vectors: DataFrame, levels: DataFrame, level: int) -> DataFrame:
    return cut(vectors.select("vid", "vec").join(levels.where(F.col("highest_level") >= level).select("vid"), "vid", "left_semi"))


def refined(vectors: DataFrame, levels: DataFrame, upper: int, bottom: int, alpha: float, shift: float = 0.0, rho: float = 1.0, loops: int = 2, triangles: int = 2, routing: int = 2, prefill: float = 1.0, seed: int = 0, old: DataFrame | None = None, fresh: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Layers over nets (the levels), each refined by supersteps: the shift, times the bottom distance ``rho``, holds on the bottom only.

    Levels of fewer than ``LEAST`` members are not refined: their members are joined with all others of the level.
    With ``old`` layers, and ``fresh`` vertices (vid) that these do not have, the old rows are where refinement starts.
    """
    levels = cut(levels)
    top, layers = levels.agg(F.max("highest_level")).first()[0] or 0, []
    for level in range(top + 1):
        members, degree = _members(vectors, levels, level), upper if level else bottom
        if level and members.count() < LEAST:
            near = knn(members, members.withColumnRenamed("vid", "qid"), LEAST, exclude_self=True)
            graph = near.select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist")
        else:
            start = None if old is None else taken_from(old, level, degree + degree // 2)
            graph = refine_layer(members, degree, alpha, 0.0 if level else shift * rho, loops, triangles, routing, prefill, seed + level, start, fresh)
        layers.append(written_back(graph, level, upper, bottom))
    entry = cut(medoid(members).select("vid"))
    return cut(_union(layers)), entry, top


def stacked(vectors: DataFrame, levels: DataFrame, upper: int, bottom: int, alpha: float, candidates: int = 100) -> tuple[DataFrame, DataFrame, int]:
    """Layers over nets without supersteps: each level's candidates are its nearest members; pruned, edges back, and full rows pruned again."""
    levels = cut(levels)
    top, layers = levels.agg(F.max("highest_level")).first()[0] or 0, []
    for level in range(top + 1):
        members, degree = _members(vectors, levels, level), upper if level else bottom
        near = knn(members, members.withColumnRenamed("vid", "qid"), candidates, exclude_self=True).select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist")
        kept = prune(near, members, alpha, degree=degree).withColumn("is_new", F.lit(False))
        both = cut(merge_logs(kept, reverse(kept)))
        full = both.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > degree).select("src")
        again = prune(both.join(full, "src", "left_semi"), members, alpha, degree=degree)
        layers.append(written_back(both.join(full, "src", "left_anti").select("src", "dst", "dist").unionByName(again), level, upper, bottom))
    entry = cut(medoid(members).select("vid"))
    return cut(_union(layers)), entry, top
