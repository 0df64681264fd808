"""Supersteps over neighbour rows: an updater rewrites rows and logs edges, which are merged into the rows after the step.

An updater is any function of (edges, vectors) that returns (rows, logs): edges (src, dst, dist, is_new) of the vertices it was given,
and edges of whichever vertices, or None. New ones need no more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import edges as steps
from nearfield.operators import refine
from nearfield.sources.snapshots import cut

Updater = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


def reverse(rows: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows, steps.reverse(rows)


def truncate(degree: int, limit: float | None = None) -> Updater:
    return lambda rows, vectors: (steps.truncate(rows, degree, limit), None)


def triangle(alpha: float = 1.0, shift: float = 0.0) -> Updater:
    def work(rows: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = cut(refine.triangle(rows, vectors, alpha, shift))
        return both.where("NOT is_new"), both.where("is_new")  # what stays is old, what is recommended is new

    return work


def pruning(alpha: float = 1.0, shift: float = 0.0, rule: str = "scaled", degree: int | None = None, skip_old: bool = False) -> Updater:
    def work(rows: DataFrame, vectors: DataFrame) -> tuple[DataFrame, None]:
        return steps.prune(rows, vectors, alpha, shift, rule, degree, skip_old).withColumn("is_new", F.lit(False)), None

    return work


def random_top_up(target: int, seed: int = 0) -> Updater:
    return lambda rows, vectors: (rows, refine.topped_up(rows, vectors, target, seed, rows.select(F.col("src").alias("vid")).distinct()).where("is_new"))


def step(edges: DataFrame, vectors: DataFrame, updater: Updater, first: int | None = None, last: int | None = None) -> DataFrame:
    """Edges after one step; with ``first`` and ``last`` only the rows of these vertices are rewritten, but all logs are merged."""
    mine = F.lit(True)
    if first is not None:
        mine = mine & (F.col("src") >= first)
    if last is not None:
        mine = mine & (F.col("src") <= last)
    rows, logs = updater(edges.where(mine), vectors)
    out = rows.unionByName(edges.where(~mine))
    return out if logs is None else steps.merge_logs(out, logs)


def run(edges: DataFrame, vectors: DataFrame, updaters: Sequence[Updater], times: int = 1) -> DataFrame:
    """The updaters one after the other, as often as asked; lineage is cut after each turn."""
    for _ in range(times):
        for updater in updaters:
            edges = step(edges, vectors, updater)
        edges = cut(edges)
    return edges
