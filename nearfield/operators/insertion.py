"""Online insertion into layered graphs over nets.

A net of level h holds members of the level below of which no two lie within its radius, and which cover all others within it. A batch is inserted
without building any net anew: a vector descends the levels with a beam, and goes up to below the lowest level on which it finds a member within
the radius. What the beams find is evidence that a vector is covered; that it is not covered is settled exactly, for the few that seem so, by a join with the members of the level. Those that are left propose
themselves; of any that lie within the radius of each other the first by a hash stays and the others are vetoed, in rounds, as if they came one after the other.

Edges of a new member of a level: the nearest that a wide beam finds there, which goes on from where the descent ended, and the nearest of the batch itself; pruned; with edges
back, and rows that overflow pruned again. Rows that get no edge stay as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import compact
from nearfield.operators.edges import merge_logs, prune, reverse, truncate
from nearfield.operators.knn import knn, range_counts
from nearfield.operators.rnets import ordered_net
from nearfield.plans.config import NetConfig
from nearfield.sources.snapshots import cut, released

#: Vectors that are inserted at once; among them all pairs are compared, block by block.
WAVE = 1 << 16
NO_EDGES, NO_LEVELS = "level int, src long, dst long, dist double", "vid long, highest_level int"


class Layered(NamedTuple):
    """A layered graph: edges (level, src, dst, dist), levels (vid, highest_level), vectors (vid, vec), the entry and the top level; -1 while empty."""

    layers: DataFrame
    levels: DataFrame
    vectors: DataFrame
    entry: int
    top: int


class Caps(NamedTuple):
    """Lengths of rows above and on the bottom, widths of the beams of the descent and of the choice of neighbours, and how sparse rows are."""

    upper: int = 32
    bottom: int = 64
    descent: int = 30
    upper_choice: int = 100
    bottom_choice: int = 100
    alpha: float = 1.05


def empty(vectors: DataFrame) -> Layered:
    """A graph without vertices, for vectors like these."""
    spark = vectors.sparkSession
    return Layered(spark.createDataFrame([], NO_EDGES), spark.createDataFrame([], NO_LEVELS), vectors.select("vid", "vec").limit(0), -1, -1)


def members(vectors: DataFrame, levels: DataFrame, level: int) -> DataFrame:
    return vectors.select("vid", "vec").join(levels.where(F.col("highest_level") >= level).select("vid"), "vid", "left_semi")


def uncovered(rows: DataFrame, centres: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """The rows (vid, vec) that have no centre within the radius; exact."""
    met = range_counts(centres, rows.withColumnRenamed("vid", "qid"), radius, metric, exclude_self=False)
    return rows.join(met.select(F.col("qid").alias("vid")), "vid", "left_anti")


def promoted(graph: Layered, batch: DataFrame, net: NetConfig, most: int, near: dict[int, DataFrame] | None = None, metric: str = "l2") -> DataFrame:
    """vid, highest_level of a batch (vid, vec) by the cover rule, so that all nets stay nets; at most level ``most``.

    ``near`` has for a level the distance (vid, dist) to a member that is known already; such vertices are not compared with the level again.
    """
    left = batch.select("vid", "vec")
    out = left.select("vid", F.lit(0).alias("highest_level"))
    for level in range(1, most + 1):
        radius = net.radius(level)
        if level <= graph.top:
            if near and level in near:
                left = left.join(near[level].where(F.col("dist") <= radius), "vid", "left_anti")
            left = cut(uncovered(cut(left), members(graph.vectors, graph.levels, level), radius, metric))
            if left.isEmpty():
                break
        chosen = ordered_net(left, radius, F.xxhash64("vid"), metric)
        out = out.unionByName(chosen.select("vid", F.lit(level).alias("highest_level")))
        left = left.join(chosen, "vid", "left_semi")
        if level > graph.top and chosen.count() <= 1:
            break
    return out.groupBy("vid").agg(F.max("highest_level").alias("highest_level"))


def linked(edges: DataFrame, vectors: DataFrame, fresh: DataFrame, cap: int, alpha: float) -> DataFrame:
    """src, dst, dist of a level with candidates (src, dst, dist) of fresh vertices pruned and linked both ways, rows at most ``cap``."""
    rows = cut(prune(fresh, vectors, alpha, degree=cap).withColumn("is_new", F.lit(True)))
    both = cut(merge_logs(edges.select("src", "dst", "dist", F.lit(False).alias("is_new")).unionByName(rows), reverse(rows)))
    full = both.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("src")
    again = truncate(prune(both.join(full, "src", "left_semi"), vectors, alpha, degree=cap), cap)
    return both.join(full, "src", "left_anti").select("src", "dst", "dist").unionByName(again)


def packed(graph: Layered, caps: Caps) -> DataFrame:
    return cut(compact.pack_layers(graph.layers, graph.levels, graph.vectors, caps.upper, caps.bottom, graph.top))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select("qid", F.explode("found").alias("one")).select("qid", "one.vid", "one.dist")


def descent(graph: Layered, asked: DataFrame, parts: DataFrame, caps: Caps, metric: str = "l2") -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """For each level the entries (qid, vec, entries) that the descent leaves there, and the distance (vid, dist) to the nearest it found above the bottom.

    The state of a level is forked to the next one; the bottom is not searched, its entries are what was found above it.
    """
    starts, near, at = {}, {}, compact.from_one(asked, graph.entry)
    for level in range(graph.top, 0, -1):
        found = cut(compact.searched(at, parts.where(F.col("level") == level), caps.descent, metric))
        near[level] = found.where(F.size("found") > 0).select(F.col("qid").alias("vid"), F.col("found")[0]["dist"].alias("dist"))
        starts[level] = at = compact.reopened(found)
    starts[0] = at
    return starts, near


def insert_wave(graph: Layered, batch: DataFrame, net: NetConfig | None, most: int, caps: Caps = Caps(), bottom: bool = True, metric: str = "l2", rise: DataFrame | None = None) -> Layered:
    """The graph with a batch (vid, vec) of new ids. Without ``bottom`` the bottom gets no edges, for one that is refined afterwards.

    Levels follow from the net, or are given by ``rise`` (vid, highest_level).
    """
    batch = cut(batch.select("vid", "vec"))
    starts, near, parts = {}, {}, None
    if graph.top >= 0:
        parts = packed(graph, caps)
        starts, near = descent(graph, batch.select(F.col("vid").alias("qid"), "vec"), parts, caps, metric)
    rise = cut(promoted(graph, batch, net, most, near, metric) if rise is None else rise)
    levels, vectors = cut(graph.levels.unionByName(rise)), cut(graph.vectors.unionByName(batch))
    top = max(graph.top, rise.agg(F.max("highest_level")).first()[0] or 0)
    out = None
    for level in range(top + 1):
        one = graph.layers.where(F.col("level") == level).select("src", "dst", "dist")
        if level or bottom:
            wide, cap = (caps.upper_choice, caps.upper) if level else (caps.bottom_choice, caps.bottom)
            fresh = members(batch, rise, level).withColumnRenamed("vid", "qid")
            candidates = knn(fresh.withColumnRenamed("qid", "vid"), fresh, wide, metric, exclude_self=True).select("qid", "vid", "dist")
            if level in starts:
                begun = starts[level].join(fresh.select("qid"), "qid", "left_semi")
                candidates = candidates.unionByName(_pairs(compact.searched(begun, parts.where(F.col("level") == level), wide, metric)))
            candidates = candidates.select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist")
            one = linked(one, vectors, truncate(candidates, wide), cap, caps.alpha)
        one = one.select(F.lit(level).alias("level"), "src", "dst", "dist")
        out = one if out is None else out.unionByName(one)
    entry = graph.entry if top == graph.top else levels.where(F.col("highest_level") == top).agg(F.min("vid")).first()[0]
    done = Layered(cut(out), levels, vectors, entry, top)
    if parts is not None:
        released(parts)
    return done


def insert(graph: Layered, batch: DataFrame, net: NetConfig, most: int, caps: Caps = Caps(), bottom: bool = True, metric: str = "l2", wave: int = WAVE, first: int = 1024) -> Layered:
    """Inserts a batch in waves of at most ``wave`` vectors, dealt by a hash of the id; into an empty graph the first waves are ``first`` and then double.

    Waves keep what is compared within a batch bounded, and let most vectors find their neighbours on the graph.
    """
    n, have, done = batch.count(), graph.vectors.count(), 0
    share = F.pmod(F.xxhash64(F.lit(11), "vid"), F.lit(1 << 30)) / float(1 << 30)
    batch = cut(batch.select("vid", "vec", share.alias("share")))
    while done < n:
        size = min(wave, max(first, have + done), n - done)
        low, high = done / n, (done + size) / n if done + size < n else 2.0
        some = batch.where((F.col("share") >= low) & (F.col("share") < high)).drop("share")
        if not some.isEmpty():
            graph = insert_wave(graph, some, net, most, caps, bottom, metric)
        done += size
    return graph


def found_by(graph: Layered, queries: DataFrame, k: int, width: int, caps: Caps = Caps(), stops: dict[int, float] | None = None, metric: str = "l2") -> DataFrame:
    """qid, rank, vid, dist of the k nearest found on the graph."""
    return compact.search_layered(queries, packed(graph, caps), graph.entry, graph.top, k, width, metric, stops)
