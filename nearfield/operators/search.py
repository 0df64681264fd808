"""Search on graphs in rounds: all queries' candidates are one table, and each round expands the nearest open ones of every query.

Nothing of the graph or the vectors is broadcast or collected: a round is equi-joins of the frontier with edges and vectors.
A query's candidates are at most ``width`` rows, so that ranking them is a small group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import distance, parse_metric
from nearfield.sources.snapshots import cut

#: Open candidates that a query expands in a round.
EXPAND = 4


def _measured(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, metric: str) -> DataFrame:
    rows = pairs.join(queries.select("qid", F.col("vec").alias("_q")), "qid").join(vectors.select("vid", "vec"), "vid")
    return rows.select("qid", "vid", F.round(distance(metric, F.col("_q"), F.col("vec")), 6).alias("dist"), F.lit(True).alias("open"))


def _nearest(rows: DataFrame, count: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vid"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")


def beam(queries: DataFrame, edges: DataFrame, vectors: DataFrame, entries: DataFrame, width: int, metric: str = "l2", expand: int = EXPAND, stop: float | None = None, trace: list[DataFrame] | None = None) -> DataFrame:
    """qid, vid, dist: the ``width`` nearest found of each query once none of them is open.

    ``entries`` has qid, vid. What was pushed out of a query's candidates is farther than its last one, which only comes nearer;
    so a candidate met again is rejected by its distance and no list of visited vertices is kept. A query whose best is at most
    ``stop`` ends before it expands again. A ``trace`` gets a table for each round: qid, step, measured (distances of the round), vid, dist (the best).
    """
    vectors, edges = vectors.select("vid", "vec"), edges.select("src", "dst")
    state = cut(_nearest(_measured(entries.select("qid", "vid").distinct(), queries, vectors, metric), width))
    order, step = Window.partitionBy("qid").orderBy(F.desc("open"), "dist", "vid"), 0
    fresh = state

    def note(fresh: DataFrame, state: DataFrame) -> None:
        if trace is not None:
            best = state.groupBy("qid").agg(F.min(F.struct("dist", "vid")).alias("best"))
            many = fresh.groupBy("qid").agg(F.count("*").alias("measured"))
            trace.append(cut(best.join(many, "qid", "left").select("qid", F.lit(step).alias("step"), F.coalesce("measured", F.lit(0)).alias("measured"), "best.vid", "best.dist")))

    note(fresh, state)
    while True:
        if stop is not None:
            state = state.withColumn("open", F.col("open") & (F.min("dist").over(Window.partitionBy("qid")) > stop))
        if state.where("open").isEmpty():
            return state.select("qid", "vid", "dist")
        step += 1
        marked = state.withColumn("now", F.col("open") & (F.row_number().over(order) <= min(expand, width)))
        steps = marked.where("now").join(edges.withColumnRenamed("src", "vid"), "vid").select("qid", F.col("dst").alias("vid")).distinct()
        met = steps.join(state.select("qid", "vid"), ["qid", "vid"], "left_anti")
        fresh = _measured(met, queries, vectors, metric)
        fresh = cut(fresh) if trace is not None else fresh
        stay = marked.select("qid", "vid", "dist", (F.col("open") & ~F.col("now")).alias("open"))
        state = cut(_nearest(stay.unionByName(fresh), width))
        note(fresh, state)


def random_entries(queries: DataFrame, pool: DataFrame, count: int = 1, seed: int = 0) -> DataFrame:
    """qid, vid: ``count`` draws by hash from the pool (vid) for each query; a draw that comes twice stays once."""
    n = pool.count()
    slots = pool.groupBy(F.pmod(F.xxhash64(F.lit(seed), "vid"), F.lit(max(n, 1))).alias("slot")).agg(F.min("vid").alias("vid"))
    # slots that no vertex has are passed on to the next one that has: there are enough draws to meet some
    draws = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(8 * count + 56))).alias("draw"))
    drawn = draws.withColumn("slot", F.pmod(F.xxhash64(F.lit(seed + 1), "qid", "draw"), F.lit(max(n, 1)))).join(slots, "slot")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("draw"))
    return drawn.groupBy("qid", "vid").agg(F.min("draw").alias("draw")).withColumn("rank", rank).where(F.col("rank") <= count).select("qid", "vid")


def strided_entries(queries: DataFrame, pool: DataFrame, count: int) -> DataFrame:
    """qid, vid: for all queries the same vertices, spread evenly over the pool by the order of a hash."""
    n = pool.count()
    slot = F.pmod(F.xxhash64(F.lit(3), "vid"), F.lit(max(1, min(count, n))))
    chosen = pool.groupBy(slot.alias("slot")).agg(F.min("vid").alias("vid")).select("vid")  # ``count`` rows at most
    return queries.select("qid").join(F.broadcast(chosen))


def warm_entries(rows: DataFrame, queries: DataFrame, own: str = "near") -> DataFrame:
    """qid, vid: the row (src, dst) of the vertex that each query names in the column ``own``."""
    return queries.select("qid", F.col(own).alias("src")).join(rows.select("src", F.col("dst").alias("vid")), "src").select("qid", "vid")


def search_flat(queries: DataFrame, edges: DataFrame, vectors: DataFrame, entries: DataFrame, k: int, width: int, metric: str = "l2") -> DataFrame:
    """qid, rank, vid, dist of the k nearest found."""
    if width < k:
        raise ValueError("the width of the search must be k at least")
    found = beam(queries, edges, vectors, entries, width, metric)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "vid", "dist")


def descend(queries: DataFrame, layers: DataFrame, vectors: DataFrame, entry: DataFrame, top: int, metric: str = "l2", stops: dict[int, float] | None = None, trace: dict[int, list[DataFrame]] | None = None) -> DataFrame:
    """qid, vid: greedy walks from ``entry`` (one row, vid) down the levels above the bottom, each with its own ``stops`` if there are any."""
    at = queries.select("qid").join(F.broadcast(entry.select("vid").limit(1)))  # one row
    for level in range(top, 0, -1):
        noted = None if trace is None else trace.setdefault(level, [])
        stop = (stops or {}).get(level)
        stop = stop * stop if stop is not None and parse_metric(metric) == "l2sqr" else stop
        at = beam(queries, layers.where(F.col("level") == level), vectors, at, 1, metric, 1, stop, noted).select("qid", "vid")
    return at


def search_layered(queries: DataFrame, layers: DataFrame, vectors: DataFrame, entry: DataFrame, top: int, k: int, width: int, metric: str = "l2", stops: dict[int, float] | None = None) -> DataFrame:
    """Greedy walks down the upper levels, then a beam on the bottom. ``layers``: level, src, dst. ``stops``: level to distance, see plans.config.early_stop."""
    if width < k:
        raise ValueError("the width of the search must be k at least")
    at = descend(queries, layers, vectors, entry, top, metric, stops)
    return search_flat(queries, layers.where("level = 0"), vectors, at, k, width, metric)


def search_bottom(queries: DataFrame, layers: DataFrame, vectors: DataFrame, k: int, width: int, entry: DataFrame | None = None, metric: str = "l2", seed: int = 0) -> DataFrame:
    """The bottom alone, from ``entry`` (one row, vid) or from ``width`` random seeds: what the upper levels are measured against."""
    entries = random_entries(queries, vectors.select("vid"), width, seed) if entry is None else queries.select("qid").join(F.broadcast(entry.select("vid").limit(1)))
    return search_flat(queries, layers.where("level = 0"), vectors, entries, k, width, metric)


def trajectory(trace: list[DataFrame], truth: DataFrame) -> DataFrame:
    """qid, step, measured (distances so far), ratio (of the best to the true one) where a round improved; queries of true distance 0 are left out."""
    rows = trace[0]
    for one in trace[1:]:
        rows = rows.unionByName(one)
    own = Window.partitionBy("qid").orderBy("step")
    rows = rows.withColumn("measured", F.sum("measured").over(own)).withColumn("_was", F.lag("dist").over(own))
    true = truth.where("rank = 1 AND dist > 0").select("qid", F.col("dist").alias("_true"))
    return rows.where("_was IS NULL OR dist < _was").join(true, "qid").select("qid", "step", "measured", (F.col("dist") / F.col("_true")).alias("ratio"))


def adopted_edges(trace: dict[int, list[DataFrame]], vectors: DataFrame, metric: str = "l2") -> DataFrame:
    """level, moves, mean_length of the edges by which greedy walks moved on each level."""
    out = None
    for level, rounds in trace.items():
        rows = rounds[0]
        for one in rounds[1:]:
            rows = rows.unionByName(one)
        was = F.lag("vid").over(Window.partitionBy("qid").orderBy("step"))
        moves = rows.withColumn("was", was).where("was IS NOT NULL AND was <> vid").select("was", "vid")
        left, right = vectors.select(F.col("vid").alias("was"), F.col("vec").alias("_a")), vectors.select("vid", F.col("vec").alias("_b"))
        length = moves.join(left, "was").join(right, "vid").select(distance(metric, F.col("_a"), F.col("_b")).alias("length"))
        one = length.agg(F.count("*").alias("moves"), F.avg("length").alias("mean_length")).select(F.lit(level).alias("level"), "moves", "mean_length")
        out = one if out is None else out.unionByName(one)
    return out
