"""Probes of a data set: distance quantiles, aspect ratio, intrinsic dimension, centroid and medoid."""

from __future__ import annotations

import math
import time
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import distance
from nearfield.operators.knn import knn
from nearfield.sources.snapshots import cut

QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
PAIR_QUANTILES = (0.0, 0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 1.0)


def floor_quantiles(rows: DataFrame, value: str, keys: list[str], quantiles=QUANTILES) -> DataFrame:
    """keys, quantile, value: the element at place floor(q * m) in order, the last at most; nothing is interpolated.

    Groups are of sampled rows (one a query), so that a window by key stays small.
    """
    window = Window.partitionBy(*keys)
    placed = rows.withColumn("_place", F.row_number().over(window.orderBy(value)) - 1).withColumn("_n", F.count("*").over(window))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    return placed.select(*keys, value, "_place", "_n", wanted.alias("quantile")).where(F.col("_place") == F.least(F.floor(F.col("quantile") * F.col("_n")), F.col("_n") - 1)).select(*keys, "quantile", value)


def nearest(base: DataFrame, sample: DataFrame, ranks: int, metric: str = "l2", quantiles=QUANTILES) -> DataFrame:
    """rank, quantile, dist over the sampled rows' neighbours, themselves left out."""
    return floor_quantiles(knn(base, sample, ranks, metric, exclude_self=True), "dist", ["rank"], quantiles)


def farthest(base: DataFrame, sample: DataFrame, metric: str = "l2", quantiles=QUANTILES) -> DataFrame:
    rows = knn(base, sample, 1, metric, farthest=True).select(F.lit("farthest").alias("probe"), "dist")
    return floor_quantiles(rows, "dist", ["probe"], quantiles)


def aspect_ratio(base: DataFrame, sample: DataFrame, metric: str = "l2") -> DataFrame:
    """One row: largest farthest over smallest nearest distance, and median over median; infinite without a positive nearest."""
    near = floor_quantiles(knn(base, sample, 1, metric, exclude_self=True).select(F.lit(1).alias("p"), "dist"), "dist", ["p"], (0.0, 0.5))
    far = floor_quantiles(knn(base, sample, 1, metric, farthest=True).select(F.lit(1).alias("p"), "dist"), "dist", ["p"], (0.5, 1.0))
    pick = lambda rows, q, name: rows.where(F.col("quantile") == q).select(F.col("p"), F.col("dist").alias(name))
    rows = pick(far, 1.0, "most").join(pick(near, 0.0, "least"), "p").join(pick(far, 0.5, "far"), "p").join(pick(near, 0.5, "near"), "p")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(float("inf")))
    return rows.select(ratio("most", "least").alias("worst"), ratio("far", "near").alias("median"))


def intrinsic_dimension(base: DataFrame, queries: DataFrame, ranks: tuple[int, int, int], metric: str = "l2") -> DataFrame:
    """One row, lid: mean over queries of an estimate from the distances at three ranks i < j < k."""
    i, j, k = ranks
    rows = knn(base, queries, k, metric).where(F.col("rank").isin(i, j, k))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("dist")))
    r = rows.groupBy("qid").agg(at(i).alias("ri"), at(j).alias("rj"), at(k).alias("rk"))
    a, b = F.col("rj") - F.col("ri"), F.col("rk") - F.col("rj")
    ln = lambda x, y: F.log(x / y)
    top = b * ln(F.lit(float(k)), F.lit(float(j))) + a * ln(F.lit(float(j)), F.lit(float(i)))
    low = b * ln(F.col("rk"), F.col("rj")) + a * ln(F.col("rj"), F.col("ri"))
    return r.agg(F.round(F.avg(top / low), 6).alias("lid"))


def centroid(vectors: DataFrame) -> DataFrame:
    """pos, value: the mean of each coordinate."""
    return vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


def medoid(vectors: DataFrame, metric: str = "l2") -> DataFrame:
    """One row, vid and dist: the vector nearest to the centroid, the least vid of equal ones."""
    middle = vectors.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("value"))
    row = middle.agg(F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("c"))  # a number for each coordinate
    d: Column = F.round(distance(metric, F.col("vec"), F.col("c")), 6)
    return vectors.join(F.broadcast(row)).select("vid", d.alias("dist")).agg(F.min(F.struct("dist", "vid")).alias("m")).select("m.vid", "m.dist")


def pair_distances(vectors: DataFrame, other: Column, metric: str = "l2") -> DataFrame:
    """vid, other, dist of sampled pairs: each vector and the one whose id the expression gives."""
    right = vectors.select(F.col("vid").alias("other"), F.col("vec").alias("_vec"))
    return vectors.withColumn("other", other).join(right, "other").select("vid", "other", F.round(distance(metric, F.col("vec"), F.col("_vec")), 6).alias("dist"))


def ground_truth(truth: DataFrame, base: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """qid, rank, vid, dist: a given truth (qid, vid) with distances computed anew, ranked by them."""
    rows = truth.select("qid", "vid").join(base.select("vid", F.col("vec").alias("_b")), "vid").join(queries.select("qid", F.col("vec").alias("_q")), "qid")
    rows = rows.select("qid", "vid", F.round(distance(metric, F.col("_q"), F.col("_b")), 6).alias("dist"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "vid"))).select("qid", "rank", "vid", "dist")


def query_probe(truth: DataFrame, base: DataFrame, queries: DataFrame, metric: str = "l2", quantiles=QUANTILES) -> DataFrame:
    """rank, quantile, dist over the queries' true neighbours."""
    return floor_quantiles(ground_truth(truth, base, queries, metric), "dist", ["rank"], quantiles)


def pairs_sampled(quantile: float, confidence: float, error: float) -> int:
    """How many pair distances put a quantile within a relative error with a confidence."""
    if not (0 < quantile <= 1 and 0 < confidence < 1 and error > 0):
        raise ValueError("a sample size needs a quantile in (0, 1], a confidence in (0, 1) and a positive error")
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    return math.ceil(z * z * (1 - quantile) / (quantile * error * error))


def sampled_pairs(vectors: DataFrame, pairs: int, seed: int = 0, metric: str = "l2") -> DataFrame:
    """pair, vid, other, dist: pairs drawn by hash with replacement from vectors numbered 0 to n - 1; a vector may meet itself."""
    n = vectors.count()
    draw = lambda side: F.pmod(F.xxhash64(F.lit(seed), F.lit(side), "id"), F.lit(max(n, 1)))
    drawn = vectors.sparkSession.range(pairs).select(F.col("id").alias("pair"), draw(0).alias("vid"), draw(1).alias("other"))
    right = vectors.select(F.col("vid").alias("other"), F.col("vec").alias("_vec"))
    return drawn.join(vectors.select("vid", "vec"), "vid").join(right, "other").select("pair", "vid", "other", F.round(distance(metric, F.col("vec"), F.col("_vec")), 6).alias("dist"))


def pair_quantiles(rows: DataFrame, quantiles=PAIR_QUANTILES) -> DataFrame:
    """quantile, dist of pair distances (dist): by counts of equal distances, so that no task gets all pairs.

    The place of each distinct distance is its count plus the counts before it: those of its range, and whole ranges before.
    """
    counts = cut(rows.groupBy("dist").agg(F.count("*").alias("n")))
    parts = cut(counts.repartitionByRange("dist").select("dist", "n", F.spark_partition_id().alias("_part")))
    before = sorted(tuple(r) for r in parts.groupBy("_part").agg(F.sum("n")).collect())  # a row for each range
    total, starts = 0, []
    for part, n in before:
        starts.append((part, total))
        total += n
    known = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    run = F.sum("n").over(Window.partitionBy("_part").orderBy("dist"))
    placed = parts.withColumn("_run", run).join(F.broadcast(known), "_part").select("dist", (F.col("_start") + F.col("_run")).alias("upto"), "n")
    wanted = [(float(q), min(math.floor(q * total), total - 1)) for q in quantiles] if total else []
    asked = rows.sparkSession.createDataFrame(wanted, "quantile double, place long")
    return placed.join(F.broadcast(asked), (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))).select("quantile", "dist")


def percentiles(seconds: list[float], quantiles=(0.5, 0.9, 0.95, 0.99)) -> dict[float, float]:
    """Of timings: the element at place floor(q * n) in order, the last at most."""
    ordered = sorted(seconds)
    return {q: ordered[min(math.floor(q * len(ordered)), len(ordered) - 1)] for q in quantiles} if ordered else {}


def latencies(search, queries: DataFrame, ids: list[int], warm_up: int = 1) -> list[float]:
    """Seconds of ``search`` for each of some queries by itself; for information only."""
    out = []
    for turn, qid in enumerate([*ids[:warm_up], *ids]):
        began = time.perf_counter()
        search(queries.where(F.col("qid") == qid)).collect()  # k rows
        if turn >= warm_up:
            out.append(time.perf_counter() - began)
    return out
