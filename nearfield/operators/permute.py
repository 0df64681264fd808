"""Dense permutations of a data set: ranks, shuffles that keep the truth right, samples and hierarchies of exact sizes.

A global rank is found by ranges: rows are dealt to ranges of the key, a range counts its own, and starts after those before it. What is collected is a count for each range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.levels import LEAST
from nearfield.sources.snapshots import cut


def ranked(vectors: DataFrame, key: Column) -> DataFrame:
    """vid, place: each vertex's rank by the key, then the vid, from 0 to n - 1."""
    dealt = cut(vectors.select("vid", key.alias("key")).repartitionByRange("key", "vid").select("vid", "key", F.spark_partition_id().alias("part")))
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in dealt.groupBy("part").agg(F.count("*")).collect()):  # a row for each range
        starts.append((part, before))
        before += n
    known = vectors.sparkSession.createDataFrame(starts, "part int, start long")
    own = F.row_number().over(Window.partitionBy("part").orderBy("key", "vid")) - 1
    return dealt.withColumn("own", own).join(F.broadcast(known), "part").select("vid", (F.col("start") + F.col("own")).alias("place"))


def by_hash(seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), "vid")


def shuffled(vectors: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(vectors, places): the vectors under new ids, a permutation of 0 to n - 1; and vid, place of each old id."""
    places = cut(ranked(vectors, key))
    return vectors.join(places, "vid").drop("vid").withColumnRenamed("place", "vid"), places


def remapped(truth: DataFrame, places: DataFrame) -> DataFrame:
    """A truth (qid, rank, vid, ...) with the neighbours' new ids; an error if one has none."""
    rows = truth.join(places, "vid", "left")
    if not rows.where("place IS NULL").isEmpty():
        raise ValueError("the truth has neighbours that are not in the data set")
    return rows.drop("vid").withColumnRenamed("place", "vid").select(*truth.columns)


def drawn(vectors: DataFrame, count: int, key: Column) -> DataFrame:
    """Exactly ``count`` of the vectors (all, if there are fewer), drawn without replacement: those of the lowest ranks."""
    if count < 0:
        raise ValueError("a sample cannot be smaller than nothing")
    return vectors.join(ranked(vectors, key).where(F.col("place") < count).select("vid"), "vid", "left_semi")


def level_sizes(n: int, ratio: float, top: int) -> list[int]:
    """Sizes of levels 0, 1, ... of a random hierarchy: each is the floor of a share of the one below, while that is ``LEAST`` at least."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio of a hierarchy lies between 0 and 1")
    sizes = [n]
    while len(sizes) <= top and math.floor(ratio * sizes[-1]) >= LEAST:
        sizes.append(math.floor(ratio * sizes[-1]))
    return sizes


def hierarchy(vectors: DataFrame, ratio: float, top: int, key: Column) -> DataFrame:
    """vid, highest_level: nested samples of exact sizes, all cut from one rank."""
    sizes = level_sizes(vectors.count(), ratio, top)
    above = [F.when(F.col("place") < s, 1).otherwise(0) for s in sizes[1:]]
    level = F.lit(0)
    for one in above:
        level = level + one
    return ranked(vectors, key).select("vid", level.cast("int").alias("highest_level"))
