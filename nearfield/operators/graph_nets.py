"""Nets that do not compare all members: on the edges of a neighbour graph, and from sampled batches."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.knn import knn, range_counts
from nearfield.operators.permute import ranked
from nearfield.operators.rnets import ordered_net
from nearfield.sources.snapshots import cut, released


def graph_net(vectors: DataFrame, edges: DataFrame, radii: list[float], order: Column) -> DataFrame:
    """vid, stage: a net on the edges (src, dst, dist) alone, through radii that shrink; a vertex joins at the first stage at which no edge within the radius leads to a member.

    Edges count both ways. Stages keep what is taken. In a round each open vertex proposes itself; one with an open neighbour that comes earlier in ``order`` (then
    vid) is vetoed; the others join, and their neighbours close. That takes the same vertices as one at a time in that order. No distance is computed.
    """
    if not radii or any(b > a for a, b in zip(radii, radii[1:])):
        raise ValueError("radii must be given, and must not grow")
    keyed = cut(vectors.select("vid", order.cast("long").alias("key")))
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).where("src <> dst")
    both = cut(both.groupBy("src", "dst").agg(F.min("dist").alias("dist")).where(F.col("dist") <= radii[0]))
    net = keyed.select("vid", F.lit(0).alias("stage")).limit(0)
    for stage, radius in enumerate(radii):
        near = both.where(F.col("dist") <= radius).select(F.col("src").alias("vid"), F.col("dst").alias("by"))
        # members of earlier stages close their neighbours first
        closed = near.join(net.select("vid"), "vid", "left_semi").select(F.col("by").alias("vid")).distinct()
        open_ = cut(keyed.join(net.select("vid"), "vid", "left_anti").join(closed, "vid", "left_anti"))
        while not open_.isEmpty():
            earlier = near.join(open_, "vid").join(open_.select(F.col("vid").alias("by"), F.col("key").alias("by_key")), "by")
            vetoed = earlier.where("by_key < key OR (by_key = key AND by < vid)").select("vid").distinct()
            joined = cut(open_.join(vetoed, "vid", "left_anti").select("vid"))
            out = near.join(joined, "vid", "left_semi").select(F.col("by").alias("vid")).unionByName(joined).distinct()
            before, open_ = open_, cut(open_.join(out, "vid", "left_anti"))
            net = net.unionByName(joined.select("vid", F.lit(stage).alias("stage")))
            released(before)
        net = cut(net)
    return net


def stop_threshold(coverage: float, confidence: float, batch: int) -> int:
    """With fewer uncovered members in a sampled batch than this, the net covers the asked share with the asked confidence; 1 at least."""
    if not (0 < coverage < 1 and 0 < confidence < 1 and batch >= 1):
        raise ValueError("coverage and confidence lie between 0 and 1, and a batch has a member at least")
    p = 1 - coverage
    return max(1, math.floor(batch * p - NormalDist().inv_cdf(confidence) * math.sqrt(batch * p * (1 - p))))


def sampled_net(members: DataFrame, radius: float, order: Column, batch: int = 2048, coverage: float = 0.95, confidence: float = 0.96, most: int | None = None, metric: str = "l2") -> DataFrame:
    """vid, batch: a net from batches of members in ``order``, which ends with the first batch that has fewer uncovered members than the threshold, or at ``most`` centres.

    Those of a batch that no centre covers are settled among themselves, the farthest from the net first. A batch meets the centres in blocks; members that no batch drew are never compared.
    """
    limit, n = stop_threshold(coverage, confidence, batch), members.count()
    places = cut(members.select("vid", "vec").join(ranked(members, order), "vid"))
    net, centres, have = members.select("vid", F.lit(0).alias("batch")).limit(0), members.select("vid", "vec").limit(0), 0
    for number in range(-(-n // batch)):
        some = places.where((F.col("place") >= number * batch) & (F.col("place") < (number + 1) * batch)).select("vid", "vec")
        asked = cut(some.withColumnRenamed("vid", "qid"))
        near = knn(centres, asked, 1, metric).select(F.col("qid").alias("vid"), "dist")
        open_ = cut(asked.withColumnRenamed("qid", "vid").join(near, "vid", "left").where(F.coalesce(F.col("dist") > radius, F.lit(True))))
        left = open_.count()
        if left:
            chosen = cut(ordered_net(open_, radius, -F.round(F.coalesce("dist", F.lit(0.0)) * 1e6), metric))
            if most is not None:
                chosen = chosen.orderBy("vid").limit(max(0, most - have))
            net = cut(net.unionByName(chosen.select("vid", F.lit(number).alias("batch"))))
            centres = cut(members.select("vid", "vec").join(net, "vid", "left_semi"))
            have = net.count()
        if left < limit or most is not None and have >= most:
            break
    return net


def farthest_of_batches(members: DataFrame, radius: float, order: Column, batch: int = 512, empty: int = 3, most: int | None = None, metric: str = "l2") -> DataFrame:
    """vid, step: a net that takes of each batch of members in ``order``, again and again from the first, the one farthest from the net, if it is farther than the radius.

    Ends after ``empty`` batches in a row without one, or at ``most`` members. Each step is a job over one batch and the net: for nets of some hundreds.
    """
    if batch < 1 or empty < 1:
        raise ValueError("a batch, and the number of batches in vain, must be positive")
    n = members.count()
    places = cut(members.select("vid", "vec").join(ranked(members, order), "vid"))
    spark, taken, number, vain = members.sparkSession, [], 0, 0
    while n and vain < min(empty, -(-n // batch)) and (most is None or len(taken) < most):
        start = number * batch % (-(-n // batch) * batch)
        some = places.where((F.col("place") >= start) & (F.col("place") < start + batch)).select(F.col("vid").alias("qid"), "vec")
        net = places.where(F.col("vid").isin(taken)).select("vid", "vec")
        near = knn(net, some, 1, metric).select("qid", "dist")
        far = some.join(near, "qid", "left").select(F.struct(F.coalesce("dist", F.lit(float("inf"))).alias("dist"), (-F.col("qid")).alias("rank")).alias("far"))
        dist, rank = far.agg(F.max("far")).select("max(far).*").first()
        vain = 0 if dist > radius else vain + 1
        taken += [-rank] if dist > radius else []
        number += 1
    return spark.createDataFrame([(v, k) for k, v in enumerate(taken)], "vid long, step int")


def covered_share(members: DataFrame, net: DataFrame, radius: float, metric: str = "l2") -> float:
    """The share of members that a member of the net covers; exact."""
    n = members.count()
    asked = members.select(F.col("vid").alias("qid"), "vec")
    near = range_counts(members.select("vid", "vec").join(net.select("vid"), "vid", "left_semi"), asked, radius, metric, exclude_self=False)
    return near.count() / n if n else 1.0
