import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import builders, cells, compact, graph_nets, insertion, permute, refine, search
from nearfield.operators import knn as blocks
from nearfield.operators.knn import knn, range_join
from nearfield.plans.config import NetConfig

POINTS = np.random.default_rng(8).normal(size=(150, 2)).astype(np.float32)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(POINTS)], "vid long, vec array<float>").repartition(3).cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def near_edges(base, k):
    return knn(base, base.withColumnRenamed("vid", "qid"), k, exclude_self=True).select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist")


def test_shuffle_keeps_the_truth(base):
    order = (F.col("vid") * 7919 + 13) % 101  # with ties
    want = {v: p for p, v in enumerate(sorted(range(150), key=lambda v: ((v * 7919 + 13) % 101, v)))}
    fresh, places = permute.shuffled(base, order)
    assert dict(rows(places)) == want and sorted(r.vid for r in fresh.collect()) == list(range(150))
    queries = base.where("vid < 9").select(F.col("vid").alias("qid"), "vec")
    true = knn(base, queries, 4)
    assert rows(permute.remapped(true, places).select("qid", "vid", "dist")) == rows(knn(fresh, queries, 4).select("qid", "vid", "dist"))
    with pytest.raises(ValueError):
        permute.remapped(true, places.where("vid < 5"))


def test_exact_samples_and_hierarchies(base):
    for count in (0, 1, 40, 150, 999):
        assert permute.drawn(base, count, permute.by_hash(3)).count() == min(count, 150)
    assert rows(permute.drawn(base, 40, permute.by_hash(3))) == rows(permute.drawn(base.repartition(7), 40, permute.by_hash(3)))
    assert permute.level_sizes(1000, 0.5, 9) == [1000, 500, 250, 125, 62] and permute.level_sizes(1000, 0.5, 2) == [1000, 500, 250]
    levels = permute.hierarchy(base, 0.5, 9, permute.by_hash())
    assert [levels.where(F.col("highest_level") >= h).count() for h in range(4)] == [150, 75, 37, 0]
    assert permute.ranked(base.limit(0), permute.by_hash()).count() == 0


@pytest.mark.parametrize("count", [None, 1, 150])
def test_range_join_over_cells(base, count, monkeypatch):
    monkeypatch.setattr(blocks, "BASE_BLOCK", 16)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 5)
    asked = base.withColumnRenamed("vid", "qid")
    assert rows(cells.range_self_join(base, 0.3, cells=count)) == rows(range_join(base, asked, 0.3))
    assert rows(cells.range_self_join(base, 0.04, "l2sqr", count)) == rows(range_join(base, asked, 0.04, "l2sqr"))


def test_cells_that_are_not_met(spark, base):
    placed, centres = cells.placed(base, 40)
    assert cells.meetings(placed, centres, 0.05).share < 0.5 <= cells.meetings(placed, centres, 9.0).share == 1.0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)], "vid long, vec array<float>")
    assert cells.range_self_join(same, 0.0).count() == 30 * 29 and cells.range_self_join(same.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        cells.range_self_join(base, 1.0, "cosine")


def test_net_on_a_graph_against_one_at_a_time(base):
    edges, radii = near_edges(base, 6), [0.8, 0.4, 0.2]
    both = {}
    for s, d, x in rows(edges):
        both[s, d] = both[d, s] = x
    stage_of = {}
    for stage, radius in enumerate(radii):
        covered = {b for (a, b), x in both.items() if a in stage_of and x <= radius}
        for v in sorted(range(150), key=lambda v: (v * 37 % 150, v)):
            if v not in stage_of and v not in covered:
                stage_of[v] = stage
                covered |= {b for (a, b), x in both.items() if a == v and x <= radius}
    got = dict(rows(graph_nets.graph_net(base, edges, radii, F.col("vid") * 37 % 150)))
    assert got == stage_of
    with pytest.raises(ValueError):
        graph_nets.graph_net(base, edges, [0.2, 0.4], F.col("vid"))


def test_net_from_batches(base):
    assert [graph_nets.stop_threshold(0.95, 0.96, n) for n in (512, 1024, 2048, 10)] == [16, 38, 85, 1]
    order = F.col("vid") * 37 % 150
    net = graph_nets.sampled_net(base, 0.5, order, batch=40, coverage=0.5, confidence=0.5)
    chosen = [r.vid for r in net.collect()]
    d = np.round(np.sqrt(((POINTS[chosen][:, None].astype(float) - POINTS[chosen][None]) ** 2).sum(axis=2)), 6)
    assert (d + 9 * np.eye(len(chosen))).min() > 0.5
    assert graph_nets.covered_share(base, net, 0.5) >= 0.5
    whole = graph_nets.sampled_net(base, 0.5, order, batch=40, coverage=0.999, confidence=0.999)
    assert graph_nets.covered_share(base, whole, 0.5) > 0.99 and whole.agg(F.max("batch")).first()[0] <= 3
    assert graph_nets.sampled_net(base, 0.5, order, batch=40, most=3).count() <= 3


def test_farthest_of_batches(base):
    order, d = F.col("vid") * 37 % 150, np.round(np.sqrt(((POINTS[:, None].astype(float) - POINTS[None]) ** 2).sum(axis=2)), 6)
    turn, taken, number, vain = sorted(range(150), key=lambda v: (v * 37 % 150, v)), [], 0, 0
    while vain < 2:
        some = turn[number * 50 % 150 :][:50]
        best = min(some, key=lambda v: (-(d[v, taken].min() if taken else np.inf), v))
        far = bool(not taken or d[best, taken].min() > 1.2)
        taken, vain, number = taken + [best] * far, 0 if far else vain + 1, number + 1
    assert [r.vid for r in graph_nets.farthest_of_batches(base, 1.2, order, 50, 2).orderBy("step").collect()] == taken
    assert graph_nets.farthest_of_batches(base, 1.2, order, 50, 2, most=2).count() == 2 and graph_nets.farthest_of_batches(base.limit(0), 1.2, order).count() == 0


def test_loops_are_observed_in_one_build(base):
    queries = base.where("vid % 10 = 0").select(F.col("vid").alias("qid"), "vec")
    true = near_edges(base, 4)
    share = lambda edges: true.join(edges.select("src", "dst"), ["src", "dst"]).count() / true.count()
    graph, said = refine.profiled(lambda observe: refine.knn_graph(base, 8, loops=2, triangles=1, routing=1, observe=observe), share)
    assert len(said) == 3 and said[-1] == share(graph) >= 0.9 and queries.count() == 15


def test_pushes(spark):
    line = spark.createDataFrame([(k, [float(k)]) for k in range(6)], "vid long, vec array<float>")
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(5)] + [(0, 3, 3.0)], "src long, dst long, dist double")
    query = spark.createDataFrame([(9, [5.2])], "qid long, vec array<float>")
    packed = compact.pack(edges, line, 2)
    assert rows(compact.pushes(compact.from_one(query, 0), packed, 1, expand=1)) == [(9, 0, 3, 3.0), (9, 3, 4, 1.0), (9, 4, 5, 1.0)]
    profile = compact.push_profile(compact.from_one(query, 0), packed, 1, expand=1).first()
    assert (profile.level, profile.pushes, profile.mean_length) == (0, 3, round(5 / 3, 6))
    drawn = search.random_entries(query, line.select("vid"), 2)
    assert compact.push_profile(compact.with_entries(query, drawn), packed, 3).first().pushes <= 5


def test_kinds_come_back_with_their_parameters(spark, base, tmp_path):
    config = builders.Stacked(NetConfig(2.0, 0.0, 0.4), 2, insertion.Caps(6, 10, 16, 24, 24, 1.1))
    assert builders.from_json(builders.Stacked, builders.as_json(config)) == config
    index = builders.build("stacked", base.where("vid < 100"), config)
    builders.save(index, str(tmp_path / "g"))
    stored = builders.restore(spark, str(tmp_path / "g"), "stacked")
    assert stored.config == config and rows(stored.graph.layers) == rows(index.graph.layers)
    grown = builders.grow(stored, base.where("vid >= 100"))
    assert grown.graph.levels.count() == 150 and grown.config == config
    for bad in (lambda: builders.restore(spark, str(tmp_path / "g"), "knn"), lambda: builders.build("stacked", base, builders.KnnGraph(4)), lambda: builders.build("none", base, config), lambda: builders.from_json(builders.KnnGraph, {"degree": 4})):
        with pytest.raises(ValueError):
            bad()


def test_a_kind_of_ones_own(spark, base, tmp_path):
    @dataclasses.dataclass(frozen=True)
    class Ring:
        step: int = 1

    def ring(vectors, config):
        n = vectors.count()
        return vectors.select(F.col("vid").alias("src"), ((F.col("vid") + config.step) % n).alias("dst"), F.lit(1.0).alias("dist"))

    builders.register("ring", Ring, ring)
    builders.save(builders.build("ring", base, Ring(3)), str(tmp_path / "r"))
    back = builders.restore(spark, str(tmp_path / "r"), "ring")
    assert back.config == Ring(3) and back.graph.count() == 150 and math.isclose(back.graph.agg(F.sum("dist")).first()[0], 150)
    with pytest.raises(ValueError):
        builders.grow(back, base)


def test_neighbours_of_many_queries(spark, monkeypatch):
    """Queries dealt to parts: each pair of a task's queries and rows is met once, and k rows a query leave the task, whatever the number of blocks."""
    monkeypatch.setattr(blocks, "FEW", 4)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 16)
    monkeypatch.setattr(blocks, "BASE_BLOCK", 16)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(203, 5)), 2).astype(np.float32)
    v[50:60] = v[3]  # copies: ties by id
    v[7] = 0.0
    v[100:] += 300.0  # far from the origin: single precision alone would not order them
    labels = rng.integers(0, 3, 203)
    base = spark.createDataFrame([(int(i), [float(x) for x in v[i]], int(labels[i])) for i in range(203)], "vid long, vec array<float>, label int").repartition(3)
    asked = base.withColumnRenamed("vid", "qid")
    w = v.astype(np.float64)
    length = np.sqrt((w * w).sum(axis=1))
    with np.errstate(all="ignore"):
        cosine = np.where(np.outer(length, length) > 0, 1 - (w @ w.T) / np.outer(length, length), 1.0)
    gap = ((w[:, None] - w[None]) ** 2).sum(axis=2)
    keys = {"l2": np.sqrt(gap), "l2sqr": gap, "ip": -(w @ w.T), "cosine": cosine}
    for metric, d in keys.items():
        d = np.round(d, 6)
        for options in ({}, {"farthest": True}, {"same": "label", "within": float(np.quantile(d, 0.3))}, {"farthest": True, "within": float(np.quantile(d, 0.3))}):
            got = {(r.qid, r["rank"]): (r.vid, r.dist) for r in blocks.knn(base, asked, 7, metric, exclude_self=True, **options).collect()}
            sign, want = -1 if "farthest" in options else 1, {}
            for q in range(203):
                ok = [i for i in range(203) if i != q and ("same" not in options or labels[i] == labels[q]) and ("within" not in options or d[q, i] <= options["within"])]
                for rank, i in enumerate(sorted(ok, key=lambda i: (sign * d[q, i], i))[:7], 1):
                    want[q, rank] = (i, d[q, i])
            assert got.keys() == want.keys()
            assert all(abs(got[k][1] - want[k][1]) <= 2e-6 * max(1.0, abs(want[k][1])) for k in want)
            assert sum(got[k][0] != want[k][0] for k in want) <= (0 if metric in ("l2", "l2sqr") else 12)  # rounding may turn ties of products
    met = blocks.meet(base, asked, [], lambda: blocks._Best(7, "l2", exclude_self=True), "qid long, vid long, dist double", None)
    assert met.count() == 203 * 7  # not 7 a query and block
