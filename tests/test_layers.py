import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import edges, exact, increments, knn as blocks, layered, levels, probes, refine, rnets, search, supersteps
from nearfield.operators.knn import knn, range_counts, range_join
from nearfield.plans.config import NetConfig, PruneConfig, edge_ratio
from nearfield.sources import snapshots, vectors as sources
from nearfield.streaming import ingest

POINTS = np.random.default_rng(5).normal(size=(90, 3)).astype(np.float32)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(POINTS)], "vid long, vec array<float>").repartition(3).cache()


def asked(base):
    return base.where("vid % 10 = 0").select(F.col("vid").alias("qid"), "vec")


def rows(df):
    return sorted(map(tuple, df.collect()))


def line(spark, *places):
    return spark.createDataFrame([(k, [float(x)]) for k, x in enumerate(places)], "vid long, vec array<float>")


def distances():
    p = POINTS.astype(float)
    return np.round(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)), 6)


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_both_ways_of_meeting_agree_with_numpy(base, few, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", few)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 4)
    monkeypatch.setattr(blocks, "BASE_BLOCK", 16)
    d, ids = distances(), range(0, 90, 10)
    want = sorted((q, r + 1, int(v), float(d[q, v])) for q in ids for r, v in enumerate(np.lexsort((np.arange(90), d[q]))[:7]))
    assert rows(knn(base, asked(base), 7)) == want
    far = sorted((q, r + 1, int(v), float(d[q, v])) for q in ids for r, v in enumerate(np.lexsort((np.arange(90), -d[q]))[:3]))
    assert rows(knn(base, asked(base), 3, farthest=True)) == far
    near = [(q, v, float(d[q, v])) for q in ids for v in range(90) if v != q and d[q, v] <= 1.1]
    assert rows(range_join(base, asked(base), 1.1)) == sorted(near)
    assert rows(range_counts(base, asked(base), 1.1)) == sorted((q, sum(x[0] == q for x in near), max(x[2] for x in near if x[0] == q)) for q in {x[0] for x in near})
    assert knn(base, asked(base).limit(0), 3).count() == range_join(base.limit(0), asked(base), 9.0).count() == 0


def farthest_first(members, radius):
    d, taken = distances(), [members[0]]
    while True:
        near = {v: min(d[v, c] for c in taken) for v in members}
        best = min(members, key=lambda v: (-near[v], v))
        if near[best] <= radius:
            return taken
        taken.append(best)


@pytest.mark.parametrize("alone, batch", [(0, 7), (0, 2048), (8192, 1)])
def test_farthest_first_net(base, alone, batch, monkeypatch):
    monkeypatch.setattr(rnets, "ALONE", alone)
    got = [r.vid for r in rnets.farthest_first_net(base, 0.9, batch=batch).orderBy("step").collect()]
    assert got == farthest_first(list(range(90)), 0.9)


def test_nets_at_the_boundary_and_of_copies(spark):
    four = line(spark, 1, 1, 1, 1)
    assert rows(rnets.farthest_first_net(four, 0.0)) == [(0, 0)]
    assert rows(rnets.farthest_first_net(line(spark, 0, 2, 4), 2.0)) == [(0, 0), (2, 1)]  # within the radius is covered
    assert rows(rnets.ordered_net(line(spark, 0, 2, 4), 2.0, -F.col("vid"))) == [(0,), (2,)]
    assert rnets.ordered_net(four.limit(0), 1.0, F.col("vid")).count() == rnets.farthest_first_net(four.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        rnets.farthest_first_net(four, float("nan"))


@pytest.mark.parametrize("alone", [0, 8192])
def test_ordered_net_against_one_at_a_time(base, alone, monkeypatch):
    monkeypatch.setattr(rnets, "ALONE", alone)
    order, chosen, d = sorted(range(90), key=lambda v: (v * 37 % 90, v)), [], distances()
    for v in order:
        if all(d[v, c] > 0.8 for c in chosen):
            chosen.append(v)
    assert [r[0] for r in rows(rnets.ordered_net(base, 0.8, F.col("vid") * 37 % 90))] == sorted(chosen)


def test_levels_of_nets(base):
    net = NetConfig(2, 0, 0.5)
    for order in (None, F.xxhash64("vid")):
        found = rnets.net_levels(base, net, 9, order)
        top = found.agg(F.max("highest_level")).first()[0]
        assert found.count() == 90 and found.where(F.col("highest_level") == top).count() == 1
        assert all(r.crowded == r.uncovered == 0 for r in rnets.violations(base, found, net).collect())
    broken = found.withColumn("highest_level", F.when(F.col("vid") < 40, 1).otherwise(0))
    assert rnets.violations(base, broken, net).first().crowded > 0


def test_exact_index(spark, base):
    net, pruning, d = NetConfig(2, 0, 0.2), PruneConfig(1.5, 0.5, 0.2), distances()
    limit = edge_ratio(0, net, pruning) * net.radius(0)
    assert rows(exact.arc_candidates(base, 0, net, pruning)) == sorted((a, b, float(d[a, b])) for a in range(90) for b in range(90) if a != b and d[a, b] <= limit)
    layers, entry, top = exact.build(base, rnets.net_levels(base, net, 2), net, pruning)
    assert top == 2 and entry.first().vid == 0
    members = farthest_first(list(range(90)), net.radius(1))
    for src in members[:10]:
        kept = []
        for dst in sorted((v for v in members if v != src and d[src, v] <= edge_ratio(1, net, pruning) * net.radius(1)), key=lambda v: (d[src, v], v)):
            if all(d[k, dst] >= d[src, dst] / pruning.alpha for k in kept):
                kept.append(dst)
        assert [r.dst for r in layers.where(f"level = 1 AND src = {src}").orderBy("dst").collect()] == sorted(kept)
    wrong = spark.createDataFrame([(1, 0, 89, 1.0)], "level int, src long, dst long, dist double")
    with pytest.raises(ValueError):
        exact.merged(wrong, base.select("vid", F.lit(0).alias("highest_level")))
    for bad in (lambda: exact.arc_candidates(base, -1, net, pruning), lambda: exact.arc_candidates(base, 0, net, pruning, "ip")):
        with pytest.raises(ValueError):
            bad()


def test_flagship_early_stop_and_bottom(base, tmp_path, spark):
    found = base.select("vid", F.when(F.col("vid") < 40, 1).otherwise(0).alias("highest_level"))
    layers, entry, top = layered.refined(base, found, 6, 12, 1.1, loops=1, triangles=1, routing=1)
    assert layers.where("level = 1 AND (src >= 40 OR dst >= 40)").count() == 0
    faults = edges.row_faults(layers.where("level = 0"), 90, 12).first()
    assert all(x == 0 for x in faults)
    true = knn(base, asked(base), 5)
    hits = lambda found: found.join(true, ["qid", "vid"]).count() / true.count()
    plain = search.search_layered(asked(base), layers, base, entry, top, 5, 20)
    never = search.search_layered(asked(base), layers, base, entry, top, 5, 20, stops={1: 0.0})
    assert rows(plain) == rows(never) and hits(plain) >= 0.9
    trace: dict = {}
    at = search.descend(asked(base), layers, base, entry, top, stops={1: 1e9}, trace=trace)  # stops before the first step
    assert {r.vid for r in at.collect()} == {entry.first().vid} and len(trace[1]) == 1
    assert hits(search.search_bottom(asked(base), layers, base, 5, 20)) >= 0.9 and hits(search.search_bottom(asked(base), layers, base, 5, 20, entry)) >= 0.9
    snapshots.save_layered(layers, found, entry.first().vid, str(tmp_path / "g"), "refined", (6, 12), alpha=1.1)
    stored, kept, about = snapshots.load_layered(spark, str(tmp_path / "g"), "refined")
    assert rows(stored) == rows(layers) and rows(kept) == rows(found) and about["parameters"] == {"alpha": 1.1}
    snapshots.save_layered(layers, found, 89, str(tmp_path / "h"), "refined", (6, 12))
    snapshots.save_layered(layers, found, entry.first().vid, str(tmp_path / "i"), "refined", (2, 12))
    for bad in ("h", "i"):
        with pytest.raises(ValueError):
            snapshots.load_layered(spark, str(tmp_path / bad), "refined")


def test_stacked_layers(base):
    found = rnets.net_levels(base, NetConfig(2, 0, 0.6), 2, F.xxhash64("vid"))
    layers, entry, top = layered.stacked(base, found, 6, 10, 1.1, 30)
    assert layers.groupBy("level", "src").count().where("count > IF(level = 0, 10, 6)").count() == 0
    got = search.search_layered(asked(base), layers, base, entry, top, 5, 20)
    assert got.join(knn(base, asked(base), 5), ["qid", "vid"]).count() >= 0.9 * got.count() > 0


def test_trajectories_and_adopted_edges(spark):
    base = line(spark, 0, 1, 2, 3, 4)
    graph = spark.createDataFrame([(k, k + 1, 1.0) for k in range(4)], "src long, dst long, dist double")
    query = spark.createDataFrame([(9, [4.25])], "qid long, vec array<float>")
    trace: list = []
    search.beam(query, graph, base, spark.createDataFrame([(9, 0)], "qid long, vid long"), 1, "l2", 1, None, trace)
    walked = search.trajectory(trace, knn(base, query, 1)).orderBy("step").collect()
    assert [(r.measured, r.ratio) for r in walked] == [(k + 1, (4.25 - k) / 0.25) for k in range(5)]
    assert rows(search.adopted_edges({1: trace}, base)) == [(1, 4, 1.0)]
    assert probes.percentiles([3.0, 1.0, 2.0, 4.0]) == {0.5: 3.0, 0.9: 4.0, 0.95: 4.0, 0.99: 4.0}
    assert len(probes.latencies(lambda q: knn(base, q, 1), query, [9])) == 1


def test_entries(base):
    queries = asked(base)
    drawn = search.random_entries(queries, base.select("vid"), 4)
    assert drawn.groupBy("qid").count().where("count = 4").count() == queries.count() and drawn.distinct().count() == drawn.count()
    assert rows(drawn) == rows(search.random_entries(queries.repartition(7), base.select("vid").repartition(1), 4))
    spread = search.strided_entries(queries, base.select("vid"), 5)
    assert spread.select("vid").distinct().count() <= 5 and spread.select("qid").distinct().count() == queries.count()
    graph = knn(base, base.withColumnRenamed("vid", "qid"), 3).select(F.col("qid").alias("src"), F.col("vid").alias("dst"))
    warm = search.warm_entries(graph, queries.withColumn("near", F.col("qid")))
    assert warm.count() == 3 * queries.count()


def test_topping_up_and_old_pairs(spark, base):
    none = spark.createDataFrame([(0, 1, 9.0, False)], "src long, dst long, dist double, is_new boolean")
    full = refine.topped_up(none, base, 5)
    sizes = full.groupBy("src").count().agg(F.min("count"), F.max("count")).first()
    assert 1 <= sizes[0] and sizes[1] <= 5 and full.where("src = dst").count() == 0 and full.where("NOT is_new").count() == 1
    assert refine.topped_up(none, base, 5, only=base.where("vid = 3")).where("src NOT IN (0, 3)").count() == 0
    places = line(spark, 0, 2, 3)
    old = spark.createDataFrame([(0, 1, 2.0, False), (0, 2, 3.0, False)], "src long, dst long, dist double, is_new boolean")
    assert edges.prune(old, places, skip_old=True).count() == 2 and edges.prune(old, places).count() == 1
    assert edges.prune(old.withColumn("is_new", F.col("dst") == 2), places, skip_old=True).count() == 1
    both = refine.symmetric_graph(base, 6, loops=1, triangles=1, routing=1)
    assert both.join(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").count() == 0
    back = edges.written_back(edges.taken_from(edges.written_back(both, 1, 4, 8), 1, 3), 0, 4, 2)
    assert back.groupBy("src").count().agg(F.max("count")).first()[0] == 2
    faults = edges.row_faults(spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (0, 1, 1.0), (1, 7, float("nan"))], "src long, dst long, dist double"), 5, 2).first()
    assert tuple(faults) == (1, 1, 1, 1, 1)


def test_increments(spark, base):
    first, second = base.where("vid < 60"), base.where("vid >= 60").orderBy("vid").select("vec")
    none = spark.createDataFrame([], "src long, dst long, dist double")
    graph, known = increments.add_vertices(none, first.limit(0), first, 10)
    fresh = increments.appended(known, second.coalesce(1))
    assert rows(fresh.select("vid")) == [(k,) for k in range(60, 90)]
    assert [r.vec for r in fresh.orderBy("vid").collect()] == [r.vec for r in second.collect()]
    graph, known = increments.add_vertices(graph, known, fresh, 10)
    assert known.count() == 90 and all(x == 0 for x in edges.row_faults(graph, 90, 10).first())
    entries = asked(base).select("qid", F.lit(7).cast("long").alias("vid"))
    got = search.search_flat(asked(base), graph, known, entries, 5, 25)
    assert got.join(knn(base, asked(base), 5), ["qid", "vid"]).count() >= 0.9 * got.count() > 0
    with pytest.raises(ValueError):
        increments.appended(known, spark.createDataFrame([([1.0],)], "vec array<float>"))


def test_streaming_ingestion(spark, base, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "graph")
    base.where("vid < 50").select("vec").write.parquet(str(source / "a"))
    stream = lambda: spark.readStream.schema("vec array<float>").option("maxFilesPerTrigger", 100).parquet(str(source / "*"))
    ingest.ingest(stream(), folder, str(tmp_path / "c"), 8).awaitTermination()
    base.where("vid >= 50").select("vec").write.parquet(str(source / "b"))
    ingest.ingest(stream(), folder, str(tmp_path / "c"), 8).awaitTermination()
    assert ingest.versions(spark, folder) == [0, 1]
    graph, known = ingest.read_version(spark, folder, 1)
    assert rows(known.select("vid")) == [(k,) for k in range(90)] and graph.select("src").distinct().count() == 90
    again = rows(graph)
    ingest.ingest_batch(known.where("vid >= 50").orderBy("vid").select("vec"), 1, folder, 8)  # a batch that is run again
    assert len(rows(ingest.read_version(spark, folder, 1)[0])) >= 0.8 * len(again) and ingest.versions(spark, folder) == [0, 1]


def test_probes_of_truth_and_pairs(spark, base):
    true = knn(base, asked(base), 4)
    assert rows(probes.ground_truth(true.select("qid", "vid"), base, asked(base))) == rows(true)
    assert probes.pairs_sampled(0.5, 0.95, 0.05) == math.ceil(1.959963984540054**2 / 0.05**2)
    with pytest.raises(ValueError):
        probes.pairs_sampled(0.0, 0.95, 0.05)
    drawn = probes.sampled_pairs(base, 500)
    assert drawn.count() == 500
    values = sorted(r.dist for r in drawn.collect())
    got = dict(rows(probes.pair_quantiles(drawn, (0.0, 0.25, 0.5, 1.0))))
    assert got == {q: values[min(math.floor(q * 500), 499)] for q in (0.0, 0.25, 0.5, 1.0)}
    assert probes.pair_quantiles(drawn.limit(0)).count() == 0


def test_subsets_and_datasets(spark, base, tmp_path):
    assert rows(sources.subset_of_range(base, 3, 2).select("vid")) == [(3,), (4,)]
    ids = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "pos long, vid long")
    assert rows(sources.subset_of_ids(base, ids).select("pos", "vid")) == [(0, 5), (1, 2), (2, 5)]
    for bad in (lambda: sources.subset_of_range(base, 88, 5), lambda: sources.subset_of_ids(base, ids.select("pos", (F.col("vid") + 200).alias("vid")))):
        with pytest.raises(ValueError):
            bad()
    write = lambda name, part: (tmp_path / name).write_bytes(b"".join(np.array([3], "<i4").tobytes() + r.tobytes() for r in part))
    write("b.fvecs", POINTS)
    write("q.fvecs", POINTS[:4])
    write("g.ivecs", np.arange(12, dtype="<i4").reshape(4, 3))
    entry = {"dataset_dir": "", "base_path": "b.fvecs", "query_path": "q.fvecs", "gt_path": "g.ivecs"}
    (tmp_path / "sets.json").write_text(json.dumps({"root_dir": str(tmp_path), "datasets": {"tiny": entry, "short": {"base_path": "b.fvecs"}}}))
    got = sources.read_dataset(spark, str(tmp_path / "sets.json"), "tiny")
    assert got.keys() == {"base", "query", "gt"} and got["gt"].orderBy("pos").first().vec == [0, 1, 2]
    assert [r.vec for r in got["base"].orderBy("pos").collect()] == POINTS.tolist()
    for name in ("none", "short"):
        with pytest.raises(ValueError):
            sources.read_dataset(spark, str(tmp_path / "sets.json"), name)
    assert levels.highest_random_level(32, 0.02) == 1 and levels.highest_random_level(32 * 50**2, 0.02) == 3


def test_supersteps(spark):
    places = line(spark, 0, 2, 3, -9)
    start = spark.createDataFrame([(0, 1, 2.0, True), (0, 2, 3.0, True), (0, 3, 9.0, True), (3, 0, 9.0, True)], "src long, dst long, dist double, is_new boolean")
    turn = [supersteps.triangle(), supersteps.reverse, supersteps.truncate(2)]
    done = rows(supersteps.run(start, places, turn).select("src", "dst"))
    assert done == rows(edges.truncate(edges.symmetric(refine.triangle(start, places)), 2).select("src", "dst"))
    part = supersteps.step(start, places, supersteps.reverse, 1, 3)  # only vertex 3 has a row there: its log is an edge that stays
    assert rows(part.select("src", "dst")) == [(0, 1), (0, 2), (0, 3), (3, 0)]
    assert rows(supersteps.step(start, places, supersteps.truncate(1), 0, 0).select("src", "dst")) == [(0, 1), (3, 0)]
    assert rows(supersteps.step(start, places, supersteps.pruning()).where("src = 0").select("dst")) == [(1,), (3,)]
    own = lambda rows, vectors: (rows.where("dist < 5"), None)  # noqa: E731  an updater of one's own
    assert supersteps.step(start, places, own).count() == 2
    assert supersteps.step(start, places, supersteps.random_top_up(3)).where("src = 3").count() >= 1
