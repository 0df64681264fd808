import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import compact, edges, evaluate, increments, insertion, refine, rnets, search
from nearfield.operators.knn import knn
from nearfield.plans.config import NetConfig
from nearfield.sources.snapshots import cut, released
from nearfield.streaming import ingest

POINTS = np.random.default_rng(6).normal(size=(240, 3)).astype(np.float32)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(POINTS)], "vid long, vec array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def graph(base):
    near = knn(base, base.withColumnRenamed("vid", "qid"), 9, exclude_self=True).select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist", F.lit(False).alias("is_new"))
    return cut(edges.symmetric(near))


@pytest.fixture
def asked(base):
    return base.where("vid % 11 = 0").select(F.col("vid").alias("qid"), "vec")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("metric, expand, stop", [("l2", 4, 0.3), ("cosine", 4, None), ("l2", 1, None)])
def test_in_task_search_agrees_with_the_relational_one(base, graph, asked, metric, expand, stop):
    packed = cut(compact.pack(graph, base, 64))
    entries = asked.select("qid", F.explode(F.array(F.lit(3), F.lit(77), F.lit(150)).cast("array<long>")).alias("vid"))
    found = compact.searched(compact.with_entries(asked, entries), packed, 12, metric, expand, stop)
    assert rows(found.select("qid", F.explode("found").alias("f")).select("qid", "f.vid", "f.dist")) == rows(search.beam(asked, graph, base, entries, 12, metric, expand, stop))


def test_routed_search(base, graph, asked, monkeypatch):
    packed = cut(compact.pack(graph, base, 64, part=40))
    assert packed.count() == 6
    near = compact.search_flat(compact.from_one(asked, 5), packed, 5, 20)
    true = rows(knn(base, asked, 5).select("qid", "rank", "vid", "dist"))
    monkeypatch.setattr(compact, "FEW_BYTES", 0)
    monkeypatch.setattr(compact, "BLOCK", 7)
    routed = compact.search_flat(compact.from_one(asked, 5), packed, 5, 20)
    assert len(set(rows(routed)) & set(true)) >= 0.97 * len(true) and len(set(rows(near)) & set(true)) >= 0.97 * len(true)
    every = base.select(F.col("vid").alias("src")).where("src < 60").join(base.select(F.col("vid").alias("dst")).where("dst < 60"), F.expr("src <> dst")).withColumn("dist", F.lit(0.0))
    some = base.where("vid < 60")
    complete = cut(compact.pack(every, some, 59, part=16))
    assert rows(compact.search_flat(compact.from_one(asked, 7), complete, 5, 8)) == rows(knn(some, asked, 5).select("qid", "rank", "vid", "dist"))
    assert compact.search_flat(compact.from_one(asked.limit(0), 7), complete, 5, 8).count() == 0


def test_parts_by_locality_are_seldom_left(spark, monkeypatch):
    rnd = np.random.default_rng(12)
    at = np.concatenate([rnd.normal(size=(60, 2)) + [9.0 * k, 0.0] for k in range(4)]).astype(np.float32)
    order = rnd.permutation(240)
    points = spark.createDataFrame([(int(v), at[k].tolist()) for k, v in enumerate(order)], "vid long, vec array<float>").cache()
    near = knn(points, points.withColumnRenamed("vid", "qid"), 8, exclude_self=True).select(F.col("qid").alias("src"), F.col("vid").alias("dst"), "dist", F.lit(False).alias("is_new"))
    graph, asked = cut(edges.symmetric(near)), points.where("vid % 11 = 0").select(F.col("vid").alias("qid"), "vec")
    homes = compact.local_parts(points, 60)
    assert homes.select("part").distinct().count() >= 4 and homes.count() == 240
    entries = asked.select("qid", F.expr("qid").alias("vid"))
    monkeypatch.setattr(compact, "FEW_BYTES", 0)
    rounds, plain = {}, compact.released
    for name, parts in (("local", compact.pack(graph, points, 64, homes=homes)), ("range", compact.pack(graph, points, 64, part=60))):
        turns: list = []
        monkeypatch.setattr(compact, "released", lambda *old: turns.append(1) or plain(*old))
        found = compact.search_flat(compact.with_entries(asked, entries), cut(parts), 5, 20)
        true = knn(points, asked, 5)
        assert found.join(true, ["qid", "vid"]).count() >= 0.97 * true.count()
        rounds[name] = len(turns)
    assert rounds["local"] < rounds["range"]


def test_widening_a_search(base, asked):
    """A state of 20 that is reopened at 40 equals a fresh search at 40, on a complete graph."""
    every = base.select(F.col("vid").alias("src")).join(base.select(F.col("vid").alias("dst")), F.expr("src <> dst")).withColumn("dist", F.lit(0.0))
    packed = cut(compact.pack(every, base, 239))
    narrow = compact.searched(compact.from_one(asked, 3), packed, 20)
    wide = compact.searched(compact.reopened(narrow), packed, 40)
    assert rows(wide.select("qid", "found")) == rows(compact.searched(compact.from_one(asked, 3), packed, 40).select("qid", "found"))
    assert rows(compact.ranked(wide, 40)) == rows(knn(base, asked, 40).select("qid", "rank", "vid", "dist"))
    with pytest.raises(ValueError):
        compact.search_flat(compact.from_one(asked, 3), packed, 9, 8)


def kernel(places, near):
    n = len(places)
    ids = np.full((n, max(map(len, near))), -1)
    for k, row in enumerate(near):
        ids[k, : len(row)] = row
    return compact.held([compact.Part(np.arange(n), ids, np.array(places, dtype=np.float32)[:, None])])


def test_candidates_at_the_boundary():
    """A full state takes a candidate that is nearer than its last, or as far with a smaller id; never one that is there."""
    graph = kernel([0, 1, 2, -2, 3], [[1, 2], [3], [], [4], []])
    q = np.zeros((1, 1))
    full = compact.best(np.array([[1, 3]]), np.array([[1.0, 2.0]]), np.array([[False, False]]), 2)
    tie = compact.best(np.c_[full.place, [[2]]], np.c_[full.dist, [[2.0]]], np.c_[full.open, [[True]]], 2)
    assert tie.place.tolist() == [[1, 2]] and tie.open.tolist() == [[False, True]]
    again = compact.best(np.c_[full.place, [[3]]], np.c_[full.dist, [[2.0]]], np.c_[full.open, [[True]]], 3)
    assert again.place.tolist() == [[1, 3, -1]] and not again.open.any()  # met again it stays closed
    one = compact.walk(graph, q, compact.entered(graph, q, np.array([[0]]), 1, "l2"), 1, "l2")[0]
    assert one.place.tolist() == [[0]]
    two, away = compact.walk(graph, q, compact.entered(graph, q, np.array([[4]]), 2, "l2"), 2, "l2")
    assert two.place.tolist() == [[4, -1]] and not two.open.any() and away == []
    far = compact.walk(graph, q, compact.entered(graph, q, np.array([[4]]), 2, "l2"), 2, "l2", limit=np.array([1.0]))[0]
    assert far.open.tolist() == [[True, False]]  # beyond the limit it is not expanded


def test_packed_files(spark, base, graph, tmp_path):
    levels = base.select("vid", F.when(F.col("vid") % 6 == 0, 1).otherwise(0).alias("highest_level"))
    upper = graph.where("src % 6 = 0 AND dst % 6 = 0")
    layers = graph.select(F.lit(0).alias("level"), "src", "dst", "dist").unionByName(upper.select(F.lit(1).alias("level"), "src", "dst", "dist"))
    compact.save_packed(compact.pack_layers(layers, levels, base, 2, 4, 1), str(tmp_path / "g"))
    stored = compact.load_packed(spark, str(tmp_path / "g"))
    about = {r.level: r for r in compact.sizes(stored).collect()}
    cut_rows = lambda df, n: df.groupBy("src").count().select(F.sum(F.least("count", F.lit(n)))).first()[0]
    assert about[0].vertices == 240 and about[1].vertices == 40 and about[0].edges == cut_rows(graph, 4) and about[1].edges == cut_rows(upper, 2)
    assert about[0].bytes == 240 * (8 + 4 * 8 + 3 * 4)
    part = compact.unpacked(stored.where("level = 0").first().content)
    d = np.sqrt(((POINTS[part.rows[5]].astype(float) - POINTS[5]) ** 2).sum(axis=1))
    assert (np.diff(d) >= 0).all() and (part.rows[5] >= 0).all()


def test_cuts_can_be_released(base):
    one = cut(base)
    assert one.count() == 240
    released(one, base)
    with pytest.raises(Exception):
        one.collect()


NET = NetConfig(2.0, 0.0, 0.35)
CAPS = insertion.Caps(8, 16, 20, 40, 40, 1.1)


def invariants(graph, base, asked):
    assert all(r.crowded == r.uncovered == 0 for r in rnets.violations(base, graph.levels, NET).collect())
    long = graph.layers.groupBy("level", "src").count().where(F.col("count") > F.when(F.col("level") > 0, 8).otherwise(16))
    assert long.count() == 0 and graph.layers.where("src = dst").count() == 0
    ends = graph.layers.select("level", F.explode(F.array("src", "dst")).alias("vid")).join(graph.levels, "vid").where("highest_level < level")
    assert ends.count() == 0
    found, true = insertion.found_by(graph, asked, 5, 30, CAPS), knn(base, asked, 5)
    assert found.join(true, ["qid", "vid"]).count() >= 0.9 * true.count()


def test_insertion(base, asked):
    graph = insertion.insert(insertion.empty(base), base, NET, 3, CAPS, first=100, wave=140)
    assert graph.top == 3 and graph.levels.count() == 240
    invariants(graph, base, asked)
    same = insertion.insert(insertion.empty(base), base.repartition(5), NET, 3, CAPS, first=100, wave=140)
    assert rows(same.layers) == rows(graph.layers) and rows(same.levels) == rows(graph.levels)


def test_conflicts_inside_a_batch_and_with_the_net(spark):
    line = lambda *xs: spark.createDataFrame([(i, [float(x)]) for i, x in xs], "vid long, vec array<float>")
    net = NetConfig(2.0, 0.0, 1.0)
    graph = insertion.insert_wave(insertion.empty(line((0, 0))), line((0, 0.0), (1, 10.0)), net, 2)
    grown = insertion.insert_wave(graph, line((2, 1.0), (3, 4.0), (4, 4.5), (5, 5.1)), net, 2)
    up = {r.vid: r.highest_level for r in grown.levels.collect()}
    assert up[0] >= 1 and up[1] >= 1 and up[2] == 0  # 2 lies within the radius of 0
    assert sorted(v for v in (3, 4, 5) if up[v] >= 1) in ([4], [3, 5])  # of 3 and 4, and 4 and 5, one vetoes the other


def test_three_batches_and_their_replay(spark, base, asked, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "versions")
    for k in range(3):
        base.where(F.col("vid") % 3 == k).orderBy("vid").coalesce(1).select("vec").write.parquet(str(source / f"part{k}"))
        stream = spark.readStream.schema("vec array<float>").option("maxFilesPerTrigger", 100).parquet(str(source / "*"))
        ingest.ingest_layered(stream, folder, str(tmp_path / "c"), NET, 3, CAPS).awaitTermination()
    assert ingest.versions(spark, folder) == [0, 1, 2]
    graph = ingest.read_layered_version(spark, folder, 2)
    mine = graph.vectors.where("vid % 11 = 0").select(F.col("vid").alias("qid"), "vec")
    invariants(graph, graph.vectors, mine)
    before = rows(graph.layers), rows(graph.levels)
    batch = spark.read.parquet(str(source / "part2"))
    ingest.ingest_layered_batch(batch, 2, folder, NET, 3, CAPS)  # a batch that is run again
    again = ingest.read_layered_version(spark, folder, 2)
    assert (rows(again.layers), rows(again.levels)) == before


def test_growing_with_refinement_and_by_drawn_levels(base, asked):
    first, second = base.where("vid < 180"), base.where("vid >= 180")
    refine = dict(loops=1, triangles=1, routing=1)
    graph = increments.add_layered(insertion.empty(base), first, NET, 1, CAPS, refine)
    graph = increments.add_layered(graph, second, NET, 1, CAPS, refine)
    invariants(graph, base, asked)
    drawn = insertion.empty(base)
    for batch in (first, second):
        drawn = increments.add_hierarchical(drawn, batch, 0.25, 2, CAPS)
    sizes = [drawn.levels.where(F.col("highest_level") >= h).count() for h in range(3)]
    assert sizes[0] == 240 and 30 <= sizes[1] <= 90 and sizes[2] <= 40
    found = insertion.found_by(drawn, asked, 5, 30, CAPS)
    assert found.join(knn(base, asked, 5), ["qid", "vid"]).count() >= 0.9 * found.count() > 0


def test_search_goes_on_until_recall(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(400, 32)).astype(np.float32)
    base = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vid long, vec array<float>")
    asked = base.where("vid % 10 = 0").withColumnRenamed("vid", "qid")
    true = cut(knn(base, asked, 10))
    graph = cut(edges.symmetric(refine.random_graph(base, 4)))  # a poor one
    packed = cut(compact.pack(graph, base, 32))
    recall = lambda found: evaluate.recall_at_k(found, true, 10).first()[0]
    assert recall(compact.search_flat(compact.from_one(asked, 0), packed, 10, 10)) < 0.9
    for truth in (true, true.where("qid < 100")):  # of all, or of some
        found = compact.search_until(compact.from_one(asked, 0), packed, 10, 10, truth)
        assert recall(found.join(truth.select("qid").distinct(), "qid", "left_semi")) >= (0.9 if truth is true else 0.2)
        assert found.groupBy("qid").count().where("count <> 10").isEmpty() and found.select("qid").distinct().count() == 40


def test_neighbour_rows_are_completed(spark, monkeypatch):
    v = np.random.default_rng(13).normal(size=(300, 32))
    base = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vid long, vec array<float>")
    poor = refine.random_graph(base, 6)
    assert refine.recall_of(poor, base, 6) < 0.9
    got = refine.knn_graph(base, 6, loops=1, triangles=1, routing=0)  # too little to find them
    assert refine.recall_of(got, base, 6) >= 0.9 and got.count() == 300 * 6
    assert refine.recall_of(refine.routed(poor, base, 6), base, 6) == 1.0  # all with all
    monkeypatch.setattr(refine, "DIRECT", 0)
    assert refine.recall_of(refine.routed(poor, base, 6), base, 6) < 1.0  # by searches, which find less on this graph
    assert refine.recall_of(refine.knn_graph(base, 6, loops=1, triangles=1, routing=1, width=6), base, 6) >= 0.9


def test_complete_search_is_a_walk_that_drops_nothing():
    rng = np.random.default_rng(14)
    vec = np.round(rng.normal(size=(90, 3)), 1).astype(np.float32)  # with ties
    rows = rng.integers(0, 60, (90, 2))  # 60 to 89 lead into the others, none to them
    graph = compact.held([compact.Part(np.arange(90), rows, vec)])
    q = rng.normal(size=(7, 3))
    places = np.array([[-1, 3], [-1, 3], [5, 70], [-1, -1], [61, 89], [-1, 3], [-1, 80]])
    for metric in ("l2", "ip"):
        want, _ = compact.walk(graph, q, compact.entered(graph, q, places, 90, metric), 90, metric)
        got = compact.complete(graph, q, places, 90, metric)
        assert (got.place == want.place).all() and not got.open.any()
        assert np.allclose(np.where(got.place < 0, 0, got.dist), np.where(want.place < 0, 0, want.dist), atol=2e-6)
        assert (compact.complete(graph, q, places, 4, metric).place == want.place[:, :4]).all()
