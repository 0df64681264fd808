import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import layered, levels, refine, search
from nearfield.operators.knn import knn
from nearfield.sources import snapshots

POINTS = np.random.default_rng(3).normal(size=(70, 4)).astype(np.float32)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(POINTS)], "vid long, vec array<float>").cache()


def asked(base):
    return base.where("vid % 20 = 0").select(F.col("vid").alias("qid"), "vec")


def rows(df):
    return sorted(map(tuple, df.collect()))


def edge_rows(spark, listed):
    return spark.createDataFrame(listed, "src long, dst long, dist double, is_new boolean")


def line(spark, *places):
    return spark.createDataFrame([(k, [float(x)]) for k, x in enumerate(places)], "vid long, vec array<float>")


def test_search_of_a_complete_graph_is_exact(base):
    edges = base.select(F.col("vid").alias("src")).join(base.select(F.col("vid").alias("dst")), F.expr("src <> dst"))
    entries = asked(base).select("qid", F.lit(3).cast("long").alias("vid"))
    found = search.search_flat(asked(base), edges, base, entries, 5, 8)
    assert rows(found) == rows(knn(base, asked(base), 5).select("qid", "rank", "vid", "dist"))
    with pytest.raises(ValueError):
        search.search_flat(asked(base), edges, base, entries, 9, 8)


def test_a_walk_stops_at_a_local_optimum(spark):
    base = line(spark, 0, 5, 3, 1)
    query = spark.createDataFrame([(9, [1.0])], "qid long, vec array<float>")
    edges = edge_rows(spark, [(0, 1, 5.0, True), (1, 2, 2.0, True), (2, 3, 2.0, True)])
    entry = spark.createDataFrame([(9, 0)], "qid long, vid long")
    assert rows(search.beam(query, edges, base, entry, 1)) == [(9, 0, 1.0)]
    assert [r[1] for r in rows(search.beam(query, edges, base, entry, 4))] == [0, 1, 2, 3]


def test_triangle_prunes_and_recommends(spark):
    base = line(spark, 0, 2, 3, -9)
    edges = edge_rows(spark, [(0, 1, 2.0, True), (0, 2, 3.0, True), (0, 3, 9.0, True)])
    assert rows(refine.triangle(edges, base)) == [(0, 1, 2.0, False), (0, 3, 9.0, False), (1, 2, 1.0, True)]
    old = edges.withColumn("is_new", F.lit(False))
    assert rows(refine.triangle(old, base)) == rows(old)


def test_graphs(base):
    graph = refine.knn_graph(base, 8)
    assert graph.where("src = dst").count() == 0 and graph.groupBy("src").count().agg(F.max("count")).first()[0] <= 8
    true = knn(base, base.select(F.col("vid").alias("qid"), "vec"), 8, exclude_self=True).select(F.col("qid").alias("src"), F.col("vid").alias("dst"))
    assert true.join(graph, ["src", "dst"]).count() >= 0.9 * true.count()
    assert refine.random_graph(base.limit(0), 4).count() == refine.random_graph(base.limit(1), 4).count() == 0
    layers, entry, top = layered.build(base, base.select("vid", F.when(F.col("vid") < 34, 1).otherwise(0).alias("highest_level")), 8, loops=1, triangles=1)
    assert top == 1 and layers.where("level = 1 AND (src >= 34 OR dst >= 34)").count() == 0
    found = search.search_layered(asked(base), layers, base, entry, top, 5, 20)
    assert found.join(knn(base, asked(base), 5), ["qid", "vid"]).count() >= 0.9 * found.count() > 0


def test_levels(spark, base):
    rows_of = [(v, 3) for v in range(31)] + [(v, 2) for v in range(31, 63)] + [(63, 0)]
    assert {h for _, h in rows(levels.compacted(spark.createDataFrame(rows_of, "vid long, highest_level int")))} == {0, 2}
    assert {h for _, h in rows(levels.compacted(spark.createDataFrame(rows_of[:31], "vid long, highest_level int")))} == {0}
    assert levels.max_weight(1024, 0.5) == 10 and levels.max_weight(1025, 0.5) == 11
    assert {r.highest_level for r in levels.random_levels(base, 0.5, 9).collect()} <= {0, 1}


def test_snapshots_and_registry(spark, tmp_path):
    path, registry = str(tmp_path / "g"), str(tmp_path / "r")
    edges = edge_rows(spark, [(0, 1, 2.0, True), (1, 0, 2.0, True)])
    snapshots.save_graph(edges, path, "knn", 2, degree=4)
    loaded, about = snapshots.load_graph(spark, path, "knn")
    assert rows(loaded) == [(0, 1, 2.0), (1, 0, 2.0)] and about["parameters"] == {"degree": 4}
    with pytest.raises(ValueError):
        snapshots.load_graph(spark, path, "layered")
    snapshots.save_graph(edges, path, "knn", 1)
    with pytest.raises(ValueError):
        snapshots.load_graph(spark, path, "knn")
    assert snapshots.find(spark, registry, "knn", {"degree": 4}) is None
    for where in ("a", "b"):
        snapshots.register(spark, registry, "knn", {"degree": 4}, where)
    snapshots.register(spark, registry, "knn", {"degree": 5}, "c")
    assert snapshots.find(spark, registry, "knn", {"degree": 4}) == "b" and snapshots.find(spark, registry, "knn", {"degree": 6}) is None
