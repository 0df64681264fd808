import numpy as np
import pytest

from nearfield.functions.distance import block_distances, parse_metric
from nearfield.operators import edges
from nearfield.operators.knn import knn
from nearfield.plans.config import NetConfig, PruneConfig, early_stop, edge_ratio, layer_capacity
from nearfield.sources.vectors import parse_vecs, read_vecs


def vectors(spark, rows, key="vid"):
    return spark.createDataFrame([(i, [float(x) for x in np.atleast_1d(v)]) for i, v in rows], f"{key} long, vec array<float>")


def test_metrics():
    a = np.array([[1.0, 2.0]])
    assert block_distances("cosine", a, np.array([[1, 2], [3.5, 7], [-1, -2], [0, 0]])).round(9).tolist() == [[0, 0, 2, 1]]
    assert block_distances("ip", a, a).tolist() == [[-5.0]]
    assert parse_metric("ANGULAR") == "cosine"
    with pytest.raises(ValueError):
        parse_metric("hamming")


def test_knn_of_a_subset_and_short_lists(spark):
    base = vectors(spark, enumerate([0, 2, 4, 7, 9])).where("vid IN (1, 3, 4)")
    got = knn(base, vectors(spark, [(0, 4), (1, 9)], "qid"), 2, "l2sqr").collect()
    assert sorted((r.qid, r.rank, r.vid, r.dist) for r in got) == [(0, 1, 1, 4.0), (0, 2, 3, 9.0), (1, 1, 4, 0.0), (1, 2, 3, 4.0)]
    assert knn(base, vectors(spark, [(0, 4)], "qid"), 9).count() == 3
    assert knn(base.limit(0), vectors(spark, [(0, 4)], "qid"), 9).count() == 0
    assert knn(base, vectors(spark, [(0, 4)], "qid"), 0).count() == 0


def test_ties_go_to_the_least_id_and_copies_stay(spark):
    base = vectors(spark, [(5, 1), (2, 1), (9, -1), (7, 0)])
    got = knn(base, vectors(spark, [(7, 0)], "qid"), 3, exclude_self=True).orderBy("rank").collect()
    assert [r.vid for r in got] == [2, 5, 9]


def test_edge_steps(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, False), (1, 0, 1.0, True), (0, 2, 3.0, True), (0, 3, 2.0, True)], "src long, dst long, dist double, is_new boolean")
    merged = {(r.src, r.dst): r.is_new for r in edges.symmetric(rows).collect()}
    assert merged[0, 1] is False and merged[1, 0] is True and merged[2, 0] is True and len(merged) == 6
    assert sorted(r.dst for r in edges.truncate(rows, 2).where("src = 0").collect()) == [1, 3]
    assert edges.truncate(rows, 5, 2.0).count() == 3


@pytest.mark.parametrize(("points", "rule", "shift", "kept"), [([3.25, 4.0], "scaled", 0.0, [1]), ([3.25, 4.0], "scaled_shifted", 1.5, [1, 2]), ([1.0, 2.0], "scaled", 0.0, [1, 2])])
def test_prune(spark, points, rule, shift, kept):
    base = vectors(spark, enumerate([0.0, *points]))
    rows = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate(points, 1)], "src long, dst long, dist double")
    assert sorted(r.dst for r in edges.prune(rows, base, 2.0, shift, rule).collect()) == kept


def test_thresholds():
    net, pruning = NetConfig(2, 3, 2), PruneConfig(2, 0.5, 2)
    assert [early_stop(h, net, pruning) for h in (1, 2, 3)] == [44, 108, 236]
    assert [edge_ratio(h, net, pruning) for h in range(4)] == [23.5, 14.875, 16.4375, 17.21875]
    assert layer_capacity(9, 1000) == 32
    with pytest.raises(ValueError):
        NetConfig(1, 0, 1)
    with pytest.raises(ValueError):
        early_stop(0, net, pruning)


def test_vector_files(spark, tmp_path):
    rows = np.array([[1.5, 2.5], [3.5, 4.5]], "<f4")
    content = b"".join(np.array([2], "<i4").tobytes() + r.tobytes() for r in rows)
    (tmp_path / "a.fvecs").write_bytes(content)
    assert [r.vec for r in read_vecs(spark, str(tmp_path / "a.fvecs")).orderBy("pos").collect()] == rows.tolist()
    assert len(parse_vecs(b"", "ivecs")) == 0
    for bad in (content[:-1], np.array([0], "<i4").tobytes(), content[:12] + np.array([3], "<i4").tobytes() + content[16:]):
        with pytest.raises(ValueError):
            parse_vecs(bad, "fvecs")
    with pytest.raises(ValueError):
        parse_vecs(content, "bvecs")


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 250
