"""How much work the neighbour search does, what it misses when asked to be approximate, and odd inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import grid, lsh, metric_tree, neighbors


def clustered(n, dims=6, seed=1):
    """Clusters of about 50 points; with more points, more clusters in the same space."""
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-50, 50, (n // 50, dims))
    return centers[rng.integers(0, len(centers), n)] + rng.normal(0, 0.5, (n, dims))


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vec": list(map(list, x)), "weight": 1}), "id bigint, vec array<double>, weight bigint")


def nearest(x, rows, k):
    d = np.sqrt(((x[rows][:, None] - x[None]) ** 2).sum(2))
    d[np.arange(len(rows)), rows] = np.inf
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def as_lists(found):
    return {i: g.sort_values(["distance", "neighbor"]).neighbor.tolist() for i, g in found.toPandas().groupby("id")}


def test_search_does_far_less_than_all_pairs(spark):
    k, work, leaf_rows = 5, {}, 64
    for n in (2_000, 20_000):
        x = clustered(n)
        search = metric_tree.search_tree(metric_tree.build_tree(frame(spark, x), leaf_rows), k)
        work[n] = search.compared
        got = as_lists(search.neighbors)
        asked = np.random.default_rng(2).choice(n, 100, replace=False)
        want, _ = nearest(x, asked, k)
        assert len(got) == n and all(got[i] == w.tolist() for i, w in zip(asked.tolist(), want))
    assert work[20_000] < 0.05 * 20_000**2
    # ten times the points: a quadratic search would do a hundred times the work
    assert work[20_000] < 25 * work[2_000]


def test_leaves_are_bounded_however_points_lie(spark):
    # nearly all points in a tiny spot, a few far away
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1e-6, (900, 2)), rng.uniform(-1e6, 1e6, (30, 2))]
    tree = metric_tree.build_tree(frame(spark, x), 40)
    assert tree.points.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 40
    assert tree.points.select("id").distinct().count() == len(x)
    got = as_lists(metric_tree.search_tree(tree, 3).neighbors)
    want, _ = nearest(x, np.arange(len(x)), 3)
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_leaves_travel_in_bundles_of_bounded_size(spark):
    # directions in which nothing can be left out, and copies far away that make the tree uneven
    x = np.random.default_rng(4).normal(size=(3_000, 16))
    x[2_900:] = 1e3 + 1e-3 * x[2_900:]
    tree = metric_tree.build_tree(frame(spark, x), 30)
    tips = tree.nodes.join(tree.nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    of = metric_tree.bundles(tree, tips, 300)
    sizes = [r.n for r in tree.points.join(of, "leaf").groupBy("bundle").agg(F.count("*").alias("n")).collect()]
    leaves = tips.count()
    assert sum(sizes) == len(x) and max(sizes) < 600
    assert of.count() == leaves and 3 * len(sizes) < leaves
    asked = np.arange(0, 3_000, 29)
    want, _ = nearest(x, asked, 4)
    # bundles of 300 points, then of one leaf
    for size, waves in ((300 * 8 * 16, (1, 3)), (1, (64,))):
        got = as_lists(metric_tree.search_tree(tree, 4, waves, size).neighbors)
        assert len(got) == len(x) and [got[i] for i in asked.tolist()] == want.tolist()


def test_ties_on_a_lattice_go_to_the_smaller_id(spark):
    x = np.array([[i, j] for i in range(12) for j in range(12)], float)
    points = frame(spark, x)
    got = as_lists(neighbors.knn_join(points.drop("weight"), 6, block_rows=20))
    want, _ = nearest(x, np.arange(len(x)), 6)
    assert [got[i] for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_points_than_neighbors(spark, n):
    found = neighbors.knn_join(frame(spark, clustered(50)[:n]).drop("weight"), 5).collect()
    assert len(found) == n * max(n - 1, 0)


def test_approximate_neighbors_have_high_recall(spark):
    k, n = 10, 4_000
    x = clustered(n, dims=16)
    points = frame(spark, x)
    exact = as_lists(neighbors.knn_join(points.drop("weight"), k))
    close = as_lists(neighbors.knn_join(points.drop("weight"), k, method="approximate"))
    recall = np.mean([len(set(exact[i]) & set(close.get(i, []))) / k for i in range(n)])
    assert recall >= 0.9
    with pytest.raises(ValueError):
        neighbors.knn_join(points.drop("weight"), k, method="fast")


def test_crowded_buckets_are_cut(spark):
    rows = [(i, float(i % 7 == 0) * i, b) for b in (1, 2) for i in range(500)]
    placed = spark.createDataFrame(rows, "id bigint, line double, bucket bigint")
    blocks = lsh.in_line_blocks(placed, 50).groupBy("bucket", "block").count().toPandas()
    assert blocks["count"].sum() == 1000 and blocks["count"].max() < 100


def test_grid_copies_stay_few(spark):
    x = clustered(5_000)
    g = grid.build_grid(frame(spark, x), 0.6, 40)
    cells = g.points.select("cell").distinct().count()
    copies = g.copies(g.points).count()
    assert cells > 100
    assert copies <= 3 * len(x)
    d = nearest(x, np.arange(300), 1)[1]
    want = {(i, j) for i, j in zip(*np.nonzero(d <= 0.6))}
    got = {(r.id, r.neighbor) for r in neighbors.eps_join(frame(spark, x).drop("weight"), 0.6, block_rows=40).filter("id < 300").collect()}
    assert got == want


@pytest.mark.parametrize("eps", [0.0, 1.0, 1e9])
def test_grid_with_odd_distances(spark, eps):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0], [5.0, 0.0], [5.5, 0.0], [-3.0, 0.0]])
    got = {(r.id, r.neighbor) for r in neighbors.eps_join(frame(spark, x).drop("weight"), eps).collect()}
    firsts = [0, 1, 3, 4, 5]
    assert got == {(i, j) for i in firsts for j in firsts if i != j and abs(x[i] - x[j]).max() <= eps}


def test_clusters_over_many_cells(spark):
    # a line of points half a distance apart is one cluster, however the grid cuts it
    x = np.c_[np.arange(600) * 0.25, np.zeros(600)]
    rows = neighbors.dbscan(frame(spark, x).drop("weight"), eps=0.5, min_samples=3, block_rows=25).collect()
    assert {r.cluster for r in rows} == {0} and len(rows) == 600


def test_smallest_linked():
    a, b = np.array([5, 4, 3, 8]), np.array([4, 3, 2, 9])
    assert neighbors.smallest_linked(10, a, b).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]


def test_within_decides_as_differences_do():
    from ledgerlens.operators.metric_tree import within

    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(1500, 2)), 1)
    x[3], x[5], x[7] = np.nan, np.inf, 1e200
    steps = np.arange(60.0)[:, None]
    for a, b, radius in ((x, x[:400], 0.5), (steps, steps, 5.0), (x[10:30], x[10:30] + 1e-12, 0.0)):
        with np.errstate(all="ignore"):
            assert (within(a, b, radius) == (neighbors.distances(a, b) <= radius)).all()
