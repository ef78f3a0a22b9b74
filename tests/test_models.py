import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.numbering import with_row_numbers
from ledgerlens.operators import evaluation, neighbors, preparation, scoring
from ledgerlens.operators import forest as iforest
from ledgerlens.session import new_path


def cloud(copies=60):
    """Two groups, a third of all rows at one place, and two far points."""
    rng = np.random.default_rng(11)
    parts = [
        rng.normal(0, 0.3, (60, 3)),
        rng.normal(5, 0.3, (60, 3)),
        np.tile([[2.0, 2.0, 2.0]], (copies, 1)),
        np.array([[20.0, 20.0, 20.0], [-15.0, 4.0, 9.0]]),
    ]
    return np.concatenate(parts)


def as_frame(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>")


def pairwise(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_knn_equals_brute_force(spark, block_rows):
    x = cloud()
    d = pairwise(x)
    k = 7
    found = neighbors.knn_join(as_frame(spark, x), k, block_rows=block_rows).collect()
    got = {}
    for r in found:
        got.setdefault(r.id, []).append((r.rank, r.neighbor, r.distance))
    assert len(got) == len(x)
    for i, rows in got.items():
        rows.sort()
        order = sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)[:k]
        assert [r[1] for r in rows] == [j for _, j in order]
        assert np.allclose([r[2] for r in rows], [v for v, _ in order], atol=1e-8)


def test_eps_join_equals_brute_force(spark):
    x = cloud(copies=1)
    d = pairwise(x)
    got = {(r.id, r.neighbor) for r in neighbors.eps_join(as_frame(spark, x), 0.6, block_rows=16).collect()}
    n = len(x)
    assert got == {(i, j) for i in range(n) for j in range(n) if i != j and d[i, j] <= 0.6}


def test_eps_join_carries_copies(spark):
    x = np.array([[0.0], [0.0], [0.0], [0.5]])
    rows = {(r.id, r.neighbor): r.neighbor_weight for r in neighbors.eps_join(as_frame(spark, x), 1.0).collect()}
    assert rows == {(0, 3): 1, (3, 0): 3}


def brute_lof(x, k):
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    reach = np.maximum(dist, dist[near, -1])
    density = 1.0 / (reach.mean(axis=1) + 1e-10)
    return density[near].mean(axis=1) / density


@pytest.mark.parametrize("copies,block_rows", [(1, 2048), (60, 16)])
def test_lof_equals_brute_force(spark, copies, block_rows):
    x = cloud(copies)
    expected = brute_lof(x, 10)
    got = {r.id: r.lof for r in neighbors.lof(as_frame(spark, x), k=10, block_rows=block_rows).collect()}
    assert len(got) == len(x)
    assert np.allclose([got[i] for i in range(len(x))], expected, rtol=1e-6)


def brute_dbscan(x, eps, min_samples):
    near = pairwise(x) <= eps
    core = near.sum(axis=1) >= min_samples
    cluster = {}
    for start in range(len(x)):
        if core[start] and start not in cluster:
            pending = [start]
            while pending:
                i = pending.pop()
                if i in cluster:
                    continue
                cluster[i] = start
                pending += [j for j in np.nonzero(near[i] & core)[0] if j not in cluster]
    for i in range(len(x)):
        if not core[i]:
            names = [cluster[j] for j in np.nonzero(near[i] & core)[0]]
            if names:
                cluster[i] = min(names)
    return cluster, core


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_dbscan_equals_brute_force(spark, block_rows):
    x = cloud()
    cluster, core = brute_dbscan(x, 0.5, 5)
    got = {r.id: r for r in neighbors.dbscan(as_frame(spark, x), eps=0.5, min_samples=5, block_rows=block_rows).collect()}
    assert len(got) == len(x)
    for i, r in got.items():
        assert r.cluster == cluster.get(i)
        assert r.is_noise == (i not in cluster)
        assert r.is_core == bool(core[i])


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, j) for j in range(1001, 1100)]
    edges = spark.createDataFrame(chain + star, "a bigint, b bigint")
    got = {r.node: r.component for r in neighbors.connected_components(edges).collect()}
    assert set(got.values()) == {0, 1000}
    assert all(got[i] == 0 for i in range(101))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4))
    x[:5] += 9.0
    rows = [(f"w{i:05d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "wallet_address string, a double, b double, c double, d double")


def test_forest_finds_planted_outliers(spark, table):
    columns = ("a", "b", "c", "d")
    fitted = iforest.isolation_forest_fit(table, columns)
    assert fitted.nodes.select("tree").distinct().count() == iforest.TREES
    assert fitted.nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 2 * iforest.SAMPLE_ROWS - 1
    scored = iforest.isolation_forest_score(table, fitted).orderBy("decision").collect()
    assert {r.wallet_address for r in scored[:5]} == {f"w{i:05d}" for i in range(5)}
    share = sum(r.prediction == -1 for r in scored) / len(scored)
    assert abs(share - iforest.CONTAMINATION) < 0.005
    path = new_path(spark, "forest")
    fitted.save(path)
    again = iforest.isolation_forest_score(table, iforest.Forest.load(spark, path)).orderBy("decision").collect()
    assert [r.decision for r in again] == [r.decision for r in scored]


def test_forest_sample_is_without_replacement(table):
    samples = iforest.tree_samples(table, "wallet_address", 1500, trees=10, sample_rows=200)
    counts = samples.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("wallet_address").alias("d")).collect()
    assert len(counts) == 10
    assert all(r.n == 200 == r.d for r in counts)


def test_unused_feature_has_no_importance(table):
    flat = table.withColumn("d", F.lit(1.0))
    fitted = iforest.isolation_forest_fit(flat, ("a", "b", "c", "d"), trees=20)
    rows = iforest.permutation_importance(flat, fitted).collect()
    importance = {r.feature: r.importance for r in rows}
    assert importance["d"] == 0.0
    assert all(importance[c] > 0 for c in "abc")
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4]
    assert sum(r.importance_normalized for r in rows) == pytest.approx(1.0)


def test_ensemble_weights_are_rescaled(spark):
    frame = spark.createDataFrame([(1.0, 1.0)], "isolation_forest_score double, lof_score double")
    assert scoring.ensemble_score(frame).first().fraud_score == pytest.approx(1.0)
    assert scoring.ensemble_score(spark.range(1)).first().fraud_score == 0.0


def test_min_max_of_constant_column_is_zero(spark):
    frame = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r.s for r in scoring.min_max(frame, "v", "s").collect()] == [0.0, 0.0]


def test_silhouette_and_indices_on_separated_groups(spark):
    x = cloud(copies=1)[:120]
    frame = as_frame(spark, x).withColumn("cluster", (F.col("id") >= 60).cast("int"))
    row = evaluation.cluster_quality(frame, block_rows=32).first()
    assert row.n_clusters == 2 and row.n_noise == 0
    assert row.silhouette_score > 0.9 and row.davies_bouldin_score < 0.2
    single = evaluation.cluster_quality(frame.withColumn("cluster", F.lit(1))).first()
    assert single.silhouette_score is None and single.davies_bouldin_score is None


def test_silhouette_equals_all_distances(spark):
    draw = np.random.default_rng(5)
    x = np.r_[draw.normal(size=(500, 3)), 1e3 + 1e-4 * draw.normal(size=(400, 3))]
    x[450:480] = x[0]
    cluster = draw.integers(0, 4, len(x))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sums = np.stack([d[:, cluster == c].sum(1) for c in range(4)], 1)
    sizes, rows = np.bincount(cluster), np.arange(len(x))
    own = sums[rows, cluster] / (sizes[cluster] - 1)
    means = sums / sizes
    means[rows, cluster] = np.inf
    other = means.min(1)
    frame = spark.createDataFrame([(int(i), x[i].tolist(), int(cluster[i])) for i in rows], "id bigint, vec array<double>, cluster int")
    for block_rows in (evaluation.SIDE_ROWS, 100):
        got = evaluation.silhouette(frame, block_rows=block_rows).first().silhouette_score
        assert got == pytest.approx(np.mean((other - own) / np.maximum(own, other)), rel=1e-7)


def test_each_pair_of_silhouette_blocks_meets_once(spark):
    points = spark.range(10_000).select("id")
    dealt = evaluation._blocks_in_pairs(points, 1_000, 10_000).groupBy("low", "high").count().collect()
    assert {(r.low, r.high) for r in dealt} == {(i, j) for i in range(10) for j in range(i, 10)}
    assert sum(r["count"] for r in dealt) == 10 * 10_000


def test_distance_sums_of_odd_rows():
    draw = np.random.default_rng(6)
    a, b = draw.normal(size=(300, 4)), draw.normal(size=(290, 4))
    b[7], b[8] = a[3], a[3] + 1e-9
    odd = a.copy()
    odd[5] = np.nan
    of_a, of_b = np.eye(3)[np.arange(300) % 3], np.eye(2)[np.arange(290) % 2]
    for x in (a, odd):
        d = neighbors.distances(x, b)
        from_a, from_b = evaluation.distance_sums(x, b, of_a, of_b)
        np.testing.assert_allclose(from_a, d @ of_b, rtol=1e-9)
        np.testing.assert_allclose(from_b, d.T @ of_a, rtol=1e-9)


def test_impute_and_scale(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (float("nan"), 5.0)], "a double, b double")
    assert [r.a for r in preparation.impute(frame, ["a", "b"]).collect()] == [1.0, 2.0, 3.0, 2.0]
    scaled, parameters = preparation.scale(preparation.impute(frame, ["a", "b"]), ["a", "b"])
    assert [r.b for r in scaled.collect()] == [0.0] * 4
    assert parameters.first().b_spread == 1.0


def test_row_numbers_over_partitions(spark):
    rows = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(997))).alias("v"), "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_row_numbers(rows, [F.col("v"), F.col("id")], "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.v, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((r.v, r.id) for r in got)
    assert sorted(r.place for r in got) == list(range(5000))
    assert with_row_numbers(rows.filter("false"), [F.col("id")], "place").count() == 0


def test_pairs_are_one_permutation_of_all_rows(spark):
    rows = spark.range(3000).select("id", F.array(F.col("id").cast("double")).alias("x"))
    got = iforest.random_pairs(rows, "id", seed=5).collect()
    assert sorted(r.id for r in got) == sorted(r.other_key for r in got) == list(range(3000))
    assert all(r.x == [r.id] and r.other == [r.other_key] for r in got)
    orders = rows.select("id", *[F.xxhash64("id", F.lit(5 + k)).alias(f"h{k}") for k in (1, 2)]).collect()
    first, second = (sorted(orders, key=lambda r: (r[f"h{k}"], r.id)) for k in (1, 2))
    assert {(r.id, r.other_key) for r in got} == {(a.id, b.id) for a, b in zip(first, second)}
