"""Neighbour search over vectors, and the density methods built on it.

Nearest neighbours come from a tree of balls (`metric_tree`), neighbours within a distance from an adaptive grid (`grid`).
A task compares bounded blocks, whatever the data looks like, and returns a reduced result: the k nearest, a neighbour
count, or a spanning forest, never all its pairs. Identical vectors are merged into one weighted point first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.grid import build_grid
from ledgerlens.operators.lsh import approximate_neighbors
from ledgerlens.operators.metric_tree import LEAF_ROWS, build_tree, fresh, pair_distances, search_tree, within
from ledgerlens.operators.metric_tree import stack as _stack
from ledgerlens.session import materialize

BLOCK_ROWS = 2048
BUNDLE_BLOCKS = 8
LEAST_BUNDLES = 8
# Model defaults.
LOF_NEIGHBORS = 20
DBSCAN_EPS = 0.5
DBSCAN_MIN_SAMPLES = 5
DENSITY_FLOOR = 1e-10


def as_points(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id, vec) from a key and feature columns."""
    return df.select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))


def vector_points(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) from a key and an array column."""
    return df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"))


def distinct_points(points: DataFrame) -> DataFrame:
    """(id, vec, weight): copies of a vector become one point named by the smallest id."""
    return points.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences (no cancellation), in slices that keep the temporary array small."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, len(b) * a.shape[1]))
    for start in range(0, len(a), step):
        diff = a[start : start + step, None, :] - b[None, :, :]
        out[start : start + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _in_slices(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the listed pairs."""
    parts = range(0, len(rows), 100_000)
    return np.concatenate([np.empty(0), *(pair_distances(a[rows[i : i + 100_000]], b[cols[i : i + 100_000]]) for i in parts)])


def compare_blocks(
    left: DataFrame,
    right: DataFrame,
    reduce_blocks: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Apply `reduce_blocks` to every pair of blocks (left, right) of the same `cell`.

    Both sides of a cell are cut by hash into bundles of up to `BUNDLE_BLOCKS` blocks of about `block_rows` rows, fewer
    where a cell has few blocks, so that pairs of bundles still make many tasks. A row is sent once for each bundle of the
    other side; in the task each pair of blocks meets. `merge` reduces what the pairs of two bundles give together.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        bundles = F.greatest(F.ceil(n / (BUNDLE_BLOCKS * block_rows)), F.least(F.ceil(n / block_rows), F.lit(LEAST_BUNDLES)))
        return df.groupBy("cell").agg(bundles.cast("int").alias(name))

    right = fresh(right)
    plan = blocks(left, "left_blocks").join(blocks(right, "right_blocks"), "cell")

    def keyed(df: DataFrame, mine: str, other: str, my_id: str, other_id: str) -> DataFrame:
        placed = df.join(plan, "cell").withColumn(my_id, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_id)
        return placed.select(*df.columns, my_id, copies)

    keys = ["cell", "lb", "rb"]
    a = keyed(left, "left_blocks", "right_blocks", "lb", "rb")
    b = keyed(right, "right_blocks", "left_blocks", "rb", "lb")

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame()
        found = None
        for i in range(0, len(l), block_rows):
            met = [reduce_blocks(l[i : i + block_rows], r[j : j + block_rows]) for j in range(0, len(r), block_rows)]
            found = pd.concat(met if found is None else [found, *met], ignore_index=True)
            if merge is not None:
                found = merge(found)
        return found

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(run, schema)


def nearest_distinct(weighted: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, neighbor, neighbor_weight, distance): the k nearest other distinct points; ties go to the smaller id."""
    # a split node must hold k others of each of its points
    return search_tree(build_tree(weighted, max(leaf_rows, k + 1)), k).neighbors


def knn_join(points: DataFrame, k: int, *, method: str = "exact", block_rows: int = LEAF_ROWS, **lsh) -> DataFrame:
    """(id, neighbor, distance, rank): the k nearest other points of every (id, vec) point.

    `method` is "exact", or "approximate" for random projections into buckets, with the parameters of
    `lsh.approximate_neighbors`; the choice is the caller's alone and never follows from the size of the data.

    Copies of a vector are neighbours of each other at distance 0. The search runs over distinct vectors; of each vector
    only the k+1 smallest ids can appear in an answer, so a large group of copies adds k+1 candidates, not all of them.
    """
    weighted = materialize(distinct_points(points))
    if method not in ("exact", "approximate"):
        raise ValueError(f"method {method!r} is neither exact nor approximate")
    found = nearest_distinct(weighted, k, block_rows) if method == "exact" else approximate_neighbors(weighted, k, **lsh)
    nearest = found.select("id", "neighbor", "distance")
    with_self = nearest.unionByName(
        weighted.select("id", F.col("id").alias("neighbor"), F.lit(0.0).alias("distance"))
    )
    named = materialize(
        points.join(weighted.select("vec", F.col("id").alias("representative")), "vec").select("id", "representative")
    )
    by_id = Window.partitionBy("representative").orderBy("id")
    first_copies = (
        named.withColumn("_rank", F.row_number().over(by_id))
        .filter(F.col("_rank") <= k + 1)
        .select(F.col("representative").alias("neighbor"), F.col("id").alias("copy"))
    )
    by_distance = Window.partitionBy("representative").orderBy("distance", "copy")
    candidates = (
        with_self.join(first_copies, "neighbor")
        .select(F.col("id").alias("representative"), "copy", "distance")
        .withColumn("_rank", F.row_number().over(by_distance))
        .filter(F.col("_rank") <= k + 1)
    )
    order = Window.partitionBy("id").orderBy("distance", "copy")
    return (
        named.join(candidates, "representative")
        .filter("copy <> id")
        .select("id", F.col("copy").alias("neighbor"), "distance", F.row_number().over(order).cast("bigint").alias("rank"))
        .filter(F.col("rank") <= k)
    )


def eps_join(points: DataFrame, eps: float, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbor, neighbor_weight, distance) for ordered pairs of different vectors within eps.

    Vectors are named by their smallest id and carry their number of copies, so copies do not multiply the pairs.
    """
    grid = build_grid(materialize(distinct_points(points)), eps, block_rows)
    left, right = grid.points.select("id", "vec", "cell"), grid.copies(grid.points).select("id", "vec", "weight", "cell")

    def close(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        a, b = _stack(l["vec"]), _stack(r["vec"])
        left_ids, right_ids = l["id"].to_numpy(), r["id"].to_numpy()
        rows, cols = np.nonzero(within(a, b, eps) & (left_ids[:, None] != right_ids[None, :]))
        return pd.DataFrame(
            {
                "id": left_ids[rows],
                "neighbor": right_ids[cols],
                "neighbor_weight": r["weight"].to_numpy()[cols],
                "distance": _in_slices(a, b, rows, cols),
            }
        )

    kind = points.schema["id"].dataType.simpleString()
    return compare_blocks(left, right, close, f"id {kind}, neighbor {kind}, neighbor_weight bigint, distance double", block_rows)


def lof(points: DataFrame, *, k: int = LOF_NEIGHBORS, block_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, lof): local outlier factor of every (id, vec) point; about 1 inside a cluster, larger for outliers."""
    weighted = materialize(distinct_points(points))
    others = nearest_distinct(weighted, k, block_rows).select(
        "id", "neighbor", F.col("neighbor_weight").alias("copies"), "distance"
    )
    # copies of the point itself are its first neighbours, at distance 0
    own = weighted.filter("weight > 1").select(
        "id", F.col("id").alias("neighbor"), (F.col("weight") - 1).alias("copies"), F.lit(0.0).alias("distance")
    )
    order = Window.partitionBy("id").orderBy("distance", "neighbor").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.sum("copies").over(order)
    edges = materialize(
        own.unionByName(others)
        .withColumn("before", taken - F.col("copies"))
        .filter(F.col("before") < k)
        .select("id", "neighbor", "distance", F.least("copies", F.lit(k) - F.col("before")).alias("share"))
    )
    reach = edges.groupBy("id").agg(F.max("distance").alias("k_distance"))
    density = (
        edges.join(reach.select(F.col("id").alias("neighbor"), "k_distance"), "neighbor")
        .groupBy("id")
        .agg(
            (
                F.lit(1.0)
                / (F.sum(F.greatest("distance", "k_distance") * F.col("share")) / F.sum("share") + DENSITY_FLOOR)
            ).alias("density")
        )
    )
    density = materialize(density)
    factor = (
        edges.join(density.select(F.col("id").alias("neighbor"), F.col("density").alias("near")), "neighbor")
        .groupBy("id")
        .agg((F.sum(F.col("near") * F.col("share")) / F.sum("share")).alias("near"))
        .join(density, "id")
        .select("id", (F.col("near") / F.col("density")).alias("lof"))
    )
    return _back_to_copies(points, weighted, factor)


def _back_to_copies(points: DataFrame, weighted: DataFrame, result: DataFrame) -> DataFrame:
    """Give every copy the result of its representative."""
    merged = weighted.select("vec", F.col("id").alias("representative"))
    named = points.join(merged, "vec").select("id", "representative")
    return named.join(result.withColumnRenamed("id", "representative"), "representative").drop("representative")


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], low)
        np.minimum.at(now, label[b], low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node of the component, for every node of the (a, b) edge table.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Minima combine in the map tasks; each round is
    materialized, and only a checksum comes back to decide whether to stop.
    """
    def minima(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.min("b").alias("m"))

    def large_star(df: DataFrame) -> DataFrame:
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = minima(both).select("a", F.least("a", "m").alias("m"))
        return both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(df: DataFrame) -> DataFrame:
        down = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        smallest = minima(down)
        hooked = down.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hooked.unionByName(smallest.withColumnRenamed("m", "b")).distinct()

    def checksum(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = edges.select("a", "b").filter("a <> b").distinct()
    seen = None
    while True:
        current = materialize(small_star(large_star(current)))
        now = checksum(current)
        if now == seen:
            break
        seen = now
    centers = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centers)


def dbscan(
    points: DataFrame,
    *,
    eps: float = DBSCAN_EPS,
    min_samples: int = DBSCAN_MIN_SAMPLES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, cluster, is_noise, is_core) of every (id, vec) point.

    A cluster is named by its smallest core point; a border point takes the smallest such name among its core
    neighbours; noise has no cluster.
    """
    weighted = materialize(distinct_points(points))
    grid = build_grid(weighted, eps, block_rows)
    left, copies = grid.points.select("id", "vec", "weight", "cell"), grid.copies(grid.points).select("id", "vec", "weight", "cell")

    def degree(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        near = within(_stack(l["vec"]), _stack(r["vec"]), eps)
        found, weights = near.any(axis=1), np.zeros(len(l), dtype=np.int64)
        weights[found] = near[found] @ r["weight"].to_numpy()
        return pd.DataFrame({"id": l["id"], "near": weights})

    id_type = points.schema["id"].dataType.simpleString()

    def total(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("id", as_index=False, sort=False)["near"].sum()

    counted = compare_blocks(left, copies, degree, f"id {id_type}, near bigint", block_rows, total)
    degrees = counted.groupBy("id").agg(F.sum("near").alias("near"))
    flagged = materialize(grid.points.join(degrees, "id").withColumn("is_core", F.col("near") >= min_samples).drop("near"))
    core = flagged.filter("is_core").drop("is_core")
    near_core = materialize(grid.copies(core).select("id", "vec", "cell"))

    def spanning(ids: np.ndarray, position: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        low = smallest_linked(len(ids), position[a], position[b])
        linked = np.flatnonzero(low != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[linked], "b": ids[low[linked]]})

    def forest(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.nonzero(within(_stack(l["vec"]), _stack(r["vec"]), eps))
        ids, position = np.unique(np.concatenate([l["id"].to_numpy(), r["id"].to_numpy()]), return_inverse=True)
        return spanning(ids, position, rows, len(l) + cols)

    def joined(found: pd.DataFrame) -> pd.DataFrame:
        ids, position = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
        return spanning(ids, position, np.arange(len(found)), len(found) + np.arange(len(found)))

    edges = compare_blocks(core.select("id", "vec", "cell"), near_core, forest, f"a {id_type}, b {id_type}", block_rows, joined)
    components = connected_components(edges)
    labelled = core.join(components.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("cluster")
    )
    labelled = materialize(labelled)

    def border(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        near = within(_stack(l["vec"]), _stack(r["vec"]), eps)
        r_names = r["cluster"].to_numpy()
        # core rows sorted by cluster name: the first close one has the smallest name
        order = np.argsort(r_names, kind="stable")
        hit = near[:, order]
        found = hit.any(axis=1)
        names = r_names[order][hit.argmax(axis=1)]
        return pd.DataFrame({"id": l["id"].to_numpy()[found], "cluster": names[found]})

    def smallest(found: pd.DataFrame) -> pd.DataFrame:
        return found.groupby("id", as_index=False, sort=False)["cluster"].min()

    outside = flagged.filter("NOT is_core").select("id", "vec", "cell")
    attached = (
        compare_blocks(
            outside, near_core.join(labelled, "id"), border, f"id {id_type}, cluster {id_type}", block_rows, smallest
        )
        .groupBy("id")
        .agg(F.min("cluster").alias("cluster"))
    )
    clusters = labelled.unionByName(attached)
    result = (
        flagged.select("id", "is_core")
        .join(clusters, "id", "left")
        .select("id", "cluster", F.col("cluster").isNull().alias("is_noise"), "is_core")
    )
    return _back_to_copies(points, weighted, result)
