"""Exact nearest neighbours over a tree of balls whose leaves have a bounded number of points.

A node with more than `leaf_rows` points is split around points sampled from it, as often as needed, so the tree is as
deep as the data asks for and no number of cells is fixed. Centres, radii and sizes are tables; nothing of them passes
through the driver. Leaves travel in bundles, subtrees of a bounded size, so that a point is sent once for many leaves. Every
bundle is first searched in itself. The k-distances found there, and the triangle inequality, tell on the way down the tree
which other leaves can matter. Their bundles are visited nearest first in waves, and in a task their leaves; each visit
shrinks the k-distances, and what they no longer reach is not visited.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize, write_and_read

LEAF_ROWS = 2048
FANOUT = 32
SPLIT_ROWS = 1 << 15
#: Bytes of vectors in a bundle, up to twice as many; small tables still make about so many bundles.
BUNDLE_BYTES = 1 << 24
LEAST_BUNDLES = 8
WAVES = (4, 16, 64)
TILE = 512
SLACK = 1e-9


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows with the same number, from differences."""
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def squared_estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All squared distances by one matrix product, and for each row of `a` how far they may be off."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (aa + bb.max(initial=0.0) + (middle * middle).sum())
    return aa[:, None] + bb[None, :] - 2 * (a @ b.T), error


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Whether rows are no farther apart than `radius`: from matrix products of tiles that fit a processor's cache; pairs
    too close to call from differences. Most tiles hold far pairs only, which their smallest square tells."""
    close = np.zeros((len(a), len(b)), dtype=bool)
    if not close.size:
        return close
    limit = radius * radius
    with np.errstate(all="ignore"):
        middle = b.mean(axis=0)
        x, y = a - middle, b - middle
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        error = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (xx + yy.max() + (middle * middle).sum())
        slack = 2 * error + SLACK * limit
        # one product gives xx - 2 xy + yy
        x = np.c_[-2 * x, xx, np.ones(len(x))]
        y = np.ascontiguousarray(np.c_[y, np.ones(len(y)), yy].T)
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                rows, cols = slice(i, i + TILE), slice(j, j + TILE)
                near = x[rows] @ y[:, cols]
                if near.min() > limit + slack[rows].max():
                    continue
                sure = np.isfinite(near) & (np.abs(near - limit) > slack[rows, None])
                close[rows, cols] = sure & (near <= limit)
                row, col = np.nonzero(~sure)
                # in slices, as all may be too close to call
                for k in range(0, len(row), 100_000):
                    r, c = i + row[k : k + 100_000], j + col[k : k + 100_000]
                    close[r, c] = pair_distances(a[r], b[c]) <= radius
    return close


def fresh(df: DataFrame) -> DataFrame:
    """The same rows with columns of their own identity, so that a frame can be grouped with one it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def distance(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


@dataclass(frozen=True)
class Tree:
    """points: id, vec, weight, leaf. nodes: node, parent, center, radius, points_in (all nodes but the root)."""

    points: DataFrame
    nodes: DataFrame | None
    leaf_rows: int
    fanout: int = FANOUT


def build_tree(points: DataFrame, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> Tree:
    """Split (id, vec, weight) points with distinct vectors until no leaf has more than `leaf_rows`."""
    rows = points.select("id", "vec", "weight", F.lit(0).cast("long").alias("node"))
    kind = points.schema["id"].dataType.simpleString()
    leaves, nodes = None, None
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("points_in"))
        big = materialize(sizes.filter(F.col("points_in") > leaf_rows))
        if big.isEmpty():
            leaves = rows if leaves is None else leaves.unionByName(rows)
            return Tree(leaves.withColumnRenamed("node", "leaf"), nodes, leaf_rows, fanout)
        small = rows.join(big, "node", "left_anti")
        if nodes is not None:
            leaves = small if leaves is None else leaves.unionByName(small)
        # children about half full, at most `fanout` of them
        wide = F.least(F.greatest(F.ceil(2 * F.col("points_in") / leaf_rows), F.lit(2)), F.lit(fanout))
        parts = F.ceil(F.col("points_in") / SPLIT_ROWS).cast("int")
        big = big.select("node", parts.alias("parts"), wide.alias("wide"))
        inside = rows.join(big, "node").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        # the points of each node that a hash puts first
        order = Window.partitionBy("node").orderBy(F.xxhash64("id", "node"), "id")
        pivots = materialize(
            inside.select("node", "vec", "parts", "wide", "id")
            .withColumn("child", F.row_number().over(order))
            .filter((F.col("child") <= fanout) & (F.col("child") <= F.col("wide")))
            .drop("id", "wide")
        )
        sent = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame()
            right = right.sort_values("child")
            x, centers = stack(left["vec"]), stack(right["vec"])
            near = np.concatenate([squared_estimates(x[i : i + 4096], centers)[0].argmin(axis=1) for i in range(0, len(x), 4096)])
            child = left["node"].to_numpy() * fanout + right["child"].to_numpy()[near]
            return left[["id", "vec", "weight"]].assign(node=child, to_center=pair_distances(x, centers[near]))

        schema = f"id {kind}, vec array<double>, weight bigint, node bigint, to_center double"
        grouped = inside.select("id", "vec", "weight", "node", "part").groupBy("node", "part")
        split = write_and_read(grouped.cogroup(fresh(sent.select("node", "part", "child", "vec")).groupBy("node", "part")).applyInPandas(nearest, schema), "tree")
        level = split.groupBy("node").agg(F.max("to_center").alias("radius"), F.count("*").alias("points_in"))
        centers = pivots.select((F.col("node") * fanout + F.col("child")).alias("node"), F.col("node").alias("parent"), F.col("vec").alias("center"))
        level = materialize(centers.join(level, "node"))
        nodes = level if nodes is None else nodes.unionByName(level)
        rows = split.drop("to_center")


def first_of_each(row: np.ndarray, place: np.ndarray, exact: np.ndarray, k: int) -> np.ndarray:
    """Which candidates are the k nearest of their row, in the order of rows; ties go to the smaller place."""
    order = np.lexsort((place, exact, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row, "left") < k]


def candidates(a: np.ndarray, b: np.ndarray, same: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of pairs no farther than the row's `reach`, all that can be among its k nearest."""
    near, error = squared_estimates(a, b)
    near[same] = np.inf
    limit = reach * reach * (1 + SLACK)
    close = near <= (limit + 2 * error)[:, None]
    if b.shape[0] > k and np.count_nonzero(close) > 4 * k * len(a):
        limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
        close = near <= (limit + 2 * error)[:, None]
    row, col = np.nonzero(close)
    exact = pair_distances(a[row], b[col])
    fits = np.isfinite(near[row, col]) & (exact <= reach[row] * (1 + SLACK))
    return row[fits], col[fits], exact[fits]


def by_leaf(leaves: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(leaves, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1)


def nearest_of(left: pd.DataFrame, right: pd.DataFrame, k: int) -> tuple[pd.DataFrame, int]:
    """Of each left row the k nearest right rows with another id that are no farther than its `reach`; ties by id. Also the
    number of pairs that were compared: each leaf visits the others nearest first, with the points that reach them."""
    a, b = stack(left["vec"]), stack(right["vec"])
    a_ids, b_ids, weight = left["id"].to_numpy(), right["id"].to_numpy(), right["weight"].to_numpy()
    _, code = np.unique(np.concatenate([a_ids, b_ids]), return_inverse=True)
    code, place = code[: len(a)], code[len(a) :]
    code[a_ids != a_ids] = -1
    others = by_leaf(right["leaf"].to_numpy())
    centers = np.stack([b[o].mean(axis=0) for o in others])
    radii = np.array([pair_distances(b[o], c).max() for o, c in zip(others, centers)])
    reach, compared, out = left["reach"].to_numpy(float).copy(), 0, []
    for mine in by_leaf(left["leaf"].to_numpy()):
        middle = a[mine].mean(axis=0)
        row, col, exact = np.empty(0, int), np.empty(0, int), np.empty(0)
        for at in np.argsort(pair_distances(centers, middle) - radii, kind="stable"):
            far = reach[mine] * (1 + SLACK) + SLACK
            # what rounding may add to a distance from a centre, or an odd value makes of it, is let through
            met = np.flatnonzero(~(pair_distances(a[mine], centers[at]) - radii[at] > far))
            if not len(met):
                continue
            other = others[at]
            compared += len(met) * len(other)
            rows = mine[met]
            r, c, d = candidates(a[rows], b[other], code[rows][:, None] == place[other][None, :], reach[rows], k)
            if len(r):
                row, col, exact = np.r_[row, met[r]], np.r_[col, other[c]], np.r_[exact, d]
                keep = first_of_each(row, place[col], exact, k)
                row, col, exact = row[keep], col[keep], exact[keep]
                # the last of k that were found is the new reach
                full = np.flatnonzero(np.r_[row[k - 1 :], np.full(min(k - 1, len(row)), -1)][: len(row)] == row)
                reach[mine[row[full]]] = np.minimum(reach[mine[row[full]]], exact[full + k - 1])
        out.append((mine[row], col, exact))
    row, col, exact = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"id": a_ids[row], "neighbor": b_ids[col], "neighbor_weight": weight[col], "distance": exact}), compared


@dataclass(frozen=True)
class Search:
    """neighbors: id, neighbor, neighbor_weight, distance. compared: pairs of points that met in some task."""

    neighbors: DataFrame
    compared: int


def bundles(tree: Tree, tips: DataFrame, rows: int) -> DataFrame:
    """(leaf, bundle): a bundle is one of the largest subtrees of at most `rows` points, or some siblings of that kind."""
    sizes = tree.nodes.select("node", "parent", "points_in")
    ways, up = [F.col("node")], F.col("node")
    for _ in range(math.ceil(62 / math.log2(tree.fanout))):
        # 0 is the root, the children of x are fanout * x + 1 and on
        up = F.call_function("div", F.greatest(up - 1, F.lit(0)), F.lit(tree.fanout)).cast("long")
        ways.append(up)
    above = tips.select(F.col("node").alias("leaf"), F.explode(F.array_distinct(F.array(*ways))).alias("node"))
    fitting = above.join(sizes, "node").filter((F.col("points_in") <= rows) | (F.col("node") == F.col("leaf")))
    # an ancestor's number is smaller
    tops = fitting.groupBy("leaf").agg(F.min(F.struct("node", "parent", "points_in")).alias("top")).select("leaf", "top.*")
    order = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("points_in").over(order), F.lit(0))
    dealt = tops.select("node", "parent", "points_in").distinct().withColumn("part", F.floor(before / F.lit(rows)))
    dealt = dealt.withColumn("bundle", F.min("node").over(Window.partitionBy("parent", "part")))
    return tops.select("leaf", "node").join(dealt.select("node", "bundle"), "node").select("leaf", "bundle")


def search_tree(tree: Tree, k: int, waves: tuple[int, ...] = WAVES, bundle_bytes: int = BUNDLE_BYTES) -> Search:
    """The k nearest other points of every point; ties go to the smaller id.

    `waves` are the numbers of bundles visited by each bundle in the first rounds; later rounds visit as many as the last.
    """
    points = tree.points
    kind = points.schema["id"].dataType.simpleString()
    schema = f"id {kind}, neighbor {kind}, neighbor_weight bigint, distance double"
    # only a measure of the work: a task that runs again counts again
    compared = points.sparkSession.sparkContext.accumulator(0)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        found, pairs = nearest_of(left, right, k)
        compared.add(pairs)
        return found

    def in_itself(bundle: pd.DataFrame) -> pd.DataFrame:
        return compare(bundle.assign(reach=np.inf), bundle)

    def best(found: DataFrame) -> DataFrame:
        """(id, near): the k nearest of all that was found, from bounded lists."""
        one = F.struct("distance", "neighbor", "neighbor_weight")
        return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("near"))

    def rows_of(state: DataFrame) -> DataFrame:
        return state.select("id", F.explode("near").alias("n")).select("id", "n.neighbor", "n.neighbor_weight", "n.distance")

    if tree.nodes is None:
        found = materialize(points.select("id", "vec", "weight", "leaf").groupBy("leaf").applyInPandas(in_itself, schema))
        return Search(found, compared.value)
    nodes = tree.nodes
    inner = nodes.select(F.col("parent").alias("node")).distinct()
    tips = materialize(nodes.join(inner, "node", "left_anti"))
    # a leaf with too few points to know k others: its parent has more than that many
    about = nodes.select(F.col("node").alias("parent"), (2 * F.col("radius")).alias("around"))
    tips = materialize(tips.join(about, "parent", "left").withColumn("around", F.coalesce("around", F.lit(float("inf")))))
    size = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    rows = max(tree.leaf_rows, min(bundle_bytes // (8 * max(1, size.dims or 1)), -(-size.n // LEAST_BUNDLES)))
    bundle_of = materialize(bundles(tree, tips, rows))
    points = write_and_read(points.join(bundle_of, "leaf").select("id", "vec", "weight", "leaf", "bundle"), "bundles")
    state = write_and_read(best(points.groupBy("bundle").applyInPandas(in_itself, schema)), "nearest")

    def reach(near: DataFrame) -> DataFrame:
        """id, vec, leaf, bundle and the distance within which k others are known to be."""
        known = points.join(near, "id", "left").join(tips.select(F.col("node").alias("leaf"), "around"), "leaf")
        far = F.when(F.size("near") >= k, F.col("near")[k - 1]["distance"]).otherwise(F.col("around"))
        return known.select("id", "vec", "leaf", "bundle", F.coalesce(far, F.col("around")).alias("reach"))

    def leaf_reach(reached: DataFrame) -> DataFrame:
        return reached.groupBy("leaf").agg(F.max("reach").alias("reach"))

    reached = write_and_read(reach(state), "reach")
    mine = tips.select(F.col("node").alias("leaf"), F.col("center").alias("own_center"), F.col("radius").alias("own_radius"))
    walk = mine.join(leaf_reach(reached), "leaf").withColumn("node", F.lit(0).cast("long"))
    pairs = None
    while not walk.isEmpty():
        step = walk.withColumnRenamed("node", "parent").join(nodes.join(inner.withColumn("inner", F.lit(True)), "node", "left"), "parent")
        gap = distance("own_center", "center") - F.col("own_radius") - F.col("radius")
        step = materialize(step.withColumn("gap", gap).filter(F.col("gap") <= F.col("reach") * (1 + SLACK) + SLACK))
        ends = step.filter("inner IS NULL AND node <> leaf").select("leaf", F.col("node").alias("other"), "gap")
        pairs = ends if pairs is None else pairs.unionByName(ends)
        walk = step.filter("inner").select("leaf", "own_center", "own_radius", "reach", "node")
    pairs = pairs.join(bundle_of, "leaf").join(bundle_of.select(F.col("leaf").alias("other"), F.col("bundle").alias("visited")), "other")
    pairs = pairs.filter("bundle <> visited")
    order = Window.partitionBy("bundle").orderBy("gap", "visited")
    turns = pairs.groupBy("bundle", "visited").agg(F.min("gap").alias("gap")).withColumn("turn", F.row_number().over(order)).drop("gap")
    pairs = write_and_read(pairs.join(turns, ["bundle", "visited"]), "leaf-pairs")
    done = 0
    for wave in _sizes(waves):
        todo = materialize(
            pairs.filter((F.col("turn") > done) & (F.col("turn") <= done + wave))
            .join(leaf_reach(reached), "leaf")
            .filter(F.col("gap") <= F.col("reach") * (1 + SLACK) + SLACK)
            .select("bundle", "visited", "leaf", "other")
        )
        if not todo.isEmpty():
            left = reached.join(todo.select("leaf", "visited").distinct(), "leaf").select("bundle", "visited", "id", "vec", "leaf", "reach")
            guests = points.withColumnsRenamed({"leaf": "other", "bundle": "visited"})
            right = guests.join(todo.select("bundle", "other").distinct(), "other")
            right = right.select("bundle", "visited", "id", "vec", "weight", F.col("other").alias("leaf"))
            more = left.groupBy("bundle", "visited").cogroup(fresh(right).groupBy("bundle", "visited")).applyInPandas(compare, schema)
            state = write_and_read(best(rows_of(state).unionByName(more)), "nearest")
            reached = write_and_read(reach(state), "reach")
        done += wave
        if pairs.filter(F.col("turn") > done).join(leaf_reach(reached), "leaf").filter(F.col("gap") <= F.col("reach") * (1 + SLACK) + SLACK).isEmpty():
            return Search(rows_of(state), compared.value)


def _sizes(waves: tuple[int, ...]):
    yield from waves
    while True:
        yield waves[-1]
