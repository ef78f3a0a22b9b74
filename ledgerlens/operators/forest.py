"""Isolation forest: trees grown from small hash samples, scored with one broadcast node table.

A tree sees at most 256 rows by definition, so growing one is a small task per tree; sampling and scoring are
distributed. The node table has at most trees x (2 x 256 - 1) rows whatever the size of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.numbering import with_row_numbers
from ledgerlens.functions.stats import as_struct, exact_quantiles
from ledgerlens.session import materialize

# Model defaults.
TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.1
SEED = 42
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = "tree int, node int, feature int, threshold double, below int, above int, path double"


@dataclass(frozen=True)
class Forest:
    """A fitted forest: node table, decision offset (one row), feature order and sample size per tree."""

    nodes: DataFrame
    offset: DataFrame
    columns: tuple[str, ...]
    sample_rows: int

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.offset.select(
            "offset", F.array(*[F.lit(c) for c in self.columns]).alias("columns"), F.lit(self.sample_rows).alias("rows")
        ).write.mode("overwrite").parquet(f"{path}/offset")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        stored = spark.read.parquet(f"{path}/offset")
        row = stored.first()
        return Forest(spark.read.parquet(f"{path}/nodes"), stored.select("offset"), tuple(row.columns), row.rows)


def expected_path(rows: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree over `rows` rows."""
    n = np.asarray(rows, dtype=float)
    deep = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def tree_samples(
    rows: DataFrame, key: str, n: int, *, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = SEED
) -> DataFrame:
    """(tree, <row>) samples without replacement in one scan.

    Each of the `n` rows tosses one hash per tree against a rate slightly above sample/n; the surplus is cut by rank.
    """
    surplus = sample_rows + 8 * math.sqrt(sample_rows) + 16
    limit = math.ceil(min(1.0, surplus / max(n, 1)) * 2**52)

    def toss(tree):
        return F.pmod(F.xxhash64(F.col(key), F.lit(seed), tree), F.lit(2**52))

    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: toss(t) < F.lit(limit))
    drawn = rows.withColumn("tree", F.explode(chosen))
    order = Window.partitionBy("tree").orderBy(toss(F.col("tree")), key)
    return drawn.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample_rows).drop("_rank")


def grow_tree(x: np.ndarray, depth_limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, below, above, path) of one random tree; feature -1 marks a leaf."""
    nodes: list[tuple] = []
    pending = [(0, np.arange(len(x)), 0)]
    next_node = 1
    while pending:
        node, rows, depth = pending.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.nonzero(high > low)[0]
        if depth >= depth_limit or len(rows) <= 1 or not len(splittable):
            nodes.append((node, -1, 0.0, -1, -1, float(depth + expected_path(len(rows)))))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_below = part[:, feature] <= threshold
        below, above = next_node, next_node + 1
        next_node += 2
        nodes.append((node, feature, threshold, below, above, 0.0))
        pending.append((below, rows[goes_below], depth + 1))
        pending.append((above, rows[~goes_below], depth + 1))
    return nodes


def _node_arrays(nodes: pd.DataFrame) -> list[tuple[np.ndarray, ...]]:
    """Per tree: feature, threshold, below, above, path indexed by node."""
    arrays = []
    for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        arrays.append(tuple(part[c].to_numpy() for c in ("feature", "threshold", "below", "above", "path")))
    return arrays


def anomaly_scores(x: np.ndarray, trees: list[tuple[np.ndarray, ...]], sample_rows: int) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for isolated rows, at most about 0.5 for ordinary ones."""
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for feature, threshold, below, above, path in trees:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            down = x[every, np.where(inner, f, 0)] <= threshold[at]
            at = np.where(inner, np.where(down, below[at], above[at]), at)
        total += path[at]
    return np.exp2(-total / len(trees) / expected_path(sample_rows))


def isolation_forest_fit(
    train: DataFrame,
    columns: Sequence[str],
    *,
    key: str = "wallet_address",
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> Forest:
    """Fit on rows of scaled features; the decision offset leaves `contamination` of the training rows below zero."""
    columns = tuple(columns)
    n = train.count()
    size = min(sample_rows, n)
    depth_limit = max(1, math.ceil(math.log2(max(size, 2))))
    samples = tree_samples(train.select(key, *columns), key, n, trees=trees, sample_rows=size, seed=seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(key)[list(columns)].to_numpy(dtype=float)
        grown = grow_tree(x, depth_limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "below", "above", "path"])
        out.insert(0, "tree", tree)
        return out

    nodes = materialize(samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA))
    scored = _raw_scores(train, nodes, columns, size, key)
    cut = exact_quantiles(scored.select((-F.col("score")).alias("score")), ["score"], [contamination])
    offset = materialize(cut.select(F.col("quantile").alias("offset")))
    return Forest(nodes, offset, columns, size)


def _raw_scores(df: DataFrame, nodes: DataFrame, columns: Sequence[str], sample_rows: int, key: str) -> DataFrame:
    # bounded by the number of trees and the sample size, so it may be collected and broadcast
    trees = df.sparkSession.sparkContext.broadcast(_node_arrays(nodes.toPandas()))
    names = list(columns)

    def score(batches):
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            yield pd.DataFrame({key: pdf[key], "score": anomaly_scores(x, trees.value, sample_rows)})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, *names).mapInPandas(score, f"`{key}` {key_type}, score double")


def isolation_forest_score(df: DataFrame, forest: Forest, *, key: str = "wallet_address") -> DataFrame:
    """(key, decision, prediction): negative decisions are anomalies (-1), the rest normal (1)."""
    offset = as_struct(forest.offset)["offset"]
    scored = _raw_scores(df, forest.nodes, forest.columns, forest.sample_rows, key)
    decision = -F.col("score") - offset
    return scored.select(key, decision.alias("decision")).select(
        key, "decision", F.when(F.col("decision") < 0, -1).otherwise(1).alias("prediction")
    )


def random_pairs(rows: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """(key, x, other_key, other): each (key, x) row with the row that a random permutation of all rows gives it.

    Row i in one hash order meets row i in another; both orders are numbered over the whole table, whatever its size.
    """
    def ranked(salt: int, **names: str) -> DataFrame:
        order = [F.xxhash64(F.col(key), F.lit(seed + salt)), F.col(key)]
        placed = with_row_numbers(rows.select(key, "x"), order, "place")
        return placed.select("place", *[F.col(old).alias(new) for new, old in names.items()])

    return ranked(1, **{key: key, "x": "x"}).join(ranked(2, other_key=key, other="x"), "place").drop("place")


def permutation_importance(df: DataFrame, forest: Forest, *, key: str = "wallet_address", seed: int = SEED) -> DataFrame:
    """Mean absolute score change per feature when its values are exchanged between rows.

    Like the scores, each feature uses the same permutation (`random_pairs`).
    """
    names = list(forest.columns)
    rows = materialize(df.select(key, F.array(*[F.col(c).cast("double") for c in names]).alias("x")))
    paired = random_pairs(rows, key, seed).select("x", "other")
    trees = df.sparkSession.sparkContext.broadcast(_node_arrays(forest.nodes.toPandas()))
    sample_rows = forest.sample_rows

    def change(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, other = np.stack(pdf["x"]), np.stack(pdf["other"])
            base = anomaly_scores(x, trees.value, sample_rows)
            moved = []
            for i in range(len(names)):
                exchanged = x.copy()
                exchanged[:, i] = other[:, i]
                moved.append(np.abs(anomaly_scores(exchanged, trees.value, sample_rows) - base).sum())
            yield pd.DataFrame({"feature": names, "total": moved, "n": len(pdf)})

    totals = paired.mapInPandas(change, "feature string, total double, n bigint").groupBy("feature").agg(
        (F.sum("total") / F.sum("n")).alias("importance")
    )
    # one row per feature from here on
    by_importance = Window.orderBy(F.col("importance").desc(), "feature")
    return totals.select(
        "feature",
        "importance",
        F.row_number().over(by_importance).cast("bigint").alias("rank"),
        F.try_divide("importance", F.sum("importance").over(Window.partitionBy())).alias("importance_normalized"),
    )
