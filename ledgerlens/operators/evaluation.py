"""Evaluation of scores and clusters without labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import stats as S
from ledgerlens.functions.tiers import HIGH_RISK, SUSPICIOUS_FROM
from ledgerlens.operators.metric_tree import pair_distances
from ledgerlens.operators.neighbors import BLOCK_ROWS, _stack, compare_blocks, distances

#: Rows of a block in the silhouette, fewer where their sums for each cluster would be more than BLOCK_SUMS.
SIDE_ROWS = 1 << 14
FEW_ROWS = 1 << 10
BLOCK_SUMS = 1 << 22
#: Small tables still make so many blocks, of so many rows.
LEAST_BLOCKS = 8
LEAST_ROWS = 512
TILE = 256
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
THRESHOLDS = (0.5, 0.7, 0.9)
RATE_PERCENTILES = ((90, "at_10_percent"), (95, "at_5_percent"), (99, "at_1_percent"))
RATIO_FLOOR = 1e-10
METADATA = ("wallet_address", "feature_timestamp", "feature_version", "first_tx_time", "last_tx_time")


def _long(row: DataFrame, section: str) -> DataFrame:
    """A one-row frame as (section, metric, value) rows."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns]
    return row.select(F.lit(section).alias("section"), F.explode(F.array(*cells)).alias("cell")).select("section", "cell.*")


def score_distribution(scores: DataFrame, column: str = "fraud_score") -> DataFrame:
    """(section, metric, value): statistics, percentiles, category counts, threshold counts and anomaly rates."""
    score = F.col(column)
    quantiles = S.exact_quantiles(scores, [column], [p / 100 for p in PERCENTILES])
    points = quantiles.agg(*[S.pick(quantiles, column, p / 100).alias(f"p{p}") for p in PERCENTILES])
    basics = scores.agg(
        F.count("*").alias("count"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    ).select("*", S.as_struct(points)["p50"].alias("median"))
    above = scores.agg(*[F.count_if(score > t).alias(f"above_{t}") for t in THRESHOLDS])
    ranked = S.attach(scores.select(score.alias("score")), points, "_at").select(
        "score", *[F.col(f"_at.p{p}").alias(name) for p, name in RATE_PERCENTILES]
    )
    rates = ranked.agg(
        *[(F.count_if(F.col("score") > F.col(name)) / F.count("score")).alias(name) for _, name in RATE_PERCENTILES]
    )
    categories = scores.groupBy(F.col("risk_category").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return (
        _long(basics, "basic_stats")
        .unionByName(_long(points, "percentiles"))
        .unionByName(categories.select(F.lit("risk_distribution").alias("section"), "metric", "value"))
        .unionByName(_long(above, "thresholds"))
        .unionByName(_long(rates, "anomaly_rate"))
    )


def score_histogram(scores: DataFrame, *, column: str = "fraud_score", bins: int = 50) -> DataFrame:
    return S.histogram(scores, column, bins)


def model_score_quartiles(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Box-plot statistics per model score: quartiles, extremes and whisker ends at 1.5 quartile ranges."""
    quartiles = S.exact_quantiles(scores, columns, [0.25, 0.5, 0.75])

    def at(p: float, name: str) -> Column:
        return F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)

    boxes = quartiles.groupBy("feature").agg(at(0.25, "q25"), at(0.5, "median"), at(0.75, "q75"))
    reach = (F.col("q75") - F.col("q25")) * 1.5
    value = F.col("value")
    # one row per score column, a number fixed by the call
    with_box = S.tidy(scores, columns).join(F.broadcast(boxes), "feature")
    inside = F.when((value >= F.col("q25") - reach) & (value <= F.col("q75") + reach), value)
    return with_box.groupBy("feature", "q25", "median", "q75").agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
    )


def high_risk_comparison(
    scores: DataFrame,
    features: DataFrame,
    *,
    threshold: float = SUSPICIOUS_FROM,
    columns: Sequence[str] | None = None,
    by_category: bool = False,
) -> DataFrame:
    """Per feature: mean and deviation of high-risk and normal wallets and the ratio of means.

    `by_category` compares high and critical wallets with low ones instead of splitting at the threshold.
    """
    columns = list(columns or [c for c in features.columns if c not in METADATA])
    merged = scores.select("wallet_address", "fraud_score", "risk_category").join(
        features.select("wallet_address", *columns), "wallet_address"
    )
    if by_category:
        group = F.when(F.col("risk_category").isin(*HIGH_RISK), True).when(F.col("risk_category") == "low", False)
    else:
        group = F.col("fraud_score") >= threshold
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), S.usable(F.col(c)).alias("value")) for c in columns])
    )
    long = merged.select(group.alias("high"), cells.alias("cell")).select("high", "cell.*")
    high = F.when(F.col("high"), F.col("value"))
    normal = F.when(~F.col("high"), F.col("value"))
    compared = long.groupBy("feature").agg(
        F.avg(high).alias("high_risk_mean"),
        F.avg(normal).alias("normal_mean"),
        F.stddev_samp(high).alias("high_risk_std"),
        F.stddev_samp(normal).alias("normal_std"),
    )
    ratio = F.col("high_risk_mean") / F.greatest("normal_mean", F.lit(RATIO_FLOOR))
    return compared.withColumn("ratio", ratio).orderBy(F.col("ratio").desc_nulls_last(), "feature")


def evaluation_report(scores: DataFrame, features: DataFrame, *, top: int = 10) -> DataFrame:
    """(section, metric, value): totals, distribution and the most distinguishing features."""
    totals = _long(scores.agg(F.count("*").alias("total_wallets")), "summary")
    used = len([c for c in features.columns if c not in METADATA])
    counted = _long(scores.sparkSession.range(1).select(F.lit(used).alias("features_count")), "summary")
    leading = high_risk_comparison(scores, features).limit(top)
    ratios = leading.select(
        F.lit("top_distinguishing_features").alias("section"), F.col("feature").alias("metric"), F.col("ratio").alias("value")
    )
    return totals.unionByName(counted).unionByName(score_distribution(scores)).unionByName(ratios)


def _centroids(points: DataFrame, *by: str) -> DataFrame:
    """Mean vector per group."""
    cells = points.select(*by, F.posexplode("vec").alias("pos", "value"))
    means = cells.groupBy(*by, "pos").agg(F.avg("value").alias("mean"))
    # one entry per dimension of the vector
    ordered = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(*by).agg(F.transform(ordered, lambda e: e["mean"]).alias("center"))


def _squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _pair_up(points: DataFrame) -> DataFrame:
    """All points in one cell, so that every block meets every other."""
    return points.withColumn("cell", F.lit(0))


def _blocks_in_pairs(points: DataFrame, rows: int, n: int) -> DataFrame:
    """Deal the rows by the hash of their id into blocks of about `rows`, some at least, and copy each to every pair of
    blocks it belongs to: adds block (the row's own), low and high (the pair)."""
    blocks = max(-(-n // rows), min(LEAST_BLOCKS, -(-n // LEAST_ROWS)), 1)
    dealt = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def distance_sums(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each row of `a` the summed distances to the groups of `b`, and from each row of `b` those to the groups of `a`.

    Groups are columns of 0 and 1. Squares come from matrix products of tiles that fit a processor's cache; pairs so close
    that rounding could show in a distance (beyond 1e-8 of it) are taken from differences.
    """
    from_a, from_b = np.zeros((len(a), of_b.shape[1])), np.zeros((of_a.shape[1], len(b)))
    with np.errstate(all="ignore"):
        middle = b.mean(axis=0)
        x, y = a - middle, b - middle
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        error = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (xx.max() + yy.max() + (middle * middle).sum())
        # one product gives xx - 2 xy + yy
        x = np.c_[-2 * x, xx, np.ones(len(x))]
        y = np.ascontiguousarray(np.c_[y, np.ones(len(y)), yy].T)
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                rows, cols = slice(i, i + TILE), slice(j, j + TILE)
                d = x[rows] @ y[:, cols]
                close = None if d.min() > 1e8 * error else np.nonzero(~(d > 1e8 * error))
                np.sqrt(d, out=d)
                if close is not None:
                    d[close] = pair_distances(a[i + close[0]], b[j + close[1]])
                from_a[rows] += d @ of_b[cols]
                from_b[:, cols] += of_a[rows].T @ d
    return from_a, from_b.T


def silhouette(points: DataFrame, *, block_rows: int = SIDE_ROWS) -> DataFrame:
    """One row (silhouette_score): mean Euclidean silhouette of (id, vec, cluster) points.

    The measure is defined by all distances. Each pair of blocks of about `block_rows` points meets once, for the sums of
    both, and only sums per point and cluster come back. With many clusters blocks are smaller, as are then the sums.
    """
    side = points.select("id", "vec", "cluster")
    found = side.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k")).first()
    block_rows = min(block_rows, max(FEW_ROWS, BLOCK_SUMS // max(1, found.k)))
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("id", "cluster")}
    schema = f"id {kinds['id']}, own {kinds['cluster']}, other {kinds['cluster']}, total double, n bigint"

    def sums(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(both["cluster"])
        names = np.asarray(names)
        member = np.zeros((len(both), len(names)))
        member[np.arange(len(both)), codes] = 1.0
        x, first = _stack(both["vec"]), both["block"].to_numpy() == key[0]
        if key[0] == key[1]:
            parts = [(np.arange(len(both)), distance_sums(x, x, member, member)[0], member.sum(axis=0))]
        elif first.all() or not first.any():
            return pd.DataFrame()
        else:
            low, high = np.flatnonzero(first), np.flatnonzero(~first)
            from_low, from_high = distance_sums(x[low], x[high], member[low], member[high])
            parts = [(low, from_low, member[high].sum(axis=0)), (high, from_high, member[low].sum(axis=0))]
        out = []
        for rows, total, n in parts:
            met = np.flatnonzero(n)
            out.append(
                pd.DataFrame(
                    {
                        "id": np.repeat(both["id"].to_numpy()[rows], len(met)),
                        "own": np.repeat(both["cluster"].to_numpy()[rows], len(met)),
                        "other": np.tile(names[met], len(rows)),
                        "total": total[:, met].ravel(),
                        "n": np.tile(n[met].astype(int), len(rows)),
                    }
                )
            )
        return pd.concat(out)

    per_cluster = (
        _blocks_in_pairs(side, block_rows, found.n)
        .groupBy("low", "high")
        .applyInPandas(sums, schema)
        .groupBy("id", "own", "other")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    own = F.col("own") == F.col("other")
    per_point = per_cluster.groupBy("id").agg(
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
        F.max(F.when(own, F.col("n"))).alias("own_n"),
    )
    value = F.when(F.col("own_n") > 1, F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return per_point.agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("silhouette_score"))


def cluster_quality(points: DataFrame, *, block_rows: int = SIDE_ROWS) -> DataFrame:
    """One row: clusters, noise, silhouette, Calinski-Harabasz and Davies-Bouldin of (id, vec, cluster) points.

    Points without a cluster are noise and only counted. The three measures are NULL for fewer than two clusters.
    """
    kept = points.filter("cluster IS NOT NULL")
    counts = points.agg(
        F.count_distinct("cluster").alias("n_clusters"),
        F.count_if(F.col("cluster").isNull()).alias("n_noise"),
        F.try_divide(F.count_if(F.col("cluster").isNull()), F.count("*")).alias("noise_ratio"),
    )
    centers = _centroids(kept, "cluster")
    spread = (
        kept.join(centers, "cluster")
        .withColumn("d2", _squared_distance("vec", "center"))
        .groupBy("cluster")
        .agg(F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("scatter"), F.sum("d2").alias("within"))
        .join(centers, "cluster")
    )
    middle = _centroids(kept).agg(F.first("center").alias("middle"))
    separated = spread.withColumn("middle", S.as_struct(middle)["middle"]).withColumn(
        "between", F.col("n") * _squared_distance("center", "middle")
    )
    totals = separated.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("within").alias("w"), F.sum("between").alias("b")
    )

    def worst(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        gap = distances(_stack(l["vec"]), _stack(r["vec"]))
        total = l["scatter"].to_numpy()[:, None] + r["scatter"].to_numpy()[None, :]
        same = l["id"].to_numpy()[:, None] == r["id"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(same | (gap == 0), 0.0, total / gap)
        return pd.DataFrame({"id": l["id"], "ratio": ratio.max(axis=1)})

    side = _pair_up(spread.select(F.col("cluster").alias("id"), F.col("center").alias("vec"), "scatter"))
    kind = points.schema["cluster"].dataType.simpleString()
    similarity = (
        compare_blocks(side, side, worst, f"id {kind}, ratio double", min(block_rows, BLOCK_ROWS))
        .groupBy("id")
        .agg(F.max("ratio").alias("ratio"))
        .agg(F.avg("ratio").alias("davies_bouldin"))
    )
    t, c, s, q = (S.as_struct(f) for f in (totals, counts, silhouette(kept, block_rows=block_rows), similarity))
    row = points.sparkSession.range(1).select(c.alias("c"), t.alias("t"), s.alias("s"), q.alias("q"))
    several = F.col("c.n_clusters") > 1
    variance_ratio = F.try_divide(F.col("t.b") * (F.col("t.n") - F.col("t.k")), F.col("t.w") * (F.col("t.k") - 1))
    return row.select(
        "c.n_clusters",
        "c.n_noise",
        "c.noise_ratio",
        F.when(several, F.col("s.silhouette_score")).alias("silhouette_score"),
        F.when(several, variance_ratio).alias("calinski_harabasz_score"),
        F.when(several, F.col("q.davies_bouldin")).alias("davies_bouldin_score"),
    )
