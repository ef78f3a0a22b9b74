"""From features to wallet scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import as_struct, attach, quantile_row
from ledgerlens.functions.tiers import risk_category as risk_of
from ledgerlens.operators import forest as IF
from ledgerlens.operators import neighbors as N
from ledgerlens.operators.features import FEATURE_COLUMNS
from ledgerlens.operators.preparation import SEED, TEST_SHARE, prepare_features, train_test_split
from ledgerlens.session import materialize

# Model weights.
ENSEMBLE_WEIGHTS = {"isolation_forest_score": 0.5, "lof_score": 0.3, "dbscan_is_noise": 0.2}
NOTEBOOK_WEIGHTS = {"isolation_forest_score": 0.4, "lof_score": 0.35, "dbscan_is_noise": 0.25}
MODELS = ("isolation_forest", "lof", "dbscan")
MODEL_VERSION = "1.0.0"


def min_max(df: DataFrame, column: str, output: str, *, invert: bool = False) -> DataFrame:
    """Rescale to 0-1 (1 for the smallest value when inverted); a constant column becomes 0."""
    limits = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    low, high = F.col("_limits.low"), F.col("_limits.high")
    distance = high - F.col(column) if invert else F.col(column) - low
    share = F.coalesce(F.try_divide(distance, high - low), F.lit(0.0))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return attach(df, limits, "_limits").withColumn(output, clipped).drop("_limits")


def ensemble_score(df: DataFrame, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS) -> DataFrame:
    """Weighted mean of the model columns present, weights rescaled to sum to 1; 0 when there are none."""
    present = {c: w for c, w in weights.items() if c in df.columns}
    total = sum(present.values())
    score = F.lit(0.0)
    for c, w in present.items():
        score = score + F.col(c) * (w / total)
    return df.withColumn("fraud_score", score)


def risk_category(df: DataFrame, column: str = "fraud_score") -> DataFrame:
    return df.withColumn("risk_category", risk_of(F.col(column)))


@dataclass(frozen=True)
class Models:
    """What scoring needs again: scaling parameters (one row) and the forest, if one was fitted."""

    columns: tuple[str, ...]
    scaling: DataFrame
    forest: IF.Forest | None
    kinds: tuple[str, ...]

    def save(self, path: str) -> None:
        self.scaling.select("*", F.array(*[F.lit(k) for k in self.kinds]).alias("_kinds")).write.mode(
            "overwrite"
        ).parquet(f"{path}/scaling")
        if self.forest is not None:
            self.forest.save(f"{path}/forest")

    @staticmethod
    def load(spark, path: str) -> Models:
        stored = spark.read.parquet(f"{path}/scaling")
        kinds = tuple(stored.first()["_kinds"])
        columns = tuple(c.removesuffix("_center") for c in stored.columns if c.endswith("_center"))
        forest = IF.Forest.load(spark, f"{path}/forest") if "isolation_forest" in kinds else None
        return Models(columns, stored.drop("_kinds"), forest, kinds)


def _kinds(model_type: str) -> tuple[str, ...]:
    if model_type == "ensemble":
        return MODELS
    if model_type not in MODELS:
        raise ValueError(f"unknown model type: {model_type}")
    return (model_type,)


def fit_models(
    features: DataFrame,
    *,
    model_type: str = "ensemble",
    key: str = "wallet_address",
    trees: int = IF.TREES,
    contamination: float = IF.CONTAMINATION,
    seed: int = SEED,
    test_share: float = TEST_SHARE,
) -> Models:
    """Scaling from all rows, forest from the training rows; the two neighbour models have nothing to keep."""
    kinds = _kinds(model_type)
    prepared, scaling = prepare_features(features, FEATURE_COLUMNS, key=key)
    scaling = materialize(scaling)
    columns = tuple(c for c in prepared.columns if c != key)
    forest = None
    if "isolation_forest" in kinds:
        train, _ = train_test_split(materialize(prepared), key=key, test_share=test_share, seed=seed)
        forest = IF.isolation_forest_fit(
            train, columns, key=key, trees=trees, contamination=contamination, seed=seed
        )
    return Models(columns, scaling, forest, kinds)


def prepared_rows(features: DataFrame, models: Models, key: str = "wallet_address") -> DataFrame:
    prepared, _ = prepare_features(features, models.columns, key=key, parameters=models.scaling)
    return materialize(prepared)


def score_wallets(
    features: DataFrame,
    models: Models,
    *,
    key: str = "wallet_address",
    weights: Mapping[str, float] = ENSEMBLE_WEIGHTS,
    k: int = N.LOF_NEIGHBORS,
    eps: float = N.DBSCAN_EPS,
    min_samples: int = N.DBSCAN_MIN_SAMPLES,
    scored_at: Column | None = None,
) -> DataFrame:
    """Scores of all models, their weighted mean, risk category, time and version per wallet.

    A high local outlier factor gives a high score.
    """
    prepared = prepared_rows(features, models, key)
    scores = prepared.select(key)
    if models.forest is not None:
        raw = materialize(IF.isolation_forest_score(prepared, models.forest, key=key))
        scaled = min_max(raw, "decision", "isolation_forest_score", invert=True)
        scores = scores.join(
            scaled.select(key, "isolation_forest_score", F.col("prediction").alias("isolation_forest_prediction")), key
        )
    points = N.as_points(prepared, key, models.columns)
    if "lof" in models.kinds:
        factors = min_max(materialize(N.lof(points, k=k)), "lof", "lof_score")
        scores = scores.join(factors.select(F.col("id").alias(key), "lof_score"), key)
    if "dbscan" in models.kinds:
        clusters = N.dbscan(points, eps=eps, min_samples=min_samples)
        scores = scores.join(
            clusters.select(
                F.col("id").alias(key),
                F.col("cluster").alias("dbscan_cluster"),
                F.col("is_noise").cast("int").alias("dbscan_is_noise"),
            ),
            key,
        )
    stamp = F.current_timestamp() if scored_at is None else scored_at
    return risk_category(ensemble_score(scores, weights)).select(
        "*", stamp.alias("scored_at"), F.lit(MODEL_VERSION).alias("model_version")
    )


def model_eval_if(test: DataFrame, forest: IF.Forest, *, key: str = "wallet_address") -> DataFrame:
    """One row: test rows, anomalies found and their share."""
    flagged = IF.isolation_forest_score(test, forest, key=key)
    anomalies = F.count_if(F.col("prediction") == -1)
    return flagged.agg(
        F.count("*").alias("test_samples"),
        anomalies.alias("anomalies_detected"),
        F.try_divide(anomalies, F.count("*")).alias("anomaly_ratio"),
    )


def flag_top_share(df: DataFrame, column: str, output: str, share: float = IF.CONTAMINATION) -> DataFrame:
    """1 for rows above the (1 - share) quantile of a score."""
    cut = as_struct(quantile_row(df, [column], {"cut": 1.0 - share}))[f"{column}_cut"]
    return df.withColumn(output, (F.col(column) > cut).cast("int"))


def model_anomaly_counts(scores: DataFrame) -> DataFrame:
    """(model, anomalies, share) for the flag columns present."""
    flags = {
        "isolation_forest": ("isolation_forest_prediction", F.col("isolation_forest_prediction") == -1),
        "lof": ("lof_is_outlier", F.col("lof_is_outlier") == 1),
        "dbscan": ("dbscan_is_noise", F.col("dbscan_is_noise") == 1),
    }
    present = {m: condition for m, (column, condition) in flags.items() if column in scores.columns}
    counted = scores.agg(F.count("*").alias("_rows"), *[F.count_if(c).alias(m) for m, c in present.items()])
    long = counted.unpivot("_rows", list(present), "model", "anomalies")
    return long.select("model", "anomalies", F.try_divide("anomalies", "_rows").alias("share"))


def training_metadata(
    features: DataFrame,
    models: Models,
    metrics: DataFrame | None = None,
    *,
    model_type: str = "ensemble",
    started_at: Column | None = None,
    ended_at: Column | None = None,
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    contamination: float = IF.CONTAMINATION,
) -> DataFrame:
    """One row about a training run, with the evaluation row's columns beside it when given."""
    row = features.agg(F.count("*").alias("training_samples")).select(
        F.lit(model_type).alias("model_type"),
        "training_samples",
        F.lit(len(models.columns)).alias("feature_count"),
        F.array(*[F.lit(c) for c in models.columns]).alias("features_used"),
        (F.current_timestamp() if started_at is None else started_at).alias("training_start"),
        (F.current_timestamp() if ended_at is None else ended_at).alias("training_end"),
        F.lit(seed).alias("random_seed"),
        F.lit(test_share).alias("test_size"),
        F.lit(contamination).alias("contamination"),
    )
    if metrics is None:
        return row
    return attach(row, metrics, "_m").select(*row.columns, *[F.col(f"_m.{c}") for c in metrics.columns])
