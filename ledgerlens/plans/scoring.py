"""The scoring job: features, models, scores, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import evaluation, features, scoring
from ledgerlens.operators.preparation import train_test_split
from ledgerlens.plans.daily import Paths
from ledgerlens.session import materialize
from ledgerlens.sources.tables import save_table

MODES = ("full", "features", "train", "score")


def run_scoring(
    spark: SparkSession,
    staged: DataFrame | None,
    paths: Paths,
    *,
    mode: str = "full",
    model_type: str = "ensemble",
    now: Column | None = None,
    **model_options,
) -> DataFrame:
    """Run one mode and return its result table.

    features: compute and store features. train: fit on stored features and store the models. score: reload the models
    and score stored features. full: all of it plus the evaluation report, which is returned.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    moment = F.current_timestamp() if now is None else now
    feature_path, model_path = paths.table("wallet_features"), paths.table("models")
    score_path, metadata_path = paths.table("wallet_fraud_scores"), paths.table("model_metadata")

    if mode in ("full", "features"):
        save_table(features.all_features(staged, feature_timestamp=moment), feature_path)
    stored = spark.read.parquet(feature_path)
    if mode == "features":
        return stored

    if mode in ("full", "train"):
        models = scoring.fit_models(stored, model_type=model_type)
        models.save(model_path)
        metrics = None
        if models.forest is not None:
            _, test = train_test_split(scoring.prepared_rows(stored, models))
            metrics = materialize(scoring.model_eval_if(test, models.forest))
        metadata = scoring.training_metadata(
            stored, models, metrics, model_type=model_type, started_at=moment, ended_at=moment
        )
        save_table(metadata, metadata_path, append=True)
        if mode == "train":
            return spark.read.parquet(metadata_path)

    models = scoring.Models.load(spark, model_path)
    save_table(scoring.score_wallets(stored, models, scored_at=moment, **model_options), score_path)
    scores = spark.read.parquet(score_path)
    if mode == "score":
        return scores
    return evaluation.evaluation_report(scores, stored)
