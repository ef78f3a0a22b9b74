"""Risk queries over wallet scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.functions import tiers as T
from ledgerlens.functions.stats import discrete_quantiles
from ledgerlens.operators.staging import wallet_edges

AsOf = Column | DataFrame | str | None
# Fixed values.
SORT_FIELDS = ("fraud_score", "tx_count", "total_value", "wallet_address")
PRESETS = {
    "all": {},
    "suspicious": {"is_suspicious": True},
    "high-risk": {"min_score": 0.7},
    "top-alerts": {"page_size": 5},
}
MODEL_REASON = "ML-detected anomalous behavior"
HEURISTIC_REASON = "Heuristic-based detection (ML model not yet run)"


def _filtered(
    scores: DataFrame,
    features: DataFrame,
    min_score: float | None,
    max_score: float | None,
    is_suspicious: bool | None,
    min_tx_count: int | None,
) -> DataFrame:
    joined = scores.select("wallet_address", "fraud_score", "risk_category", "scored_at").join(
        features.select("wallet_address", "tx_count", "total_value"), "wallet_address", "left"
    )
    score = F.col("fraud_score")
    wanted = []
    if min_score is not None:
        wanted.append(score >= min_score)
    if max_score is not None:
        wanted.append(score <= max_score)
    if is_suspicious is not None:
        wanted.append(score >= T.SUSPICIOUS_FROM if is_suspicious else score < T.SUSPICIOUS_FROM)
    if min_tx_count is not None:
        wanted.append(F.col("tx_count") >= min_tx_count)
    return joined.filter(L.all_of(wanted)) if wanted else joined


def _page(df: DataFrame, sort_by: str, descending: bool, page: int, page_size: int) -> DataFrame:
    key = sort_by if sort_by in SORT_FIELDS else SORT_FIELDS[0]
    order = F.col(key).desc() if descending else F.col(key).asc()
    return df.orderBy(order, "wallet_address").offset((page - 1) * page_size).limit(page_size)


def _check_bounds(min_score: float | None, max_score: float | None, min_tx_count: int | None, page: int, page_size: int | None) -> None:
    """Scores lie in 0..1, counts are not negative, pages start at 1 and hold 1 to 1,000 rows."""
    if any(s is not None and not 0 <= s <= 1 for s in (min_score, max_score)):
        raise ValueError("scores lie between 0 and 1")
    if min_tx_count is not None and min_tx_count < 0:
        raise ValueError("min_tx_count must not be negative")
    if page < 1 or page_size is not None and not 1 <= page_size <= 1000:
        raise ValueError("page starts at 1, page_size lies between 1 and 1000")


def risk_wallet_page(
    scores: DataFrame,
    features: DataFrame,
    *,
    preset: str = "all",
    min_score: float | None = None,
    max_score: float | None = None,
    is_suspicious: bool | None = None,
    min_tx_count: int | None = None,
    sort_by: str = "fraud_score",
    descending: bool = True,
    page: int = 1,
    page_size: int | None = None,
) -> DataFrame:
    """One page of scored wallets with activity from the feature table; what is asked for goes before the preset."""
    _check_bounds(min_score, max_score, min_tx_count, page, page_size)
    asked = {"min_score": min_score, "is_suspicious": is_suspicious, "page_size": page_size}
    given = dict.fromkeys(asked) | {"page_size": 50} | PRESETS[preset] | {k: v for k, v in asked.items() if v is not None}
    joined = _filtered(scores, features, given["min_score"], max_score, given["is_suspicious"], min_tx_count)
    suspicious = F.col("fraud_score") >= T.SUSPICIOUS_FROM
    rows = joined.select(
        "wallet_address",
        "fraud_score",
        F.coalesce("risk_category", T.risk_category(F.col("fraud_score"))).alias("risk_category"),
        F.col("scored_at").alias("last_activity"),
        suspicious.alias("is_suspicious"),
        F.coalesce("tx_count", F.lit(0)).alias("tx_count"),
        F.coalesce("total_value", F.lit(0.0)).alias("total_value"),
        F.when(suspicious, MODEL_REASON).alias("flagged_reason"),
    )
    return _page(rows, sort_by, descending, page, given["page_size"])


def risk_wallet_counts(
    scores: DataFrame,
    features: DataFrame,
    *,
    min_score: float | None = None,
    max_score: float | None = None,
    is_suspicious: bool | None = None,
    min_tx_count: int | None = None,
    page_size: int = 50,
    unfiltered: bool = False,
) -> DataFrame:
    """Total, suspicious and page counts under the page's filters (or over everything)."""
    filters = (None,) * 4 if unfiltered else (min_score, max_score, is_suspicious, min_tx_count)
    total = F.count("*")
    return _filtered(scores, features, *filters).agg(
        total.alias("total_count"),
        F.count_if(F.col("fraud_score") >= T.SUSPICIOUS_FROM).alias("suspicious_count"),
        F.ceil(total / page_size).cast("bigint").alias("page_count"),
    )


def risk_heuristic_page(
    raw_wallets: DataFrame,
    *,
    sort_by: str = "fraud_score",
    descending: bool = True,
    page: int = 1,
    page_size: int = 50,
) -> DataFrame:
    """Page scored by simple rules, for ledgers without model scores."""
    tx_count = F.col("total_transactions_in") + F.col("total_transactions_out")
    value = L.wei_to_ether(F.col("total_value_in_wei")) + L.wei_to_ether(F.col("total_value_out_wei"))
    score = F.when(value > 1000, 0.8).when(tx_count > 500, 0.6).when(value > 100, 0.4).otherwise(0.2)
    scored = raw_wallets.select(
        "wallet_address",
        tx_count.alias("tx_count"),
        value.alias("total_value"),
        F.col("last_seen_timestamp").alias("last_activity"),
        score.alias("fraud_score"),
    )
    suspicious = F.col("fraud_score") >= T.SUSPICIOUS_FROM
    rows = scored.select(
        "*",
        suspicious.alias("is_suspicious"),
        T.risk_category(F.col("fraud_score")).alias("risk_category"),
        F.when(suspicious, HEURISTIC_REASON).alias("flagged_reason"),
    )
    return _page(rows, sort_by, descending, page, page_size)


def critical_wallets(scores: DataFrame, *, threshold: float = 0.9) -> DataFrame:
    return (
        scores.filter(F.col("fraud_score") >= threshold)
        .select("wallet_address", "fraud_score", "tx_count", "total_value", "last_activity", "flagged_reason")
        .orderBy(F.col("total_value").desc(), "wallet_address")
    )


def recently_flagged(scores: DataFrame, *, days: int = 7, limit: int = 100, as_of: AsOf = None) -> DataFrame:
    now = L.point_in_time(as_of, scores, "updated_at")
    return (
        scores.filter(F.col("is_suspicious") & (F.col("updated_at") >= L.days_before(now, days)))
        .select(
            "wallet_address", "fraud_score", "is_suspicious", "tx_count", "total_value", "last_activity", "updated_at"
        )
        .orderBy(F.col("updated_at").desc(), "wallet_address")
        .limit(limit)
    )


def daily_new_suspicious(scores: DataFrame, *, days: int = 30, as_of: AsOf = None) -> DataFrame:
    today = F.to_date(L.point_in_time(as_of, scores, "updated_at"))
    return (
        scores.filter(F.col("is_suspicious") & (F.to_date("updated_at") >= F.date_sub(today, days)))
        .groupBy(F.to_date("updated_at").alias("date"))
        .agg(F.count("*").alias("new_suspicious_count"), F.avg("fraud_score").alias("avg_fraud_score"))
        .orderBy(F.col("date").desc())
    )


def score_percentiles(scores: DataFrame) -> DataFrame:
    """25th to 99th percentile: exact, values are actual scores. One row, of NULLs without scores."""
    points = {"p25": 0.25, "p50_median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = discrete_quantiles(scores, [], F.col("fraud_score"), points)
    return found.agg(*[F.max(name).alias(name) for name in points])


def suspicious_volume_tiers(scores: DataFrame) -> DataFrame:
    return (
        scores.filter("is_suspicious")
        .groupBy(T.volume_tier(F.col("total_value")).alias("volume_tier"))
        .agg(
            F.count("*").alias("wallet_count"),
            F.avg("fraud_score").alias("avg_fraud_score"),
            L.ether_sum(F.col("total_value_wei")).alias("total_volume"),
        )
        .orderBy(F.col("total_volume").desc())
    )


def connected_to_suspicious(
    fact: DataFrame, scores: DataFrame, *, threshold: float = 0.7, limit: int | None = 100
) -> DataFrame:
    """Wallets one transfer away from a suspicious wallet that are not suspicious themselves.

    Edges are reduced to those that touch a suspicious wallet before the distinct wallets are shuffled.
    """
    suspicious = scores.filter(F.col("fraud_score") >= threshold).select("wallet_address")
    pairs = wallet_edges(fact).select("wallet_address", "counterparty")
    neighbours = (
        pairs.join(suspicious.withColumnRenamed("wallet_address", "counterparty"), "counterparty", "left_semi")
        .select("wallet_address")
        .distinct()
        .join(suspicious, "wallet_address", "left_anti")
    )
    known = scores.select("wallet_address", "fraud_score", "is_suspicious", "tx_count", "total_value")
    ranked = neighbours.join(known, "wallet_address", "left").orderBy(
        F.col("fraud_score").desc_nulls_last(), "wallet_address"
    )
    return ranked if limit is None else ranked.limit(limit)


def model_version_stats(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("model_version")
        .agg(
            F.count("*").alias("predictions_count"),
            F.avg("fraud_score").alias("avg_score"),
            F.count_if("is_suspicious").alias("suspicious_count"),
            F.min("prediction_timestamp").alias("first_prediction"),
            F.max("prediction_timestamp").alias("last_prediction"),
        )
        .orderBy(F.col("last_prediction").desc(), "model_version")
    )


def scores_listing(scores: DataFrame, *, limit: int | None = None) -> DataFrame:
    wanted = ["wallet_address", "fraud_score", "risk_category", "isolation_forest_score", "scored_at", "model_version"]
    listed = scores.select(*[c for c in wanted if c in scores.columns]).orderBy(
        F.col("fraud_score").desc(), "wallet_address"
    )
    return listed if limit is None else listed.limit(limit)


def risk_category_summary(scores: DataFrame) -> DataFrame:
    return (
        scores.groupBy("risk_category")
        .agg(
            F.count("*").alias("wallet_count"),
            F.avg("fraud_score").alias("avg_fraud_score"),
            F.min("fraud_score").alias("min_fraud_score"),
            F.max("fraud_score").alias("max_fraud_score"),
        )
        .orderBy(T.severity(F.col("risk_category")))
    )


def high_risk_investigation(scores: DataFrame, features: DataFrame, *, limit: int | None = 100) -> DataFrame:
    """High-risk wallets with the features that help to judge them."""
    wanted = scores.filter(F.col("risk_category").isin(*T.HIGH_RISK)).select(
        "wallet_address", "fraud_score", "risk_category"
    )
    known = features.select(
        "wallet_address",
        "tx_count",
        "total_value",
        "unique_counterparties",
        "in_out_ratio",
        "net_flow",
        "counterparty_concentration",
        "self_transactions",
        "high_value_tx_ratio",
    )
    ranked = wanted.join(known, "wallet_address").orderBy(F.col("fraud_score").desc(), "wallet_address")
    return ranked if limit is None else ranked.limit(limit)


def high_risk_listing(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("risk_category").isin(*T.HIGH_RISK)).orderBy(
        F.col("fraud_score").desc(), "wallet_address"
    )


def score_lookup(scores: DataFrame, address: str) -> DataFrame:
    return scores.filter(F.col("wallet_address") == address.lower().strip()).select(
        "wallet_address", "fraud_score", "risk_category"
    )
