"""Dashboard, risk and wallet queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.layers import DAILY_CTES
from ledgerlens.catalog.registry import plain, register, rounded
from ledgerlens.catalog.views import Views, eth
from ledgerlens.operators import daily, dashboard, risk, wallets
from ledgerlens.session import new_path
from ledgerlens.sources.wallet_store import build_store, open_store, refresh_store, wallet_sides, wallet_transfers

WALLET = "0x" + "0" * 40
PREFIX = "0x" + "0" * 38
DAYS = 30
BAND = """CASE WHEN fraud_score >= 0.9 THEN 'critical' WHEN fraud_score >= 0.7 THEN 'high'
    WHEN fraud_score >= 0.4 THEN 'medium' ELSE 'low' END"""

# --- dashboard ---------------------------------------------------------------------------------------------------
register(
    "dash_totals",
    lambda v: dashboard.dash_totals(v.served_dashboard),
    f"""
    SELECT count(*) AS total_transactions, coalesce({eth('sum(value_wei)')}, 0) AS total_volume,
      {eth('sum(value_wei)')} / count(value_wei) AS avg_transaction_value,
      max(transaction_timestamp) AS last_transaction_time, count(DISTINCT from_address) AS unique_senders,
      count(DISTINCT to_address) AS unique_receivers FROM fact""",
)
register(
    "dash_wallet_count",
    lambda v: dashboard.dash_wallet_count(v.served_summary),
    "SELECT count(DISTINCT wallet_address) AS total_wallets FROM edges",
)
register(
    "dash_suspicious",
    lambda v: rounded(dashboard.dash_suspicious(v.scores), {"avg_fraud_score": 9}),
    """
    SELECT count(*) AS suspicious_count, round(avg(fraud_score), 9) AS avg_fraud_score
    FROM scores WHERE is_suspicious""",
)
register(
    "dash_daily_volume",
    lambda v: dashboard.dash_daily_volume(v.served_dashboard, days=DAYS, as_of=v.served_moment),
    f"""
    SELECT transaction_date AS date, count(*) AS transaction_count, {eth('sum(value_wei)')} AS total_volume,
      count(DISTINCT from_address) AS unique_senders, count(DISTINCT to_address) AS unique_receivers
    FROM fact, moment WHERE transaction_date >= as_of::DATE - {DAYS} GROUP BY transaction_date""",
)
register(
    "dash_hourly_volume",
    lambda v: dashboard.dash_hourly_volume(v.served_dashboard, as_of=v.served_moment),
    f"""
    SELECT date_trunc('hour', transaction_timestamp) AS hour, count(*) AS transaction_count,
      {eth('sum(value_wei)')} AS total_volume
    FROM fact, moment WHERE transaction_timestamp >= as_of - INTERVAL 24 HOUR GROUP BY 1""",
)
register(
    "dash_weekly_volume",
    lambda v: dashboard.dash_weekly_volume(v.served_dashboard, as_of=v.served_moment),
    f"""
    SELECT transaction_date - CAST(dayofweek(transaction_date) AS INTEGER) AS week_start,
      count(*) AS transaction_count, {eth('sum(value_wei)')} AS total_volume,
      count(DISTINCT from_address) + count(DISTINCT to_address) AS active_wallets
    FROM fact, moment WHERE transaction_date >= as_of::DATE - 84 GROUP BY 1""",
)
register(
    "risk_distribution",
    lambda v: dashboard.risk_distribution(v.scores),
    f"""
    SELECT {BAND} AS risk_category, count(*) AS wallet_count,
      CAST(round(CAST(count(*) * 100.0 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS DOUBLE) AS percentage
    FROM scores GROUP BY 1""",
)
register(
    "top_suspicious_by_volume",
    lambda v: dashboard.top_suspicious_by_volume(v.scores),
    """
    SELECT wallet_address, fraud_score, tx_count, total_value, last_activity FROM scores WHERE is_suspicious
    ORDER BY total_value DESC, wallet_address LIMIT 10""",
)
register(
    "dashboard_summary",
    lambda v: dashboard.dashboard_summary(v.served_dashboard, v.scores),
    f"""
    SELECT count(*) AS total_transactions, coalesce({eth('sum(value_wei)')}, 0) AS total_volume,
      (SELECT count(DISTINCT wallet_address) FROM edges) AS total_wallets,
      (SELECT count(*) FILTER (WHERE fraud_score >= 0.7) FROM scores) AS suspicious_wallet_count,
      max(transaction_timestamp) AS last_updated FROM fact""",
)
register(
    "suspicious_fallback",
    lambda v: dashboard.suspicious_fallback(v.served_dashboard),
    "SELECT count(DISTINCT from_address) AS suspicious_count FROM fact WHERE value_eth > 100",
)
register(
    "metric_with_change",
    lambda v: rounded(dashboard.metric_with_change(daily.agg_daily_metrics(v.stored_fact)), {"change_percentage": 3}),
    """
    SELECT metric_date, metric_name, current_value, previous_value,
      round((current_value - previous_value) / nullif(previous_value, 0) * 100, 3) AS change_percentage
    FROM (SELECT *, lag(current_value) OVER (PARTITION BY metric_name ORDER BY metric_date) AS previous_value FROM (
      SELECT metric_date, 'total_transactions' AS metric_name, CAST(total_transactions AS DOUBLE) AS current_value
      FROM daily UNION ALL SELECT metric_date, 'total_value_eth', total_value_eth FROM daily
      UNION ALL SELECT metric_date, 'unique_wallets', CAST(unique_wallets AS DOUBLE) FROM daily))""",
    DAILY_CTES,
)

# --- risk --------------------------------------------------------------------------------------------------------
PAGE = """
    SELECT s.wallet_address, fraud_score, risk_category, scored_at AS last_activity,
      fraud_score >= 0.7 AS is_suspicious, coalesce(f.tx_count, 0) AS tx_count,
      coalesce(f.total_value, 0) AS total_value,
      CASE WHEN fraud_score >= 0.7 THEN 'ML-detected anomalous behavior' END AS flagged_reason
    FROM scores s LEFT JOIN basic f ON s.wallet_address = f.wallet_address"""
register(
    "risk_wallet_page",
    lambda v: risk.risk_wallet_page(v.scores, v.served_features),
    f"{PAGE} ORDER BY fraud_score DESC, s.wallet_address LIMIT 50",
)
register(
    "risk_wallet_page_filtered",
    lambda v: risk.risk_wallet_page(
        v.scores, v.served_features, min_score=0.2, max_score=0.95, is_suspicious=True, min_tx_count=2,
        sort_by="total_value", descending=False, page=2, page_size=20,
    ),
    f"""{PAGE} WHERE fraud_score >= 0.2 AND fraud_score <= 0.95 AND fraud_score >= 0.7 AND f.tx_count >= 2
    ORDER BY f.total_value, s.wallet_address LIMIT 20 OFFSET 20""",
)
register(
    "risk_wallet_page_alerts",
    lambda v: risk.risk_wallet_page(v.scores, v.served_features, preset="top-alerts"),
    f"{PAGE} ORDER BY fraud_score DESC, s.wallet_address LIMIT 5",
)
register(
    "risk_wallet_counts",
    lambda v: risk.risk_wallet_counts(v.scores, v.served_features, min_score=0.3, min_tx_count=100),
    """
    SELECT count(*) AS total_count, count(*) FILTER (WHERE fraud_score >= 0.7) AS suspicious_count,
      CAST(ceil(count(*) / 50.0) AS BIGINT) AS page_count
    FROM scores s JOIN basic f ON s.wallet_address = f.wallet_address WHERE fraud_score >= 0.3 AND f.tx_count >= 100""",
)
register(
    "risk_heuristic_page",
    lambda v: risk.risk_heuristic_page(v.raw_wallets),
    f"""
    SELECT *, fraud_score >= 0.7 AS is_suspicious, {BAND} AS risk_category, CASE WHEN fraud_score >= 0.7
      THEN 'Heuristic-based detection (ML model not yet run)' END AS flagged_reason
    FROM (SELECT wallet_address, tx_count, total_value, last_activity, CASE WHEN total_value > 1000 THEN 0.8::DOUBLE
        WHEN tx_count > 500 THEN 0.6::DOUBLE WHEN total_value > 100 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS fraud_score
      FROM (SELECT wallet_address, total_transactions_in + total_transactions_out AS tx_count,
          {eth('total_value_in_wei')} + {eth('total_value_out_wei')} AS total_value,
          last_seen_timestamp AS last_activity FROM raw_wallets))
    ORDER BY fraud_score DESC, wallet_address LIMIT 50""",
)
register(
    "critical_wallets",
    lambda v: risk.critical_wallets(v.scores),
    """
    SELECT wallet_address, fraud_score, tx_count, total_value, last_activity, flagged_reason
    FROM scores WHERE fraud_score >= 0.9""",
)
register(
    "recently_flagged",
    lambda v: risk.recently_flagged(v.scores, as_of=v.now),
    """
    SELECT wallet_address, fraud_score, is_suspicious, tx_count, total_value, last_activity, updated_at
    FROM scores, moment WHERE is_suspicious AND updated_at >= as_of - INTERVAL 7 DAY
    ORDER BY updated_at DESC, wallet_address LIMIT 100""",
)
register(
    "daily_new_suspicious",
    lambda v: rounded(risk.daily_new_suspicious(v.scores, days=DAYS, as_of=v.now), {"avg_fraud_score": 9}),
    f"""
    SELECT updated_at::DATE AS date, count(*) AS new_suspicious_count, round(avg(fraud_score), 9) AS avg_fraud_score
    FROM scores, moment WHERE is_suspicious AND updated_at::DATE >= as_of::DATE - {DAYS} GROUP BY 1""",
)
register(
    "score_percentiles",
    lambda v: risk.score_percentiles(v.scores),
    """
    SELECT quantile_disc(fraud_score, 0.25) AS p25, quantile_disc(fraud_score, 0.5) AS p50_median,
      quantile_disc(fraud_score, 0.75) AS p75, quantile_disc(fraud_score, 0.9) AS p90,
      quantile_disc(fraud_score, 0.95) AS p95, quantile_disc(fraud_score, 0.99) AS p99 FROM scores""",
)
register(
    "suspicious_volume_tiers",
    lambda v: rounded(risk.suspicious_volume_tiers(v.scores), {"avg_fraud_score": 9}),
    f"""
    SELECT CASE WHEN total_value < 1000 THEN 'small (<1K)' WHEN total_value < 10000 THEN 'medium (1K-10K)'
        WHEN total_value < 100000 THEN 'large (10K-100K)' ELSE 'whale (>100K)' END AS volume_tier,
      count(*) AS wallet_count, round(avg(fraud_score), 9) AS avg_fraud_score,
      {eth('sum(total_value_wei)')} AS total_volume
    FROM scores WHERE is_suspicious GROUP BY 1""",
)
register(
    "connected_to_suspicious",
    lambda v: risk.connected_to_suspicious(v.fact, v.scores),
    """
    SELECT other AS wallet_address, fraud_score, is_suspicious, tx_count, total_value
    FROM (SELECT DISTINCT other FROM meetings SEMI JOIN bad ON one = wallet_address) partners
    ANTI JOIN bad ON other = bad.wallet_address
    LEFT JOIN scores ON other = scores.wallet_address
    WHERE other IS NOT NULL ORDER BY fraud_score DESC NULLS LAST, other LIMIT 100""",
    {
        "bad": "SELECT wallet_address FROM scores WHERE fraud_score >= 0.7",
        "meetings": """
        SELECT from_address AS one, to_address AS other FROM fact
        UNION SELECT to_address, from_address FROM fact""",
    },
)
register(
    "model_version_stats",
    lambda v: rounded(risk.model_version_stats(v.scores), {"avg_score": 9}),
    """
    SELECT model_version, count(*) AS predictions_count, round(avg(fraud_score), 9) AS avg_score,
      count(*) FILTER (WHERE is_suspicious) AS suspicious_count, min(prediction_timestamp) AS first_prediction,
      max(prediction_timestamp) AS last_prediction FROM scores GROUP BY model_version""",
)
register(
    "scores_listing",
    lambda v: risk.scores_listing(v.scores),
    """
    SELECT wallet_address, fraud_score, risk_category, isolation_forest_score, scored_at, model_version FROM scores""",
)
register(
    "risk_category_summary",
    lambda v: rounded(risk.risk_category_summary(v.scores), {"avg_fraud_score": 9}),
    """
    SELECT risk_category, count(*) AS wallet_count, round(avg(fraud_score), 9) AS avg_fraud_score,
      min(fraud_score) AS min_fraud_score, max(fraud_score) AS max_fraud_score FROM scores GROUP BY risk_category""",
)
register(
    "high_risk_investigation",
    lambda v: plain(risk.high_risk_investigation(v.scores, v.served_features)),
    """
    SELECT s.wallet_address, fraud_score, risk_category, f.tx_count, f.total_value, unique_counterparties, in_out_ratio,
      net_flow, counterparty_concentration, self_transactions, high_value_tx_ratio
    FROM scores s JOIN wallet_features f ON s.wallet_address = f.wallet_address
    WHERE risk_category IN ('high', 'critical') ORDER BY fraud_score DESC, s.wallet_address LIMIT 100""",
)
SCORED_WALLET = "0x" + "0" * 39 + "1"
register(
    "score_lookup",
    lambda v: risk.score_lookup(v.scores, SCORED_WALLET.upper()),
    f"SELECT wallet_address, fraud_score, risk_category FROM scores WHERE wallet_address = '{SCORED_WALLET}'",
)
register(
    "high_risk_listing",
    lambda v: risk.high_risk_listing(v.scores.select("wallet_address", "fraud_score", "risk_category", "model_version")),
    """
    SELECT wallet_address, fraud_score, risk_category, model_version FROM scores
    WHERE risk_category IN ('high', 'critical')""",
)
register(
    "risk_counts",
    lambda v: dashboard.risk_distribution(v.scores),
    """
    SELECT risk_category, count(*) AS wallet_count,
      round(CAST(count(*) * 100.0 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS percentage
    FROM scores GROUP BY risk_category""",
)

# --- wallets -----------------------------------------------------------------------------------------------------
TOUCH = f"(from_address = '{WALLET}' OR to_address = '{WALLET}')"
register(
    "wallet_profile",
    lambda v: wallets.wallet_profile(v.served_summary, v.scores, WALLET),
    f"""
    SELECT w.wallet_address, total_transactions, total_volume, first_transaction_date, last_transaction_date,
      unique_counterparties, avg_transaction_value, coalesce(fraud_score, 0) AS fraud_score,
      coalesce(is_suspicious, FALSE) AS is_suspicious, risk_category, flagged_reason
    FROM summary w LEFT JOIN scores s ON w.wallet_address = s.wallet_address WHERE w.wallet_address = '{WALLET}'""",
)
register(
    "wallet_stats",
    lambda v: wallets.wallet_stats(wallet_transfers(v.wallet_store, WALLET), WALLET),
    f"""
    SELECT '{WALLET}' AS wallet_address, n AS total_transactions, vol AS total_volume, first_transaction_date,
      last_transaction_date, unique_counterparties, round(vol / n, 2) AS average_transaction_value,
      CASE WHEN vol > 1000 THEN 0.3::DOUBLE WHEN n > 100 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS fraud_score,
      FALSE AS is_suspicious
    FROM (SELECT count(*) AS n, {eth('sum(value_wei)')} AS vol, min(transaction_date) AS first_transaction_date,
        max(transaction_date) AS last_transaction_date,
        count(DISTINCT CASE WHEN from_address = '{WALLET}' THEN to_address ELSE from_address END) AS unique_counterparties
      FROM fact WHERE {TOUCH}) WHERE n > 0""",
)
WALLET_DAILY = {
    "wallet_days": f"""
        SELECT transaction_date AS date, count(*) AS transaction_count, {eth('sum(value_wei)')} AS total_value,
          {eth(f"sum(CASE WHEN to_address = '{WALLET}' THEN value_wei ELSE 0 END)")} AS inflow,
          {eth(f"sum(CASE WHEN from_address = '{WALLET}' THEN value_wei ELSE 0 END)")} AS outflow
        FROM fact, moment WHERE {TOUCH} AND transaction_date >= as_of::DATE - 365 GROUP BY transaction_date"""
}


def _last_year(v: Views) -> DataFrame:
    return wallet_transfers(v.wallet_store, WALLET, since=F.date_sub(F.to_date(v.served_moment.scalar()), 365))


register(
    "wallet_daily",
    lambda v: wallets.wallet_daily(_last_year(v), WALLET, days=365, as_of=v.served_moment),
    "SELECT * FROM wallet_days",
    WALLET_DAILY,
)
register(
    "wallet_transactions",
    lambda v: wallets.wallet_transactions(wallet_transfers(v.wallet_store, WALLET), WALLET, limit=100),
    f"""
    SELECT transaction_hash, block_number, transaction_timestamp, from_address, to_address, value_eth, gas_used,
      gas_fee_eth AS transaction_fee, CASE WHEN from_address = '{WALLET}' THEN 'outgoing' ELSE 'incoming' END AS direction
    FROM fact WHERE {TOUCH} ORDER BY transaction_timestamp DESC, transaction_hash LIMIT 100""",
)
register(
    "wallet_counterparties",
    lambda v: wallets.wallet_counterparties(wallet_transfers(v.wallet_store, WALLET), WALLET),
    f"""
    SELECT CASE WHEN outgoing THEN to_address ELSE from_address END AS counterparty, count(*) AS transaction_count,
      {eth('sum(value_wei)')} AS total_value, max(transaction_timestamp) AS last_interaction
    FROM fact CROSS JOIN (VALUES (TRUE), (FALSE)) side(outgoing)
    WHERE CASE WHEN outgoing THEN from_address ELSE to_address END = '{WALLET}'
    GROUP BY ALL ORDER BY total_value DESC, counterparty NULLS LAST LIMIT 20""",
)
register(
    "wallet_search",
    lambda v: wallets.wallet_search(v.served_summary, PREFIX.upper()),
    f"""
    SELECT wallet_address, total_transactions, total_volume, last_transaction_date FROM summary
    WHERE wallet_address LIKE '{PREFIX}%' ORDER BY total_volume DESC, wallet_address LIMIT 10""",
)
register(
    "most_active_wallets",
    lambda v: wallets.most_active_wallets(v.served_summary),
    """
    SELECT wallet_address, total_transactions, total_volume, unique_counterparties, first_transaction_date,
      last_transaction_date FROM summary ORDER BY total_transactions DESC, wallet_address LIMIT 100""",
)
register(
    "highest_volume_wallets",
    lambda v: wallets.highest_volume_wallets(v.served_summary),
    """
    SELECT wallet_address, total_transactions, total_volume, avg_transaction_value, max_transaction_value
    FROM summary ORDER BY total_volume DESC, wallet_address LIMIT 100""",
)
register(
    "wallet_week_sparkline",
    lambda v: wallets.wallet_week_sparkline(_last_year(v), WALLET, days=365, as_of=v.served_moment),
    """
    SELECT date, strftime(date, '%a') AS name, CAST(floor(total_value + 0.5) AS BIGINT) AS total_value,
      CAST(floor(inflow + 0.5) AS BIGINT) AS inflow, CAST(floor(outflow + 0.5) AS BIGINT) AS outflow
    FROM (SELECT * FROM wallet_days ORDER BY date DESC LIMIT 7)""",
    WALLET_DAILY,
)


def _refreshed_store(v: Views) -> DataFrame:
    """The store of the transfers before a day, brought up to date by the days from there on."""
    path, first = new_path(v.spark, "wallet-transfers"), "1998-02-10"
    fact = v.served_transfers
    build_store(fact.filter(F.col("transaction_date") < first), path, unit="quarter", rows_per_bucket=2_500)
    # one value a day
    days = fact.select("transaction_date").filter(F.col("transaction_date") >= first).distinct().collect()
    refresh_store(fact, path, [row[0] for row in days], rows_per_bucket=2_500)
    return plain(wallet_sides(open_store(v.spark, path)))


register(
    "wallet_store_refresh",
    _refreshed_store,
    """
    SELECT wallet_address, direction, count(*) AS transfers, CAST(sum(value_wei) AS VARCHAR) AS total_wei,
      min(ts) AS first_time, max(ts) AS last_time, count(counterparty) AS known_counterparties
    FROM (SELECT unnest([
        {'w': from_address, 'c': to_address, 'd': 'out'}, {'w': to_address, 'c': from_address, 'd': 'in'}]) AS side,
        value_wei, transaction_timestamp AS ts FROM fact)
    CROSS JOIN LATERAL (SELECT side.w AS wallet_address, side.c AS counterparty, side.d AS direction)
    WHERE wallet_address IS NOT NULL GROUP BY wallet_address, direction""",
)
