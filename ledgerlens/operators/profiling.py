"""Profiling queries over raw transfers and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.functions import stats as S
from ledgerlens.functions.tiers import HIGH_RISK
from ledgerlens.operators.daily import wallet_presence
from ledgerlens.operators.preparation import describe_numeric
from ledgerlens.operators.staging import wallet_edges

# Fixed values.
VALUE_PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
DAY_NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
LOG_SHIFT = 1e-10


def _gwei() -> Column:
    return F.col("gas_price").cast("double") / F.lit(L.WEI_PER_GWEI)


def profile_overview(raw: DataFrame) -> DataFrame:
    """One row: transfers, distinct sides, time range, value and gas averages."""
    totals = raw.agg(
        F.count("*").alias("total_transactions"),
        F.min("transaction_timestamp").alias("earliest_tx"),
        F.max("transaction_timestamp").alias("latest_tx"),
        L.ether_sum(F.col("value_wei")).alias("total_value_eth"),
        L.ether_avg(F.col("value_wei")).alias("avg_value_eth"),
        F.try_divide(F.sum("gas_used").cast("double"), F.count("gas_used")).alias("avg_gas_used"),
        F.avg(_gwei()).alias("avg_gas_price_gwei"),
    )
    sides = S.as_struct(
        wallet_presence(raw).agg(
            F.sum("sent").alias("unique_senders"), F.sum("received").alias("unique_receivers")
        )
    )
    return totals.select("*", sides["unique_senders"].alias("unique_senders"), sides["unique_receivers"].alias("unique_receivers"))


def profile_sample(raw: DataFrame, *, rows: int = 5) -> DataFrame:
    return raw.limit(rows)


def _values(raw: DataFrame) -> DataFrame:
    return raw.filter("value_eth IS NOT NULL").select(
        "value_eth", F.col("gas_used").cast("double").alias("gas_used"), _gwei().alias("gas_price_gwei")
    )


def profile_values(raw: DataFrame) -> DataFrame:
    """Description of value, gas and gas price of transfers with a value."""
    return describe_numeric(_values(raw), ["value_eth", "gas_used", "gas_price_gwei"])


def value_percentiles(raw: DataFrame) -> DataFrame:
    return S.exact_quantiles(_values(raw), ["value_eth"], VALUE_PERCENTILES).select(
        "probability", F.col("quantile").alias("value_eth")
    )


def log_value_histogram(raw: DataFrame, *, bins: int = 50) -> DataFrame:
    """Bins of log10(value) of non-zero transfers, with the log10 of their median."""
    positive = raw.filter("value_eth > 0").select("value_eth")
    logs = positive.select(F.log10(F.col("value_eth") + LOG_SHIFT).alias("log_value"))
    median = S.as_struct(S.quantile_row(positive, ["value_eth"], {"median": 0.5}))["value_eth_median"]
    return S.histogram(logs, "log_value", bins).withColumn("log_median", F.log10(median))


def zero_share(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count_if(F.col("value_eth") == 0).alias("zero_value"), F.count_if(F.col("value_eth") > 0).alias("non_zero_value")
    )


def gas_histogram(raw: DataFrame, *, bins: int = 50) -> DataFrame:
    return S.histogram(raw.filter("value_eth IS NOT NULL"), "gas_used", bins)


def gas_price_trimmed_histogram(raw: DataFrame, *, bins: int = 50, below: float = 0.99) -> DataFrame:
    """Bins of gas prices strictly below their 99th percentile."""
    prices = raw.filter("value_eth IS NOT NULL").select(_gwei().alias("gas_price_gwei"))
    cut = S.as_struct(S.quantile_row(prices, ["gas_price_gwei"], {"cut": below}))["gas_price_gwei_cut"]
    return S.histogram(prices.filter(F.col("gas_price_gwei") < cut), "gas_price_gwei", bins)


def profile_daily(raw: DataFrame) -> DataFrame:
    dated = raw.withColumn("tx_date", F.to_date("transaction_timestamp"))
    stats = dated.groupBy("tx_date").agg(
        F.count("*").alias("tx_count"),
        L.ether_sum(F.col("value_wei")).alias("total_value"),
        L.ether_avg(F.col("value_wei")).alias("avg_value"),
        F.avg(_gwei()).alias("avg_gas_gwei"),
    )
    senders = dated.select("tx_date", "from_address").distinct().groupBy("tx_date").agg(
        F.count("from_address").alias("unique_senders")
    )
    return stats.join(senders, "tx_date").orderBy("tx_date")


def profile_hour_of_day(raw: DataFrame) -> DataFrame:
    return (
        raw.groupBy(F.hour("transaction_timestamp").alias("hour_of_day"))
        .agg(F.count("*").alias("tx_count"), L.ether_sum(F.col("value_wei")).alias("total_value"))
        .orderBy("hour_of_day")
    )


def profile_day_of_week(raw: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return (
        raw.groupBy(F.dayofweek("transaction_timestamp").alias("day_of_week"))
        .agg(F.count("*").alias("tx_count"), L.ether_sum(F.col("value_wei")).alias("total_value"))
        .withColumn("day_name", F.element_at(names, F.col("day_of_week")))
        .orderBy("day_of_week")
    )


def top_wallets(raw: DataFrame, *, limit: int | None = 20) -> DataFrame:
    """Wallets by number of transfers on either side."""
    sent = F.col("direction") == "out"
    ranked = (
        wallet_edges(raw, "value_wei")
        .groupBy(F.col("wallet_address").alias("wallet"))
        .agg(
            F.count("*").alias("total_tx"),
            L.ether_sum(F.col("value_wei")).alias("total_value"),
            F.count_if(sent).alias("sent_tx"),
            F.count_if(~sent).alias("received_tx"),
        )
        .orderBy(F.col("total_tx").desc(), "wallet")
    )
    return ranked if limit is None else ranked.limit(limit)


def eda_summary(raw: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: totals, range, zero share, median, most active wallet, scored and high-risk wallets."""
    valued = raw.filter("value_eth IS NOT NULL")
    totals = valued.agg(
        F.count("*").alias("total_transactions"),
        L.ether_sum(F.col("value_wei")).alias("total_value_eth"),
        F.count_if(F.col("value_eth") == 0).alias("zero_value_transactions"),
        (F.count_if(F.col("value_eth") == 0) * 100.0 / F.count("*")).cast("double").alias("zero_value_pct"),
        F.try_divide(F.sum("gas_used").cast("double"), F.count("gas_used")).alias("avg_gas_used"),
        F.to_date(F.min("transaction_timestamp")).alias("first_date"),
        F.to_date(F.max("transaction_timestamp")).alias("last_date"),
    )
    median = S.as_struct(S.quantile_row(valued, ["value_eth"], {"median": 0.5}))
    leader = S.as_struct(top_wallets(raw, limit=1).select("wallet", "total_tx"))
    risky = F.count_if(F.col("risk_category").isin(*HIGH_RISK))
    risk = (
        scores.agg(
            F.count("*").alias("wallets_scored"),
            risky.alias("high_risk_wallets"),
            (risky * 100.0 / F.count("*")).cast("double").alias("high_risk_pct"),
            F.avg("fraud_score").alias("avg_fraud_score"),
        )
    )
    return S.attach(totals, risk, "_risk").select(
        *totals.columns,
        median["value_eth_median"].alias("median_value_eth"),
        leader["wallet"].alias("most_active_wallet"),
        leader["total_tx"].alias("most_active_tx"),
        *[F.col(f"_risk.{c}").alias(c) for c in ("wallets_scored", "high_risk_wallets", "high_risk_pct", "avg_fraud_score")],
    )
