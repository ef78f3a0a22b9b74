"""Fact table and dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import calendar as C
from ledgerlens.functions import ledger as L
from ledgerlens.functions import tiers as T
from ledgerlens.operators.staging import OVERFLOW, wallet_edges
from ledgerlens.operators.upserts import upsert_columns

MIN_QUALITY = 0.5
# Default range of the date spine.
SPINE_START = dt.date(2015, 7, 30)
SPINE_END = dt.date(2030, 12, 31)


def min_quality_filter(staged: DataFrame, threshold: float = MIN_QUALITY) -> DataFrame:
    return staged.filter(F.col("data_quality_score") >= threshold)


def fact_transactions(staged: DataFrame, *, loaded_at: Column | None = None) -> DataFrame:
    """Staged transfers of sufficient quality with keys, measures, flags and value tier.

    A missing amount is 0; one of over 38 digits (issue value_overflow) stays NULL and counts as a transfer of high value.
    """
    c = F.col
    over = F.coalesce(F.array_contains("data_quality_issues", OVERFLOW), F.lit(False))
    value = F.when(~over, F.coalesce(c("value_eth"), F.lit(0.0)))
    return min_quality_filter(staged).select(
        c("transaction_id").alias("transaction_key"),
        "transaction_hash",
        "block_number",
        C.date_key(c("transaction_date")).alias("time_key"),
        c("from_address").alias("from_wallet_key"),
        c("to_address").alias("to_wallet_key"),
        "transaction_date",
        "transaction_timestamp",
        "transaction_hour",
        "from_address",
        "to_address",
        value.alias("value_eth"),
        F.when(~over, F.coalesce(c("value_wei"), L.zero_wei())).alias("value_wei"),
        "value_usd",
        "gas_limit",
        "gas_used",
        (c("gas_price_wei").cast("double") / F.lit(L.WEI_PER_GWEI)).alias("gas_price_gwei"),
        "gas_fee_eth",
        F.lit(None).cast("double").alias("gas_fee_usd"),
        F.when(c("gas_limit") > 0, c("gas_used").cast("double") / c("gas_limit")).alias("gas_efficiency"),
        "transaction_type",
        "is_contract_creation",
        c("is_contract_interaction").alias("is_contract_call"),
        (over | (value > 0)).alias("is_value_transfer"),
        "is_successful",
        "method_id",
        "contract_address",
        (over | (value >= 10)).alias("is_high_value"),
        (~over & (value < 0.001) & (value > 0)).alias("is_micro_transaction"),
        F.when(over, T.VALUE_TIERS[0][1]).otherwise(T.value_tier(c("value_eth"))).alias("value_tier"),
        "data_quality_score",
        "source",
        "staged_at",
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("loaded_at"),
    )


# Columns of the slim daily variant.
RECENT_FACT_COLUMNS = (
    "transaction_key", "transaction_hash", "block_number", "time_key", "from_wallet_key", "to_wallet_key",
    "transaction_date", "transaction_timestamp", "transaction_hour", "from_address", "to_address", "value_eth",
    "value_wei", "gas_limit", "gas_used", "transaction_type", "is_successful", "source", "staged_at", "loaded_at",
)


def fact_transactions_recent(
    staged: DataFrame, *, days: int = 2, as_of: Column | DataFrame | str | None = None, loaded_at: Column | None = None
) -> DataFrame:
    """Slim variant over rows staged in the last days."""
    now = L.point_in_time(as_of, staged, "staged_at")
    recent = staged.filter(F.col("staged_at") > L.days_before(now, days))
    return fact_transactions(recent, loaded_at=loaded_at).select(*RECENT_FACT_COLUMNS)


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row (start, end) covering the dates in a column."""
    return df.agg(F.min(column).alias("start"), F.max(column).alias("end"))


def relative_columns(day: Column, today: Column) -> list[Column]:
    """Columns that depend on the current date."""
    return [
        (day == today).alias("is_current_day"),
        (C.week_start(day) == C.week_start(today)).alias("is_current_week"),
        (F.trunc(day, "MONTH") == F.trunc(today, "MONTH")).alias("is_current_month"),
        (F.trunc(day, "QUARTER") == F.trunc(today, "QUARTER")).alias("is_current_quarter"),
        (F.year(day) == F.year(today)).alias("is_current_year"),
        F.datediff(today, day).cast("bigint").alias("days_ago"),
        C.weeks_between_dates(today, day).cast("bigint").alias("weeks_ago"),
        C.months_between_dates(today, day).cast("bigint").alias("months_ago"),
    ]


# Fixed values.
RELATIVE_NAMES = (
    "is_current_day", "is_current_week", "is_current_month", "is_current_quarter", "is_current_year",
    "days_ago", "weeks_ago", "months_ago",
)


def dim_time(
    spark: SparkSession,
    bounds: DataFrame | None = None,
    *,
    today: Column | None = None,
    start: dt.date = SPINE_START,
    end: dt.date = SPINE_END,
) -> DataFrame:
    """Calendar dimension, one row per day between `bounds` (one row: start, end) or the given dates.

    Quarter end is the last day of the quarter.
    """
    if bounds is None:
        bounds = spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end"))
    today = F.current_date() if today is None else today
    days = bounds.select(F.explode(F.sequence(F.col("start"), F.col("end"), F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    d = F.col("full_date")
    year, quarter = F.year(d).cast("string"), F.quarter(d).cast("string")
    week = C.week_of_year(d)

    def number(c: Column) -> Column:
        return c.cast("bigint")

    return days.select(
        C.date_key(d).alias("time_key"),
        d,
        number(F.year(d)).alias("year"),
        number(F.quarter(d)).alias("quarter"),
        number(F.month(d)).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "MMM").alias("month_short"),
        number(week).alias("week_of_year"),
        number(F.ceil(F.dayofmonth(d) / 7.0)).alias("week_of_month"),
        number(F.dayofyear(d)).alias("day_of_year"),
        number(F.dayofmonth(d)).alias("day_of_month"),
        number(F.dayofweek(d)).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "EEE").alias("day_short"),
        C.is_weekend(d).alias("is_weekend"),
        (~C.is_weekend(d)).alias("is_weekday"),
        (F.dayofmonth(d) == 1).alias("is_month_start"),
        (d == F.last_day(d)).alias("is_month_end"),
        (d == F.trunc(d, "QUARTER")).alias("is_quarter_start"),
        (d == C.quarter_end(d)).alias("is_quarter_end"),
        (d == F.trunc(d, "YEAR")).alias("is_year_start"),
        ((F.month(d) == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.concat(year, F.lit("-Q"), quarter).alias("year_quarter"),
        F.concat(year, F.lit("-W"), F.lpad(week.cast("string"), 2, "0")).alias("year_week"),
        *relative_columns(d, today),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )


def dim_time_refresh(dim: DataFrame, *, today: Column | None = None) -> DataFrame:
    """Recompute only the columns relative to the current date."""
    today = F.current_date() if today is None else today
    fresh = dim.select("time_key", *relative_columns(F.col("full_date"), today), F.current_timestamp().alias("updated_at"))
    return upsert_columns(dim, fresh, ["time_key"], [*RELATIVE_NAMES, "updated_at"])


def dim_wallet(staged: DataFrame, *, today: Column | None = None, now: Column | None = None) -> DataFrame:
    """Current wallet dimension rows."""
    c = F.col
    today = F.current_date() if today is None else today
    now = F.current_timestamp() if now is None else now
    span = F.datediff("last_seen_date", "first_seen_date")
    return staged.select(
        c("wallet_address").alias("wallet_key"),
        "wallet_address",
        "first_seen_date",
        "last_seen_date",
        F.datediff(today, "first_seen_date").cast("bigint").alias("account_age_days"),
        "wallet_type",
        T.activity_level(c("transactions_per_day")).alias("activity_level"),
        "is_contract",
        "is_exchange",
        F.lit(False).alias("is_known_entity"),
        F.lit(None).cast("string").alias("entity_name"),
        F.lit(None).cast("string").alias("entity_category"),
        c("balance_eth").alias("current_balance_eth"),
        T.balance_tier(c("balance_eth")).alias("balance_tier"),
        "total_transactions",
        c("total_transactions_out").alias("total_sent"),
        c("total_transactions_in").alias("total_received"),
        "unique_counterparties",
        c("total_value_out_eth").alias("total_value_sent_eth"),
        c("total_value_in_eth").alias("total_value_received_eth"),
        (c("total_value_in_eth") - c("total_value_out_eth")).alias("net_flow_eth"),
        c("avg_transaction_value_eth").alias("avg_transaction_eth"),
        c("transactions_per_day").alias("avg_transactions_per_day"),
        c("activity_days").alias("days_active"),
        F.when(span > 0, c("activity_days").cast("double") / span).otherwise(1.0).alias("activity_consistency"),
        F.lit(None).cast("double").alias("fraud_score"),
        F.lit("unknown").alias("risk_level"),
        F.lit(False).alias("is_suspicious"),
        F.array().cast("array<string>").alias("suspicious_flags"),
        "data_quality_score",
        F.lit(True).alias("is_current"),
        now.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        "source",
        now.alias("created_at"),
        now.alias("updated_at"),
    )


# Columns the variant with the maximum transfer leaves out.
_NOT_IN_MAX_VARIANT = (
    "is_known_entity", "entity_name", "entity_category", "suspicious_flags", "data_quality_score",
    "is_current", "valid_from", "valid_to",
)


def dim_wallet_with_max(staged_wallets: DataFrame, staged_tx: DataFrame, **options) -> DataFrame:
    """Wallet dimension with the largest transfer a wallet took part in, 0 when it has none."""
    largest = wallet_edges(staged_tx, "value_eth").groupBy("wallet_address").agg(F.max("value_eth").alias("largest"))
    return (
        dim_wallet(staged_wallets, **options)
        .drop(*_NOT_IN_MAX_VARIANT)
        .join(largest, "wallet_address", "left")
        .withColumn("max_transaction_eth", F.coalesce("largest", F.lit(0.0)))
        .drop("largest")
    )


def dim_wallet_summary(
    tx: DataFrame, contracts: DataFrame | None = None, *, as_of: Column | DataFrame | str | None = None
) -> DataFrame:
    """Wallet totals straight from transfers: dates, volume, sent, received, average, extremes, age, counterparties."""
    today = F.to_date(L.point_in_time(as_of, tx, "transaction_timestamp"))
    edges = wallet_edges(tx, "value_wei", "value_eth", "transaction_date")
    outgoing = F.col("direction") == "out"
    pairs = edges.groupBy("wallet_address", "counterparty").agg(
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
        F.count("*").alias("n"),
        F.sum("value_wei").alias("wei"),
        F.sum(F.when(outgoing, F.col("value_wei")).otherwise(L.zero_wei())).alias("wei_sent"),
        F.max("value_eth").alias("largest"),
        F.min("value_eth").alias("smallest"),
    )
    summary = pairs.groupBy("wallet_address").agg(
        F.min("first_date").alias("first_transaction_date"),
        F.max("last_date").alias("last_transaction_date"),
        F.sum("n").alias("total_transactions"),
        L.ether_sum(F.col("wei")).alias("total_volume"),
        L.ether_sum(F.col("wei_sent")).alias("total_sent"),
        L.wei_to_ether(F.sum("wei") - F.sum("wei_sent")).alias("total_received"),
        F.count("counterparty").alias("unique_counterparties"),
        (L.ether_sum(F.col("wei")) / F.sum("n")).alias("avg_transaction_value"),
        F.max("largest").alias("max_transaction_value"),
        F.min("smallest").alias("min_transaction_value"),
        F.datediff(today, F.min("first_date")).cast("bigint").alias("wallet_age_days"),
    )
    if contracts is None:
        return summary.withColumn("is_contract", F.lit(False))
    flagged = contracts.select("wallet_address", "is_contract")
    return summary.join(flagged, "wallet_address", "left").withColumn(
        "is_contract", F.coalesce("is_contract", F.lit(False))
    )
