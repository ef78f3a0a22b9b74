"""Queries about one wallet, and wallet rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L

AsOf = Column | DataFrame | str | None
MAX_DAYS = 365


def _touching(fact: DataFrame, address: str) -> tuple[DataFrame, str]:
    """Transfers of one wallet; the OR of two equalities reaches the file scan."""
    wanted = address.lower().strip()
    return fact.filter((F.col("from_address") == wanted) | (F.col("to_address") == wanted)), wanted


def wallet_profile(summary: DataFrame, scores: DataFrame, address: str) -> DataFrame:
    """Dimension row of a wallet with its score; defaults where it was never scored."""
    wanted = address.lower().strip()
    wallet = summary.filter(F.col("wallet_address") == wanted)
    score = scores.filter(F.col("wallet_address") == wanted).select(
        "wallet_address", "fraud_score", "is_suspicious", "risk_category", "flagged_reason"
    )
    zero = F.lit(0)
    return wallet.join(score, "wallet_address", "left").select(
        "wallet_address",
        F.coalesce("total_transactions", zero).alias("total_transactions"),
        F.coalesce("total_volume", zero).alias("total_volume"),
        "first_transaction_date",
        "last_transaction_date",
        F.coalesce("unique_counterparties", zero).alias("unique_counterparties"),
        F.coalesce("avg_transaction_value", zero).alias("avg_transaction_value"),
        F.coalesce("fraud_score", zero).alias("fraud_score"),
        F.coalesce("is_suspicious", F.lit(False)).alias("is_suspicious"),
        "risk_category",
        "flagged_reason",
    )


def wallet_stats(fact: DataFrame, address: str) -> DataFrame:
    """Statistics of a wallet from its transfers; no row for an unknown wallet."""
    rows, wanted = _touching(fact, address)
    other = F.when(F.col("from_address") == wanted, F.col("to_address")).otherwise(F.col("from_address"))
    total = rows.agg(
        F.count("*").alias("total_transactions"),
        L.ether_sum(F.col("value_wei")).alias("total_volume"),
        F.min("transaction_date").alias("first_transaction_date"),
        F.max("transaction_date").alias("last_transaction_date"),
        F.count_distinct(other).alias("unique_counterparties"),
    ).filter("total_transactions > 0")
    score = F.when(F.col("total_volume") > 1000, 0.3).when(F.col("total_transactions") > 100, 0.2).otherwise(0.1)
    return total.select(
        F.lit(wanted).alias("wallet_address"),
        "*",
        F.round(F.col("total_volume") / F.col("total_transactions"), 2).alias("average_transaction_value"),
        score.alias("fraud_score"),
        F.lit(False).alias("is_suspicious"),
    )


def wallet_daily(fact: DataFrame, address: str, *, days: int = 30, as_of: AsOf = None) -> DataFrame:
    """Per day: transfers, value, inflow and outflow of a wallet."""
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"days must be between 1 and {MAX_DAYS}")
    rows, wanted = _touching(fact, address)
    today = F.to_date(L.point_in_time(as_of, fact, "transaction_timestamp"))
    wei = F.col("value_wei")
    return (
        rows.filter(F.col("transaction_date") >= F.date_sub(today, days))
        .groupBy(F.col("transaction_date").alias("date"))
        .agg(
            F.count("*").alias("transaction_count"),
            L.ether_sum(wei).alias("total_value"),
            L.ether_sum(F.when(F.col("to_address") == wanted, wei).otherwise(L.zero_wei())).alias("inflow"),
            L.ether_sum(F.when(F.col("from_address") == wanted, wei).otherwise(L.zero_wei())).alias("outflow"),
        )
        .orderBy(F.col("date").desc())
    )


def wallet_transactions(fact: DataFrame, address: str, *, limit: int = 50) -> DataFrame:
    """Latest transfers of a wallet with direction."""
    rows, wanted = _touching(fact, address)
    return (
        rows.select(
            "transaction_hash",
            "block_number",
            "transaction_timestamp",
            "from_address",
            "to_address",
            "value_eth",
            "gas_used",
            F.col("gas_fee_eth").alias("transaction_fee"),
            F.when(F.col("from_address") == wanted, "outgoing").otherwise("incoming").alias("direction"),
        )
        .orderBy(F.col("transaction_timestamp").desc(), "transaction_hash")
        .limit(limit)
    )


def wallet_counterparties(fact: DataFrame, address: str, *, limit: int = 20) -> DataFrame:
    """Partners of a wallet by value; a transfer to itself counts on both sides."""
    rows, wanted = _touching(fact, address)
    partners = F.array_compact(
        F.array(
            F.when(F.col("from_address") == wanted, F.struct(F.col("to_address").alias("counterparty"))),
            F.when(F.col("to_address") == wanted, F.struct(F.col("from_address").alias("counterparty"))),
        )
    )
    return (
        rows.select(F.explode(partners).alias("p"), "value_wei", "transaction_timestamp")
        .groupBy(F.col("p.counterparty").alias("counterparty"))
        .agg(
            F.count("*").alias("transaction_count"),
            L.ether_sum(F.col("value_wei")).alias("total_value"),
            F.max("transaction_timestamp").alias("last_interaction"),
        )
        .orderBy(F.col("total_value").desc(), F.col("counterparty").asc_nulls_last())
        .limit(limit)
    )


def wallet_search(summary: DataFrame, prefix: str, *, limit: int = 10) -> DataFrame:
    return (
        summary.filter(F.col("wallet_address").startswith(prefix.lower().strip()))
        .select("wallet_address", "total_transactions", "total_volume", "last_transaction_date")
        .orderBy(F.col("total_volume").desc(), "wallet_address")
        .limit(limit)
    )


def most_active_wallets(summary: DataFrame, *, limit: int = 100) -> DataFrame:
    return (
        summary.select(
            "wallet_address",
            "total_transactions",
            "total_volume",
            "unique_counterparties",
            "first_transaction_date",
            "last_transaction_date",
        )
        .orderBy(F.col("total_transactions").desc(), "wallet_address")
        .limit(limit)
    )


def highest_volume_wallets(summary: DataFrame, *, limit: int = 100) -> DataFrame:
    return (
        summary.select(
            "wallet_address", "total_transactions", "total_volume", "avg_transaction_value", "max_transaction_value"
        )
        .orderBy(F.col("total_volume").desc(), "wallet_address")
        .limit(limit)
    )


def wallet_week_sparkline(
    fact: DataFrame, address: str, *, days: int = 30, points: int = 7, as_of: AsOf = None
) -> DataFrame:
    """The latest active days of a wallet, oldest first, with rounded values and weekday names."""
    latest = wallet_daily(fact, address, days=days, as_of=as_of).limit(points)

    def rounded(name: str) -> Column:
        # half up, as in the chart
        return F.floor(F.col(name) + 0.5).cast("bigint").alias(name)

    return latest.orderBy("date").select(
        "date",
        F.date_format("date", "EEE").alias("name"),
        rounded("total_value"),
        rounded("inflow"),
        rounded("outflow"),
    )
