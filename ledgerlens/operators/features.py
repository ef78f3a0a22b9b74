"""Wallet features from the edge list.

Three narrow aggregations cover all 35 features: per wallet (sums, extremes, time patterns), per (wallet, counterparty)
and per (wallet, day). Each combines in the map tasks, so a wallet with a large share of all transfers does not become
one large task, and no row is multiplied for distinct counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.functions.calendar import whole_units_between
from ledgerlens.operators.preparation import impute
from ledgerlens.operators.staging import wallet_edges
from ledgerlens.session import materialize

AsOf = Column | DataFrame | str | None

# Feature names in order.
BASIC_FEATURES = (
    "tx_count", "tx_count_in", "tx_count_out", "total_value", "total_value_in", "total_value_out", "avg_value",
    "std_value", "min_value", "max_value", "unique_counterparties", "avg_gas_used", "avg_gas_price",
    "activity_span_days", "active_days", "in_out_ratio", "net_flow", "tx_per_active_day", "value_per_tx",
)
BEHAVIORAL_FEATURES = (
    "avg_counterparty_value", "counterparty_concentration", "self_transactions", "round_value_ratio",
    "high_value_tx_ratio", "zero_value_tx_ratio",
)
TEMPORAL_FEATURES = (
    "tx_frequency_per_hour", "avg_hours_between_tx", "tx_count_7d", "value_7d", "tx_count_30d", "value_30d",
    "unique_hours_active", "unique_days_of_week_active", "weekend_tx_ratio", "night_tx_ratio",
)
FEATURE_COLUMNS = BASIC_FEATURES + BEHAVIORAL_FEATURES + TEMPORAL_FEATURES
MIN_TRANSACTIONS = 2
FEATURE_VERSION = "1.0.0"
WINDOW_DAYS = (7, 30, 90)

EDGE_COLUMNS = ("value_wei", "value_eth", "gas_price_wei", "gas_used", "transaction_timestamp")


def feature_columns() -> list[str]:
    return list(FEATURE_COLUMNS)


def _edges(staged: DataFrame) -> DataFrame:
    return wallet_edges(staged, *EDGE_COLUMNS)


def _share(condition: Column) -> Column:
    return F.count_if(condition) / F.count("*")


def _in_window(days: int, now: Column) -> Column:
    return F.col("transaction_timestamp") >= L.days_before(now, days)


def _value_in_window(days: int, now: Column) -> Column:
    return L.ether_sum(F.when(_in_window(days, now), F.col("value_wei")).otherwise(L.zero_wei()))


def _basic_measures() -> list[Column]:
    incoming = F.col("direction") == "in"
    wei = F.col("value_wei")
    first, last = F.min("transaction_timestamp"), F.max("transaction_timestamp")
    return [
        F.count_if(incoming).alias("tx_count_in"),
        F.count_if(~incoming).alias("tx_count_out"),
        L.ether_sum(wei).alias("total_value"),
        L.ether_sum(F.when(incoming, wei).otherwise(L.zero_wei())).alias("total_value_in"),
        L.ether_sum(F.when(~incoming, wei).otherwise(L.zero_wei())).alias("total_value_out"),
        L.ether_avg(wei).alias("avg_value"),
        F.coalesce(F.stddev_samp("value_eth"), F.lit(0.0)).alias("std_value"),
        F.min("value_eth").alias("min_value"),
        F.max("value_eth").alias("max_value"),
        F.avg("gas_used").alias("avg_gas_used"),
        F.try_divide(F.sum("gas_price_wei").cast("double"), F.count("gas_price_wei")).alias("avg_gas_price"),
        first.alias("first_tx_time"),
        last.alias("last_tx_time"),
        whole_units_between("DAY", first, last).cast("bigint").alias("activity_span_days"),
    ]


def _pattern_measures() -> list[Column]:
    # rounded half away from zero, so amounts below half a thousandth count as round
    thousandths = F.round(F.col("value_eth") * 1000).cast("decimal(38,0)")
    return [
        _share(thousandths % 1000 == 0).alias("round_value_ratio"),
        _share(F.col("value_eth") > 10).alias("high_value_tx_ratio"),
        _share(F.col("value_eth") == 0).alias("zero_value_tx_ratio"),
    ]


def _temporal_measures(now: Column) -> list[Column]:
    time = F.col("transaction_timestamp")
    hours = whole_units_between("HOUR", F.min(time), F.max(time))
    n = F.count("*")

    def distinct_small(value: Column) -> Column:
        # values below 64 fit one bit each
        return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), value))).cast("bigint")

    return [
        (n / F.greatest(hours, F.lit(1))).alias("tx_frequency_per_hour"),
        (hours / F.greatest(n - 1, F.lit(1))).alias("avg_hours_between_tx"),
        F.count_if(_in_window(7, now)).alias("tx_count_7d"),
        _value_in_window(7, now).alias("value_7d"),
        F.count_if(_in_window(30, now)).alias("tx_count_30d"),
        _value_in_window(30, now).alias("value_30d"),
        distinct_small(F.hour(time)).alias("unique_hours_active"),
        distinct_small(F.dayofweek(time)).alias("unique_days_of_week_active"),
        _share(F.dayofweek(time).isin(1, 7)).alias("weekend_tx_ratio"),
        _share(F.hour(time).between(0, 6)).alias("night_tx_ratio"),
    ]


def _per_wallet(edges: DataFrame, measures: Sequence[Column], min_transactions: int) -> DataFrame:
    grouped = edges.groupBy("wallet_address").agg(F.count("*").alias("tx_count"), *measures)
    return grouped.filter(F.col("tx_count") >= min_transactions)


def _active_days(edges: DataFrame) -> DataFrame:
    days = edges.select("wallet_address", F.to_date("transaction_timestamp").alias("day")).distinct()
    return days.groupBy("wallet_address").agg(F.count("day").alias("active_days"))


def _per_counterparty(edges: DataFrame) -> DataFrame:
    pairs = edges.groupBy("wallet_address", "counterparty").agg(
        F.count("*").alias("n"), F.sum("value_wei").alias("wei")
    )
    to_self = F.col("wallet_address") == F.col("counterparty")
    return pairs.groupBy("wallet_address").agg(
        F.count("counterparty").alias("unique_counterparties"),
        F.coalesce(L.ether_avg(F.col("wei")), F.lit(0.0)).alias("avg_counterparty_value"),
        (F.max("n") / F.sum("n")).alias("counterparty_concentration"),
        F.count_if(to_self).alias("self_transactions"),
        F.coalesce(F.sum(F.when(to_self, F.col("n"))), F.lit(0)).alias("self_tx_total"),
    )


def _with_basic_ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "*",
        F.try_divide("tx_count_in", "tx_count_out").alias("in_out_ratio"),
        (c("total_value_in") - c("total_value_out")).alias("net_flow"),
        (c("tx_count") / F.greatest("active_days", F.lit(1))).alias("tx_per_active_day"),
        (c("total_value") / c("tx_count")).alias("value_per_tx"),
    )


_BASIC_ORDER = BASIC_FEATURES[:13] + ("first_tx_time", "last_tx_time") + BASIC_FEATURES[13:]


def basic_features(staged: DataFrame, *, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """19 activity, value and gas features of wallets with enough transfers."""
    edges = _edges(staged)
    joined = (
        _per_wallet(edges, _basic_measures(), min_transactions)
        .join(_active_days(edges), "wallet_address", "left")
        .join(_per_counterparty(edges).select("wallet_address", "unique_counterparties"), "wallet_address", "left")
    )
    return _with_basic_ratios(joined).select("wallet_address", *_BASIC_ORDER)


def behavioral_features(staged: DataFrame, *, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """Counterparty concentration, transfers to self, and shares of round, high and zero values.

    `self_transactions` counts counterparties equal to the wallet (0 or 1); `self_tx_total` counts the transfers.
    """
    edges = _edges(staged)
    patterns = _per_wallet(edges, _pattern_measures(), min_transactions).drop("tx_count")
    shares = [F.coalesce(name, F.lit(0.0)).alias(name) for name in BEHAVIORAL_FEATURES[3:]]
    return (
        _per_counterparty(edges)
        .drop("unique_counterparties")
        .join(patterns, "wallet_address", "left")
        .select("wallet_address", *BEHAVIORAL_FEATURES[:3], "self_tx_total", *shares)
    )


def temporal_features(staged: DataFrame, *, as_of: AsOf = None, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """Frequency, recent activity against the ledger's last moment, and hour/weekday patterns."""
    now = L.point_in_time(as_of, staged, "transaction_timestamp")
    grouped = _per_wallet(_edges(staged), _temporal_measures(now), min_transactions)
    return grouped.select("wallet_address", *TEMPORAL_FEATURES)


def window_features(staged: DataFrame, *, days: Sequence[int] = WINDOW_DAYS, as_of: AsOf = None) -> DataFrame:
    """Transfers and value in each trailing window, all in one aggregation."""
    now = L.point_in_time(as_of, staged, "transaction_timestamp")
    measures = []
    for d in days:
        measures += [F.count_if(_in_window(d, now)).alias(f"tx_count_{d}d"), _value_in_window(d, now).alias(f"value_{d}d")]
    return _edges(staged).groupBy("wallet_address").agg(*measures)


def combined_features(
    staged: DataFrame, *, as_of: AsOf = None, min_transactions: int = MIN_TRANSACTIONS
) -> DataFrame:
    """All 35 features before imputation."""
    now = L.point_in_time(as_of, staged, "transaction_timestamp")
    edges = _edges(staged)
    measures = [*_basic_measures(), *_pattern_measures(), *_temporal_measures(now)]
    joined = (
        _per_wallet(edges, measures, min_transactions)
        .join(_active_days(edges), "wallet_address", "left")
        .join(_per_counterparty(edges), "wallet_address", "left")
    )
    return _with_basic_ratios(joined).select("wallet_address", "first_tx_time", "last_tx_time", *FEATURE_COLUMNS)


def all_features(
    staged: DataFrame,
    *,
    as_of: AsOf = None,
    min_transactions: int = MIN_TRANSACTIONS,
    feature_timestamp: Column | None = None,
) -> DataFrame:
    """The feature table: all features, missing ones filled with the median, stamped with time and version.

    The features are materialized once because the medians and the filled rows both read them.
    """
    combined = materialize(combined_features(staged, as_of=as_of, min_transactions=min_transactions))
    stamp = F.current_timestamp() if feature_timestamp is None else feature_timestamp
    return impute(combined, FEATURE_COLUMNS, strategy="median").select(
        "*", stamp.alias("feature_timestamp"), F.lit(FEATURE_VERSION).alias("feature_version")
    )


def feature_variant_notebook(staged: DataFrame, *, min_transactions: int = MIN_TRANSACTIONS) -> DataFrame:
    """Basic features only, gas price in gwei."""
    gwei = (F.col("avg_gas_price") / F.lit(L.WEI_PER_GWEI)).alias("avg_gas_price_gwei")
    basic = basic_features(staged, min_transactions=min_transactions)
    kept = [gwei if c == "avg_gas_price" else F.col(c) for c in BASIC_FEATURES]
    return basic.select("wallet_address", *kept)
