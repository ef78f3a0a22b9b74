"""Daily metrics: counts, values, gas, wallets, peaks, trailing averages and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.functions.stats import discrete_quantiles

CONTEXT_ROWS = 30


def wallet_presence(fact: DataFrame, *by: str) -> DataFrame:
    """One row per wallet (and `by` columns) saying whether it sent and whether it received.

    One pass and one shuffle give distinct senders, receivers and wallets together; copies of a busy wallet collapse
    before the shuffle.
    """
    sides = F.array(
        F.struct(F.col("from_address").alias("wallet"), F.lit(1).alias("sent"), F.lit(0).alias("received")),
        F.struct(F.col("to_address").alias("wallet"), F.lit(0).alias("sent"), F.lit(1).alias("received")),
    )
    return (
        fact.select(*by, F.explode(sides).alias("side"))
        .select(*by, "side.*")
        .filter("wallet IS NOT NULL")
        .groupBy(*by, "wallet")
        .agg(F.max("sent").alias("sent"), F.max("received").alias("received"))
    )


def _hourly_counts() -> list[Column]:
    return [F.count_if(F.col("transaction_hour") == hour).alias(f"_h{hour}") for hour in range(24)]


def _peak_of_hours() -> list[Column]:
    counts = F.array(*[F.col(f"_h{hour}") for hour in range(24)])
    top = F.array_max(counts)
    return [
        (F.array_position(counts, top) - 1).cast("bigint").alias("peak_hour"),
        top.alias("peak_hour_transactions"),
    ]


def _measures() -> list[Column]:
    value = F.col("value_eth")
    return [
        F.count("*").alias("total_transactions"),
        F.count_if("is_successful").alias("successful_transactions"),
        F.count_if(~F.col("is_successful")).alias("failed_transactions"),
        F.count_if("is_value_transfer").alias("value_transfers"),
        F.count_if("is_contract_call").alias("contract_calls"),
        F.count_if("is_contract_creation").alias("contract_creations"),
        L.ether_sum(F.col("value_wei")).alias("total_value_eth"),
        L.ether_avg(F.col("value_wei")).alias("avg_value_eth"),
        F.max(value).alias("max_value_eth"),
        F.min(F.when(value > 0, value)).alias("min_value_eth"),
        F.count_if(value == 0).alias("zero_value_count"),
        F.count_if((value > 0) & (value < 0.001)).alias("micro_transaction_count"),
        F.count_if((value >= 0.001) & (value < 0.1)).alias("small_transaction_count"),
        F.count_if((value >= 0.1) & (value < 1)).alias("medium_transaction_count"),
        F.count_if((value >= 1) & (value < 10)).alias("large_transaction_count"),
        F.count_if(value >= 10).alias("whale_transaction_count"),
        F.sum("gas_used").alias("total_gas_used"),
        (F.sum("gas_used") / F.count("gas_used")).alias("avg_gas_used"),
        F.avg("gas_price_gwei").alias("avg_gas_price_gwei"),
        F.sum("gas_fee_eth").alias("total_gas_fees_eth"),
        F.avg("gas_efficiency").alias("avg_gas_efficiency"),
    ]


def _wallet_counts(fact: DataFrame) -> DataFrame:
    return (
        wallet_presence(fact, "transaction_date")
        .groupBy(F.col("transaction_date").alias("metric_date"))
        .agg(
            F.sum("sent").alias("unique_senders"),
            F.sum("received").alias("unique_receivers"),
            F.count("*").alias("unique_wallets"),
        )
    )


def daily_median(fact: DataFrame) -> DataFrame:
    """(metric_date, median_value_eth): the smallest value that half of the day's transfers do not exceed, exactly.

    Rounds of counting over all tasks; a day of any size is never brought together.
    """
    days = fact.select(F.col("transaction_date").alias("metric_date"), "value_eth")
    return discrete_quantiles(days, ["metric_date"], F.col("value_eth"), {"median_value_eth": 0.5})


def _with_median(stats: DataFrame, fact: DataFrame) -> DataFrame:
    median = daily_median(fact).withColumnRenamed("metric_date", "_day")
    joined = stats.join(median, stats["metric_date"].eqNullSafe(median["_day"]), "left").drop("_day")
    before = stats.columns.index("avg_value_eth") + 1
    return joined.select(*stats.columns[:before], "median_value_eth", *stats.columns[before:])


def _with_hours(fact: DataFrame) -> DataFrame:
    grouped = fact.groupBy(F.col("transaction_date").alias("metric_date")).agg(*_measures(), *_hourly_counts())
    stats = grouped.select(
        *[c for c in grouped.columns if not c.startswith("_h")],
        (F.col("total_transactions") / 24.0).alias("transactions_per_hour"),
        *_peak_of_hours(),
    )
    return _with_median(stats, fact)


def daily_stats(fact: DataFrame) -> DataFrame:
    """Counts, value and gas statistics and distinct senders/receivers per day."""
    wallets = _wallet_counts(fact).drop("unique_wallets")
    stats = _with_hours(fact).drop("peak_hour", "peak_hour_transactions")
    return stats.join(wallets, "metric_date", "left").fillna(0, ["unique_senders", "unique_receivers"])


def hourly_peak(fact: DataFrame) -> DataFrame:
    """Busiest hour per day; the earliest one on ties."""
    hours = fact.groupBy("transaction_date").agg(*_hourly_counts())
    return hours.select("transaction_date", *_peak_of_hours())


def daily_unique_wallets(fact: DataFrame) -> DataFrame:
    return _wallet_counts(fact).select(F.col("metric_date").alias("transaction_date"), "unique_wallets")


def new_wallets_daily(fact: DataFrame) -> DataFrame:
    """Wallets seen for the first time, per day."""
    return count_first_seen(first_seen(fact))


def moving_averages(daily: DataFrame) -> DataFrame:
    """7- and 30-row trailing averages; the input has one row per day, so one ordered task is enough."""
    by_date = Window.orderBy("metric_date")
    week, month = by_date.rowsBetween(-6, 0), by_date.rowsBetween(-29, 0)
    return daily.select(
        "*",
        F.avg("total_transactions").over(week).alias("tx_count_7d_avg"),
        F.avg("total_transactions").over(month).alias("tx_count_30d_avg"),
        F.avg("total_value_eth").over(week).alias("value_7d_avg"),
        F.avg("total_value_eth").over(month).alias("value_30d_avg"),
    )


def day_over_day(daily: DataFrame) -> DataFrame:
    """Percent change from the previous row for transfers, value and wallets."""
    by_date = Window.orderBy("metric_date")

    def change(name: str) -> Column:
        before = F.lag(name).over(by_date)
        return F.try_divide(F.col(name) - before, before) * 100

    return daily.select(
        "*",
        change("total_transactions").alias("tx_count_change_pct"),
        change("total_value_eth").alias("value_change_pct"),
        change("unique_wallets").alias("wallet_change_pct"),
    )


# Column order of the daily table.
DAILY_COLUMNS = (
    "metric_date", "total_transactions", "successful_transactions", "failed_transactions", "success_rate",
    "value_transfers", "contract_calls", "contract_creations", "total_value_eth", "avg_value_eth",
    "median_value_eth", "max_value_eth", "min_value_eth", "zero_value_count", "micro_transaction_count",
    "small_transaction_count", "medium_transaction_count", "large_transaction_count", "whale_transaction_count",
    "total_gas_used", "avg_gas_used", "avg_gas_price_gwei", "total_gas_fees_eth", "avg_gas_efficiency",
    "unique_senders", "unique_receivers", "unique_wallets", "new_wallets", "transactions_per_hour", "peak_hour",
    "peak_hour_transactions", "tx_count_7d_avg", "tx_count_30d_avg", "value_7d_avg", "value_30d_avg",
    "tx_count_change_pct", "value_change_pct", "wallet_change_pct",
)


def agg_daily_metrics(
    fact: DataFrame, *, new_wallets: DataFrame | None = None, loaded_at: Column | None = None
) -> DataFrame:
    """The daily metrics table.

    `new_wallets` (see `new_wallets_daily`) needs the whole history and is NULL when not given.
    """
    stamped = F.current_timestamp() if loaded_at is None else loaded_at
    return _finished(_base_metrics(fact), new_wallets).select(*DAILY_COLUMNS, stamped.alias("loaded_at"))


def _base_metrics(fact: DataFrame) -> DataFrame:
    """The measures that depend on the rows of one day only."""
    return (
        _with_hours(fact)
        .join(_wallet_counts(fact), "metric_date", "left")
        .fillna(0, ["unique_senders", "unique_receivers"])
        .withColumn("success_rate", F.try_divide("successful_transactions", "total_transactions"))
    )


def _finished(base: DataFrame, new_wallets: DataFrame | None) -> DataFrame:
    """Adds new wallets and what looks back over earlier days."""
    if new_wallets is None:
        daily = base.withColumn("new_wallets", F.lit(None).cast("bigint"))
    else:
        daily = base.join(new_wallets, "metric_date", "left").fillna(0, ["new_wallets"])
    return day_over_day(moving_averages(daily))


# Columns of the daily table that depend on other days, too.
ACROSS_DAYS = ("new_wallets",) + tuple(c for c in DAILY_COLUMNS if c.endswith(("_7d_avg", "_30d_avg", "_change_pct")))


def refresh_daily_metrics(
    metrics: DataFrame, fact: DataFrame, changed_days: list, new_wallets: DataFrame, *, loaded_at: Column | None = None
) -> DataFrame:
    """The daily table after some days changed: only their facts are read.

    Averages, changes and new wallets are made again for all rows, of which there is one a day, so a changed day reaches
    the days that look back on it. A changed day without facts disappears.
    """
    own = [c for c in DAILY_COLUMNS if c not in ACROSS_DAYS]
    stamped = F.current_timestamp() if loaded_at is None else loaded_at
    fresh = _base_metrics(fact.filter(F.col("transaction_date").isin(changed_days))).select(*own, stamped.alias("loaded_at"))
    kept = metrics.filter(~F.col("metric_date").isin(changed_days)).select(*own, "loaded_at")
    return _finished(kept.unionByName(fresh), new_wallets).select(*DAILY_COLUMNS, "loaded_at")


def first_seen(fact: DataFrame) -> DataFrame:
    """(wallet, first_date): the first day on which a wallet sent or received."""
    sides = F.explode(F.array("from_address", "to_address")).alias("wallet")
    return (
        fact.select("transaction_date", sides)
        .filter("wallet IS NOT NULL")
        .groupBy("wallet")
        .agg(F.min("transaction_date").alias("first_date"))
    )


def refresh_first_seen(seen: DataFrame, fact: DataFrame, changed_days: list) -> DataFrame:
    """The first-seen table after some days changed.

    The facts of these days give new and earlier dates. A stored date on a changed day counts only if the wallet is
    still there; wallets that lost it are looked up in all facts, a semi join on rarely more than a few rows.
    """
    now = first_seen(fact.filter(F.col("transaction_date").isin(changed_days))).withColumnRenamed("first_date", "now")
    both = seen.join(now, "wallet", "full_outer")
    stored, fresh = F.col("first_date"), F.col("now")
    lost = F.coalesce(stored.isin(changed_days) & (fresh.isNull() | (fresh > stored)), F.lit(False))
    found = both.filter(~lost).select("wallet", F.least(stored, fresh).alias("first_date"))
    searched = first_seen_of(fact, both.filter(lost).select("wallet"))
    return found.unionByName(searched)


def first_seen_of(fact: DataFrame, wallets: DataFrame) -> DataFrame:
    """First days of some wallets; one that is in no transfer has no row."""
    sides = F.explode(F.array("from_address", "to_address")).alias("wallet")
    rows = fact.select("transaction_date", sides).join(wallets, "wallet", "left_semi")
    return rows.groupBy("wallet").agg(F.min("transaction_date").alias("first_date"))


def count_first_seen(seen: DataFrame) -> DataFrame:
    return seen.groupBy(F.col("first_date").alias("metric_date")).agg(F.count("*").alias("new_wallets"))


def incremental_daily_metrics(fact: DataFrame, existing: DataFrame, *, days: int = 7, **options) -> DataFrame:
    """Recompute only the last days of the table.

    Averages and changes look back over rows, and days without transfers have none, so the facts are read from the 30th
    stored day before the slice.
    """
    first = F.date_sub(existing.agg(F.max("metric_date")).scalar(), days)
    earlier = existing.filter(F.col("metric_date") < first).select("metric_date").distinct()
    start = earlier.orderBy(F.col("metric_date").desc()).limit(CONTEXT_ROWS).agg(F.min("metric_date")).scalar()
    context = fact.filter(first.isNull() | (F.col("transaction_date") >= F.coalesce(start, first)))
    fresh = agg_daily_metrics(context, **options)
    return fresh.filter(first.isNull() | (F.col("metric_date") >= first))


def daily_metrics_recent(
    fact: DataFrame, *, days: int = 7, as_of: Column | DataFrame | str | None = None
) -> DataFrame:
    """Ten measures for the last days."""
    today = F.to_date(L.point_in_time(as_of, fact, "transaction_timestamp"))
    recent = fact.filter(F.col("transaction_date") >= F.date_sub(today, days))
    stats = recent.groupBy(F.col("transaction_date").alias("metric_date")).agg(
        F.count("*").alias("total_transactions"),
        F.count_if("is_successful").alias("successful_transactions"),
        L.ether_sum(F.col("value_wei")).alias("total_value_eth"),
        L.ether_avg(F.col("value_wei")).alias("avg_value_eth"),
        F.max("value_eth").alias("max_value_eth"),
        F.sum("gas_used").alias("total_gas_used"),
        (F.sum("gas_used") / F.count("gas_used")).alias("avg_gas_used"),
    )
    wallets = _wallet_counts(recent).drop("unique_wallets")
    return stats.join(wallets, "metric_date", "left").fillna(0, ["unique_senders", "unique_receivers"])
