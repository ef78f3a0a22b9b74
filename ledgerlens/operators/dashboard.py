"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import calendar as C
from ledgerlens.functions import ledger as L
from ledgerlens.functions import tiers as T
from ledgerlens.functions.stats import as_struct
from ledgerlens.operators.daily import wallet_presence
from ledgerlens.sources.tables import MONTH

AsOf = Column | DataFrame | str | None
FALLBACK_ETHER = 100


def _since(fact: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    """Rows of the last days."""
    today = F.to_date(L.point_in_time(as_of, fact, "transaction_timestamp"))
    return _from_day(fact, F.date_sub(today, days))


def _from_day(fact: DataFrame, start: Column) -> DataFrame:
    """Rows from a day on, filtered on the partition column: the date, or the month where the table is stored by month."""
    rows = fact.filter(F.col("transaction_date") >= start)
    return rows.filter(F.col(MONTH) >= F.trunc(start, "month")) if MONTH in fact.columns else rows


def _one_row(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row, as scalar subqueries."""
    spark = parts[0].sparkSession
    holder = spark.range(1).select(*[as_struct(p).alias(f"_{i}") for i, p in enumerate(parts)])
    return holder.select(*[F.col(f"_{i}.{c}").alias(c) for i, p in enumerate(parts) for c in p.columns])


def _presence_totals(fact: DataFrame) -> DataFrame:
    return wallet_presence(fact).agg(
        F.coalesce(F.sum("sent"), F.lit(0)).alias("unique_senders"),
        F.coalesce(F.sum("received"), F.lit(0)).alias("unique_receivers"),
    )


def dash_totals(fact: DataFrame) -> DataFrame:
    """Transfers, volume, average, last time, distinct senders and receivers."""
    totals = fact.agg(
        F.count("*").alias("total_transactions"),
        F.coalesce(L.ether_sum(F.col("value_wei")), F.lit(0.0)).alias("total_volume"),
        L.ether_avg(F.col("value_wei")).alias("avg_transaction_value"),
        F.max("transaction_timestamp").alias("last_transaction_time"),
    )
    return _one_row(totals, _presence_totals(fact))


def dash_wallet_count(wallets: DataFrame) -> DataFrame:
    return wallets.agg(F.count_distinct("wallet_address").alias("total_wallets"))


def dash_suspicious(scores: DataFrame) -> DataFrame:
    return scores.filter("is_suspicious").agg(
        F.count("*").alias("suspicious_count"), F.avg("fraud_score").alias("avg_fraud_score")
    )


def dash_daily_volume(fact: DataFrame, *, days: int = 30, as_of: AsOf = None) -> DataFrame:
    recent = _since(fact, as_of, days)
    volume = recent.groupBy(F.col("transaction_date").alias("date")).agg(
        F.count("*").alias("transaction_count"), L.ether_sum(F.col("value_wei")).alias("total_volume")
    )
    wallets = (
        wallet_presence(recent, "transaction_date")
        .groupBy(F.col("transaction_date").alias("date"))
        .agg(F.sum("sent").alias("unique_senders"), F.sum("received").alias("unique_receivers"))
    )
    return volume.join(wallets, "date", "left").fillna(0).orderBy(F.col("date").desc())


def dash_hourly_volume(fact: DataFrame, *, hours: int = 24, as_of: AsOf = None) -> DataFrame:
    now = L.point_in_time(as_of, fact, "transaction_timestamp")
    start = now - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    # the date filter prunes partitions, the time filter is exact
    recent = _from_day(fact, F.to_date(start)).filter(F.col("transaction_timestamp") >= start)
    hour = F.date_trunc("HOUR", "transaction_timestamp").alias("hour")
    return (
        recent.groupBy(hour)
        .agg(F.count("*").alias("transaction_count"), L.ether_sum(F.col("value_wei")).alias("total_volume"))
        .orderBy(F.col("hour").desc())
    )


def dash_weekly_volume(fact: DataFrame, *, weeks: int = 12, as_of: AsOf = None) -> DataFrame:
    """Per Sunday-based week; active wallets is senders plus receivers."""
    recent = _since(fact, as_of, weeks * 7).withColumn("week_start", C.week_start(F.col("transaction_date")))
    volume = recent.groupBy("week_start").agg(
        F.count("*").alias("transaction_count"), L.ether_sum(F.col("value_wei")).alias("total_volume")
    )
    wallets = wallet_presence(recent, "week_start").groupBy("week_start").agg(
        (F.sum("sent") + F.sum("received")).alias("active_wallets")
    )
    return volume.join(wallets, "week_start", "left").fillna(0).orderBy(F.col("week_start").desc())


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Wallets and percent of all wallets per score band, most severe first."""
    bands = scores.groupBy(T.risk_category(F.col("fraud_score")).alias("risk_category")).agg(
        F.count("*").alias("wallet_count")
    )
    everything = F.sum("wallet_count").over(Window.partitionBy())
    return bands.select(
        "risk_category", "wallet_count", F.round(F.col("wallet_count") * 100.0 / everything, 2).cast("double").alias("percentage")
    ).orderBy(T.severity(F.col("risk_category")))


def top_suspicious_by_volume(scores: DataFrame, *, limit: int = 10) -> DataFrame:
    return (
        scores.filter("is_suspicious")
        .select("wallet_address", "fraud_score", "tx_count", "total_value", "last_activity")
        .orderBy(F.col("total_value").desc(), "wallet_address")
        .limit(limit)
    )


def suspicious_fallback(tx: DataFrame, *, threshold: float = FALLBACK_ETHER) -> DataFrame:
    """Distinct senders with a large transfer, for ledgers without scores."""
    return tx.filter(F.col("value_eth") > threshold).agg(F.count_distinct("from_address").alias("suspicious_count"))


def dashboard_summary(tx: DataFrame, scores: DataFrame | None = None, *, as_of: AsOf = None) -> DataFrame:
    """Transfers, volume, wallets and suspicious wallets in one row."""
    totals = tx.agg(
        F.count("*").alias("total_transactions"),
        F.coalesce(L.ether_sum(F.col("value_wei")), F.lit(0.0)).alias("total_volume"),
    )
    wallets = wallet_presence(tx).agg(F.count("*").alias("total_wallets"))
    if scores is None:
        suspicious = suspicious_fallback(tx).withColumnRenamed("suspicious_count", "suspicious_wallet_count")
    else:
        suspicious = scores.agg(F.count_if(F.col("fraud_score") >= T.SUSPICIOUS_FROM).alias("suspicious_wallet_count"))
    now = L.point_in_time(as_of, tx, "transaction_timestamp")
    return _one_row(totals, wallets, suspicious).withColumn("last_updated", now)


# Fixed values.
CHANGE_METRICS = ("total_transactions", "total_value_eth", "unique_wallets")


def metric_with_change(daily: DataFrame, metrics: tuple[str, ...] = CHANGE_METRICS) -> DataFrame:
    """(date, metric, value, previous value, percent change) rows from the daily table."""
    long = daily.select("metric_date", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        "metric_date", list(metrics), "metric_name", "current_value"
    )
    previous = F.lag("current_value").over(Window.partitionBy("metric_name").orderBy("metric_date"))
    return long.withColumn("previous_value", previous).withColumn(
        "change_percentage",
        F.try_divide(F.col("current_value") - F.col("previous_value"), F.col("previous_value")) * 100,
    )
