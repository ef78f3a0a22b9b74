"""The daily batch: raw tables to facts, dimensions and metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import daily, marts, quality, staging, upserts
from ledgerlens.sources import tables, wallet_store
from ledgerlens.sources.tables import save_table, write_table


@dataclass(frozen=True)
class Paths:
    """Table folders below one root."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def run_daily(
    spark: SparkSession, raw_transactions: DataFrame, paths: Paths, *, now: Column | None = None, key_buckets: int = 512
) -> DataFrame:
    """Full load. Each layer is written with its layout and read back, so the next one prunes and pushes down.

    `key_buckets` is the number of folders of the key indexes, of some million keys each. Returns the quality report;
    like the checks it holds, it does not stop the load.
    """
    moment = F.current_timestamp() if now is None else now
    # in ranges of days before columns are derived, which make a row half as wide again
    layout = [c for columns in tables.LAYOUT["stg_transactions"] for c in columns]
    newest = staging.stage_transactions(raw_transactions, staged_at=moment, deal=lambda rows: tables.in_ranges(rows, *layout))
    write_table(newest, paths.table("stg_transactions"), "stg_transactions", dealt=True)
    staged = spark.read.parquet(paths.table("stg_transactions"))

    # staged files are parted by the same date and sorted by address, so facts need not be moved
    facts = marts.fact_transactions(staged, loaded_at=moment)
    write_table(facts, paths.table("fact_transactions"), "fact_transactions", dealt=True)
    fact = spark.read.parquet(paths.table("fact_transactions"))

    upserts.write_key_index(staged, paths.table("stg_transactions_keys"), ["transaction_id"], "transaction_date", key_buckets)
    upserts.write_key_index(fact, paths.table("fact_transactions_keys"), ["transaction_key"], "transaction_date", key_buckets)

    save_table(daily.first_seen(fact), paths.table("wallet_first_seen"))
    seen = spark.read.parquet(paths.table("wallet_first_seen"))
    metrics = daily.agg_daily_metrics(fact, new_wallets=daily.count_first_seen(seen), loaded_at=moment)
    save_table(metrics, paths.table("agg_daily_metrics"))
    return quality.quality_report(quality.staging_checks(staged, moment))


def build_wallet_store(
    spark: SparkSession, paths: Paths, *, unit: str = "month", rows_per_bucket: int = wallet_store.ROWS_PER_BUCKET
) -> None:
    """Store the fact's transfers by wallet; from then on the incremental job keeps them up to date."""
    fact = spark.read.parquet(paths.table("fact_transactions"))
    wallet_store.build_store(fact, paths.table("wallet_transfers"), unit=unit, rows_per_bucket=rows_per_bucket)


def run_wallets(spark: SparkSession, raw_wallets: DataFrame, paths: Paths, *, now: Column | None = None) -> None:
    """Stage wallets and load the first version of the wallet dimension."""
    moment = F.current_timestamp() if now is None else now
    write_table(staging.stage_wallets(raw_wallets, staged_at=moment), paths.table("stg_wallets"), "stg_wallets")
    staged = spark.read.parquet(paths.table("stg_wallets"))
    dim = marts.dim_wallet(staged, today=F.to_date(moment), now=moment)
    write_table(dim, paths.table("dim_wallet"), "dim_wallet")


def update_wallets(spark: SparkSession, raw_wallets: DataFrame, paths: Paths, *, now: Column | None = None) -> None:
    """Bring new states of wallets into the staged table and the dimension, which keeps the versions they replace.

    Of a wallet that comes more than once the latest state counts. The dimension takes up all wallets staged since its
    last change, so an update that was cut off after staging is made up for by the next one; `now` must not go back.
    Both tables have a row a wallet or version and are written anew beside the old ones; only wallets of this update
    reach the comparison of versions. Without a stored dimension this is `run_wallets`.
    """
    stg_path, dim_path = paths.table("stg_wallets"), paths.table("dim_wallet")
    upserts.finish_replacement(spark, stg_path)
    upserts.finish_replacement(spark, dim_path)
    if not upserts.exists(spark, f"{dim_path}/_SUCCESS"):
        run_wallets(spark, raw_wallets, paths, now=now)
        return
    moment = F.current_timestamp() if now is None else now
    stored = spark.read.parquet(stg_path)
    fresh = staging.stage_wallets(raw_wallets, staged_at=moment).select(*stored.columns)
    upserts.replace_table(upserts.upsert_if_newer(stored, fresh, ["wallet_id"]), stg_path)

    dim = spark.read.parquet(dim_path)
    # versions are written at the time of staging, so anything staged later has not been compared yet
    changed = upserts.incremental_since_watermark(spark.read.parquet(stg_path), dim, "staged_at", "updated_at")
    closed = upserts.scd2_expire(dim, changed, now=moment)
    opened = marts.dim_wallet(changed, today=F.to_date(moment), now=moment)
    upserts.replace_table(upserts.scd2_insert(closed, opened), dim_path)


def run_incremental(
    spark: SparkSession,
    new_raw: DataFrame,
    paths: Paths,
    *,
    now: Column | None = None,
    stable_dates: bool = False,
    rows_per_bucket: int = wallet_store.ROWS_PER_BUCKET,
) -> None:
    """Bring new raw rows into an existing warehouse, rewriting only the days they touch, then refresh the metrics.

    `stable_dates` promises that a transaction never changes its date, which saves looking up the stored keys. A run
    that was cut off is completed by the next one, also by one without new rows.
    """
    moment = F.current_timestamp() if now is None else now
    staged_path, fact_path = paths.table("stg_transactions"), paths.table("fact_transactions")
    rule, date, moving = upserts.upsert_if_newer, "transaction_date", not stable_dates
    # the fact of a cut-off run has its later loading times only when complete
    upserts.finish_merge(spark, staged_path)
    upserts.finish_merge(spark, fact_path)
    staged = staging.stage_transactions(new_raw, staged_at=moment)
    upserts.merge_into_partitions(
        staged_path, staged, ["transaction_id"], date, rule, keys_move=moving, index=paths.table("stg_transactions_keys")
    )
    stored = spark.read.parquet(fact_path)
    fresh = upserts.incremental_since_watermark(spark.read.parquet(staged_path), stored)
    facts = marts.fact_transactions(fresh, loaded_at=moment).select(*stored.columns)
    upserts.merge_into_partitions(
        fact_path, facts, ["transaction_key"], date, rule, version="loaded_at", keys_move=moving,
        index=paths.table("fact_transactions_keys"), changed=paths.table("changed_days"),
    )
    refresh_metrics(spark, paths, now=moment, rows_per_bucket=rows_per_bucket)


def refresh_metrics(
    spark: SparkSession, paths: Paths, *, now: Column | None = None, rows_per_bucket: int = wallet_store.ROWS_PER_BUCKET
) -> None:
    """Daily metrics, first-seen dates and, where it was built, the wallet store for the days that merges have changed
    since the last refresh.

    The list of days goes last, so a run that was cut off is done again, with the same result.
    """
    seen_path, metrics_path, changed_path = map(paths.table, ("wallet_first_seen", "agg_daily_metrics", "changed_days"))
    upserts.finish_replacement(spark, seen_path)
    upserts.finish_replacement(spark, metrics_path)
    if not upserts.exists(spark, changed_path):
        return
    # one value a day
    changed = [row[0] for row in spark.read.parquet(changed_path).distinct().collect()]
    days = [day for day in changed if day is not None]
    fact = spark.read.parquet(paths.table("fact_transactions"))
    if upserts.exists(spark, paths.table("wallet_transfers")):
        wallet_store.refresh_store(fact, paths.table("wallet_transfers"), changed, rows_per_bucket=rows_per_bucket)
    upserts.replace_table(daily.refresh_first_seen(spark.read.parquet(seen_path), fact, days), seen_path)
    new_wallets = daily.count_first_seen(spark.read.parquet(seen_path))
    metrics = daily.refresh_daily_metrics(spark.read.parquet(metrics_path), fact, days, new_wallets, loaded_at=now)
    upserts.replace_table(metrics, metrics_path)
    upserts.drop(spark, changed_path)
