"""Writing and reading the engine's own tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L

# Partition and sort columns per table.
LAYOUT: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "raw_transactions": (("ingest_date",), ()),
    "raw_wallets": (("ingest_date",), ()),
    "stg_transactions": (("transaction_date",), ("from_address", "to_address")),
    "stg_wallets": ((), ("wallet_address",)),
    "fact_transactions": (("transaction_date",), ("from_address", "to_address", "transaction_type")),
    "dashboard_transfers": (("transaction_date",), ("from_address", "to_address")),
    "dim_wallet": ((), ("wallet_address", "wallet_type")),
    "dim_wallet_summary": ((), ("wallet_address",)),
    "agg_daily_metrics": (("metric_date",), ()),
    "wallet_fraud_scores": ((), ("wallet_address", "is_suspicious")),
}
ROWS_PER_FILE = 20_000_000
MONTH = "transaction_month"


def write_table(df: DataFrame, path: str, table: str, mode: str = "overwrite", *, by_month: bool = False, dealt: bool = False) -> None:
    """Write with the table's declared layout.

    `by_month` stores a table that is partitioned by `transaction_date` in folders of the column `transaction_month`,
    sorted by date: for ledgers with few rows a day, of which a folder for each day would make small files. `dealt` says
    that rows come dealt by the partition column, as when columns that follow from others were added after that, or when
    they are read from a table with the same partitions; they are sorted in each task, not moved.

    Sorted tables are split into ranges of partition and sort columns: a task writes neighbouring days, and a day that
    holds a large share of the rows is dealt to many tasks, by address. Ranges are found by making the rows twice. The
    others, and folders by month, which are few, are rebalanced by partition value: a month of many rows is dealt to many
    tasks, and rows are made once. Sorting inside a task lets readers skip row groups by address.
    """
    partition_by, sort_by = LAYOUT.get(table, ((), ()))
    if by_month:
        df = df.withColumn(MONTH, F.trunc("transaction_date", "month"))
        partition_by, sort_by = (MONTH,), ("transaction_date", *sort_by)
    laid_out = df
    if by_month:
        laid_out = (df if dealt else df.hint("rebalance", F.col(MONTH))).sortWithinPartitions(*partition_by, *sort_by)
    elif sort_by:
        laid_out = (df if dealt else in_ranges(df, *partition_by, *sort_by)).sortWithinPartitions(*partition_by, *sort_by)
    elif partition_by:
        laid_out = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = (
        laid_out.write.mode(mode)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("compression", "zstd")
        # a full load leaves no old partitions behind
        .option("partitionOverwriteMode", "static")
    )
    writer.partitionBy(*partition_by).parquet(path)


def in_ranges(df: DataFrame, *by: str) -> DataFrame:
    """As many ranges of some columns as the session has shuffle partitions; rows that tie are split by their hash.

    The number is fixed, because adaptive execution would join tasks by bytes alone, however many folders they write.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(tasks, *by, F.xxhash64(*df.columns))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def append_partitioned(df: DataFrame, path: str, time_column: str = "ingested_at") -> None:
    """Append, creating the table when missing, partitioned by the day of `time_column`."""
    dated = df.withColumn("ingest_date", F.to_date(time_column))
    write_table(dated, path, "raw_transactions", mode="append")


def save_table(df: DataFrame, path: str, append: bool = False) -> None:
    """Replace or extend a feature or score table."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def load_features(features: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """Projection of the feature table, newest first."""
    ordered = features.select("wallet_address", *columns, "feature_timestamp").orderBy(
        F.col("feature_timestamp").desc(), "wallet_address"
    )
    return ordered if limit is None else ordered.limit(limit)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table; size in MB for tables read from files."""
    counts = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        counts = row if counts is None else counts.unionByName(row)
    return counts


def file_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Stored size in MB per table path, from file metadata only."""
    sizes = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        row = files.agg(F.lit(name).alias("table_name"), F.round(F.sum("length") / 1024 / 1024, 2).alias("size_mb"))
        sizes = row if sizes is None else sizes.unionByName(row)
    return sizes


def append_checkpoint(path: str, entries: DataFrame) -> None:
    """Append (pipeline_name, checkpoint_key, checkpoint_value, updated_at) rows to the log."""
    entries.write.mode("append").parquet(path)


def checkpoint_entries(df: DataFrame, pipeline: str, key: Column, value: Column, updated_at: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(pipeline).alias("pipeline_name"),
        key.cast("string").alias("checkpoint_key"),
        value.cast("string").alias("checkpoint_value"),
        (F.current_timestamp() if updated_at is None else updated_at).alias("updated_at"),
    )


def get_checkpoint(log: DataFrame, pipeline: str | None = None, key: str | None = None) -> DataFrame:
    """Latest value per (pipeline, key)."""
    wanted = log
    if pipeline is not None:
        wanted = wanted.filter(F.col("pipeline_name") == pipeline)
    if key is not None:
        wanted = wanted.filter(F.col("checkpoint_key") == key)
    latest = F.max(F.struct("updated_at", "checkpoint_value")).alias("latest")
    return wanted.groupBy("pipeline_name", "checkpoint_key").agg(latest).select(
        "pipeline_name", "checkpoint_key", F.col("latest.checkpoint_value").alias("checkpoint_value")
    )


def checkpoint_or_default(log: DataFrame, wanted: DataFrame, default: str) -> DataFrame:
    """As `get_checkpoint` for every wanted (pipeline_name, checkpoint_key), `default` where none was logged."""
    keys = ["pipeline_name", "checkpoint_key"]
    found = wanted.select(*keys).distinct().join(get_checkpoint(log), keys, "left")
    return found.withColumn("checkpoint_value", F.coalesce("checkpoint_value", F.lit(default)))


def resume_start_block(seen: DataFrame, addresses: DataFrame) -> DataFrame:
    """Per listed address: last block seen + 1, or 0; also the new checkpoint value (highest block seen)."""
    highest = seen.groupBy("address").agg(F.max("block_number").alias("last_block"))
    return addresses.select("address").distinct().join(highest, "address", "left").select(
        "address",
        F.coalesce(F.col("last_block") + 1, F.lit(0)).cast("bigint").alias("start_block"),
        F.col("last_block").alias("checkpoint_block"),
    )


def max_value(df: DataFrame, column: str, default: object) -> DataFrame:
    """High-water mark of a column, or the default for an empty table."""
    kind = df.schema[column].dataType
    return df.agg(F.coalesce(F.max(column), F.lit(default).cast(kind)).alias("max_value"))


def label_lookup(wallets: DataFrame, exchanges: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Fill is_exchange, entity name and category from label tables (wallet_address, entity_name, entity_category)."""
    def labels(df: DataFrame, exchange: bool) -> DataFrame:
        return df.select(
            L.normalize_address(F.col("wallet_address")).alias("wallet_address"),
            "entity_name",
            "entity_category",
            F.lit(exchange).alias("known_exchange"),
        )

    known = labels(exchanges, True)
    if contracts is not None:
        known = known.unionByName(labels(contracts, False))
    one_each = known.groupBy("wallet_address").agg(
        F.max(F.struct("known_exchange", "entity_name", "entity_category")).alias("label")
    )
    return (
        wallets.drop("is_exchange", "is_known_entity", "entity_name", "entity_category")
        .join(one_each, "wallet_address", "left")
        .withColumn("is_exchange", F.coalesce("label.known_exchange", F.lit(False)))
        .withColumn("is_known_entity", F.col("label").isNotNull())
        .withColumn("entity_name", F.col("label.entity_name"))
        .withColumn("entity_category", F.col("label.entity_category"))
        .drop("label")
    )
