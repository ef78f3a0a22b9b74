"""Upserts and slowly changing rows as joins, and their write-back to partitioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.session import materialize


def _paired(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on unique keys, both rows kept as structs."""
    t = target.select(*keys, F.struct(*target.columns).alias("t"))
    s = source.select(*keys, F.struct(*source.columns).alias("s"))
    return t.join(s, list(keys), "full_outer")


def upsert_if_newer(
    target: DataFrame, source: DataFrame, keys: Sequence[str], version: str = "staged_at"
) -> DataFrame:
    """Replace a matched row only when the source version is newer; insert unmatched rows."""
    take_source = F.col("t").isNull() | (F.col(f"t.{version}") < F.col(f"s.{version}"))
    row = F.when(F.col("s").isNotNull() & F.coalesce(take_source, F.lit(False)), F.col("s")).otherwise(F.col("t"))
    return _paired(target, source.select(*target.columns), keys).select(row.alias("row")).select("row.*")


def upsert_replace(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows win; target rows without a match stay."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target unchanged, plus source rows with new keys."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"))


def upsert_columns(
    target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str], insert: bool = True
) -> DataFrame:
    """Overwrite only the listed columns of matched rows; insert unmatched rows unless told otherwise."""
    paired = _paired(target, source, keys)
    if not insert:
        paired = paired.filter("t IS NOT NULL")
    matched = F.col("t").isNotNull() & F.col("s").isNotNull()
    picked = []
    for name in target.columns:
        if name not in source.columns:
            picked.append(F.col(f"t.{name}").alias(name))
            continue
        from_source = (matched if name in columns else F.lit(False)) | F.col("t").isNull()
        picked.append(F.when(from_source, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name))
    return paired.select(*picked)


def scd2_expire(dim: DataFrame, staged: DataFrame, *, now: Column, null_safe: bool = False) -> DataFrame:
    """Close current rows whose balance, transaction count or type changed."""
    pairs = (
        ("current_balance_eth", "balance_eth"),
        ("total_transactions", "total_transactions"),
        ("wallet_type", "wallet_type"),
    )
    latest = staged.select("wallet_address", F.struct(*[s for _, s in pairs]).alias("_new"))
    joined = dim.join(latest, "wallet_address", "left")
    changed = F.lit(False)
    for old, new in pairs:
        same = F.col(old).eqNullSafe(F.col(f"_new.{new}")) if null_safe else F.col(old) == F.col(f"_new.{new}")
        changed = changed | F.coalesce(~same, F.lit(False))
    expire = F.col("is_current") & F.col("_new").isNotNull() & changed
    return (
        joined.withColumn("_expire", expire)
        .withColumn("is_current", F.col("is_current") & ~F.col("_expire"))
        .withColumn("valid_to", F.when(F.col("_expire"), now).otherwise(F.col("valid_to")))
        .withColumn("updated_at", F.when(F.col("_expire"), now).otherwise(F.col("updated_at")))
        .select(*dim.columns)
    )


def scd2_insert(dim: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows for wallets that have no current row."""
    current = dim.filter("is_current").select("wallet_address")
    return dim.unionByName(rows.join(current, "wallet_address", "left_anti").select(*dim.columns))


def incremental_since_watermark(
    source: DataFrame, target: DataFrame, source_time: str = "staged_at", target_time: str = "loaded_at"
) -> DataFrame:
    """Source rows newer than anything in the target; all of them when the target is empty."""
    mark = target.agg(F.max(target_time)).scalar()
    return source.filter(mark.isNull() | (F.col(source_time) > mark))


def incremental_lookback(
    source: DataFrame, target: DataFrame, days: int = 7, source_date: str = "transaction_date",
    target_date: str = "metric_date",
) -> DataFrame:
    """Source rows from `days` before the target's last date; all of them when the target is empty."""
    last = target.agg(F.max(target_date)).scalar()
    return source.filter(last.isNull() | (F.col(source_date) >= F.date_sub(last, days)))


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    """The hash bucket of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_key_index(table: DataFrame, path: str, keys: Sequence[str], partition: str, buckets: int = 512) -> None:
    """Where each key of a partitioned table is stored: keys and partition value, one folder for each hash bucket."""
    indexed = table.select(*keys, partition, F.lit(buckets).alias("buckets"), key_bucket(keys, buckets).alias("bucket"))
    (
        indexed.hint("rebalance", F.col("bucket"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "zstd")
        .partitionBy("buckets", "bucket")
        .parquet(path)
    )


def stored_keys(index: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index rows of the buckets that the source's keys fall into; other buckets are not listed or read."""
    buckets = index.agg(F.max("buckets")).first()[0]
    if buckets is None:
        return index
    # at most one value per bucket
    wanted = [row[0] for row in source.select(key_bucket(keys, buckets)).distinct().collect()]
    return index.filter((F.col("buckets") == buckets) & F.col("bucket").isin(wanted))


def merge_into_partitions(
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    partition: str,
    rule=upsert_replace,
    *,
    keys_move: bool = True,
    index: str | None = None,
    changed: str | None = None,
    **options,
) -> None:
    """Upsert into a partitioned table, rewriting only the partitions that change.

    A new version of a row may belong to another partition than the stored one. `index` (see `write_key_index`) finds
    those from the buckets of the source's keys and is kept up to date; without it the key columns of the whole table
    are read. `keys_move=False` skips both for keys that never change partition. `changed` names a table to which the
    values of the rewritten partitions are appended, for jobs that follow.

    The new content is written beside the table (`<path>_journal`) and complete before the table is touched. A run that
    ends in between leaves no key twice, and the next merge, or `finish_merge`, first completes it from there.
    """
    spark = source.sparkSession
    finish_merge(spark, path)
    target = spark.read.parquet(path).select(*source.columns)
    source = materialize(source)
    touched = source.select(partition)
    journal = f"{path}_journal"
    places = None
    if index is not None:
        places = stored_keys(spark.read.parquet(index), source, keys)
    if keys_move:
        known = target if places is None else places
        moved = known.select(*keys, partition).join(source.select(*keys), list(keys), "left_semi")
        touched = touched.unionByName(moved.select(partition))
    # at most one value per partition; as literals they prune the file listing
    values = [row[0] for row in touched.distinct().collect()]
    rows = rule(target.filter(is_one_of(F.col(partition), values)), source, keys, **options)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{journal}/rows")
    if places is not None:
        buckets = spark.read.parquet(index).agg(F.max("buckets")).first()[0] or 512
        merged = spark.read.parquet(f"{journal}/rows").select(*keys, partition)
        fresh = merged.join(source.select(*keys), list(keys), "left_semi")
        kept = places.select(*keys, partition).join(source.select(*keys), list(keys), "left_anti")
        located = kept.unionByName(fresh).select(
            "*", F.lit(buckets).alias("buckets"), key_bucket(keys, buckets).alias("bucket")
        )
        located.write.mode("overwrite").option("compression", "zstd").parquet(f"{journal}/keys")
    plan = spark.createDataFrame(
        [(partition, index, changed, values)],
        f"partition string, index string, changed string, values array<{target.schema[partition].dataType.simpleString()}>",
    )
    plan.coalesce(1).write.mode("overwrite").parquet(f"{journal}/plan")
    finish_merge(spark, path)


def folder_of(path: str, partition: str, value) -> str:
    return f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"


def is_one_of(value: Column, values: list) -> Column:
    known = [v for v in values if v is not None]
    found = value.isin(known) if known else F.lit(False)
    return found | value.isNull() if len(known) < len(values) else found


def finish_merge(spark: SparkSession, path: str) -> None:
    """Bring a journal that is complete into its table; every step may be repeated. An incomplete one is dropped.

    Partitions whose rows all moved elsewhere go before the others are written, so no key is ever stored twice.
    """
    journal = f"{path}_journal"
    if not exists(spark, f"{journal}/plan/_SUCCESS"):
        drop(spark, journal)
        return
    plan = spark.read.parquet(f"{journal}/plan").first().asDict()
    rows = spark.read.parquet(f"{journal}/rows")
    kind = rows.schema[plan["partition"]].dataType
    if plan["changed"] is not None:
        days = spark.createDataFrame([(v,) for v in plan["values"]], f"{plan['partition']} {kind.simpleString()}")
        days.write.mode("append").parquet(plan["changed"])
    left = {row[0] for row in rows.select(plan["partition"]).distinct().collect()}
    for value in set(plan["values"]) - left:
        drop(spark, folder_of(path, plan["partition"], value))
    _overwrite_partitions(rows, path, plan["partition"])
    if plan["index"] is not None:
        _overwrite_partitions(spark.read.parquet(f"{journal}/keys"), plan["index"], "buckets", "bucket")
    drop(spark, f"{journal}/plan")
    drop(spark, journal)


def _overwrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    (
        rows.hint("rebalance", *[F.col(c) for c in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(path)
    )


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table that `df` may read: written beside it, then moved; a run that ends in between can be finished."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}_next")
    finish_replacement(spark, path)


def finish_replacement(spark: SparkSession, path: str) -> None:
    if exists(spark, f"{path}_next/_SUCCESS"):
        drop(spark, path)
        move(spark, f"{path}_next", path)


def _location(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _location(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_location(spark, path))


def drop(spark: SparkSession, folder: str) -> None:
    _file_system(spark, folder).delete(_location(spark, folder), True)


def move(spark: SparkSession, folder: str, to: str) -> None:
    """Rename within a file system; `to` must not exist."""
    if not _file_system(spark, folder).rename(_location(spark, folder), _location(spark, to)):
        raise OSError(f"{folder} could not be moved to {to}")


def make_folder(spark: SparkSession, folder: str) -> None:
    _file_system(spark, folder).mkdirs(_location(spark, folder))
