"""Transfers stored by wallet, so that a lookup of one wallet reads one bucket of each period.

Layout: `unit=<month|quarter|year>/period=<first day>/buckets=<n>/bucket=<hash of the wallet modulo n>`. A period has as
many buckets as its rows need, so the number grows with the ledger and need not be known by readers: the bucket of a
wallet is a condition on folder names alone. Rows are dealt by period, sorted by folder, wallet and time; a period of many
rows is dealt to many tasks, each of which writes to its folders, so a busy wallet is split over many files, of which a
reader skips row groups by wallet and date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.operators import upserts
from ledgerlens.operators.staging import wallet_edges
from ledgerlens.sources.tables import ROWS_PER_FILE

UNITS = ("month", "quarter", "year")
ROWS_PER_BUCKET = 4_000_000
MOST_BUCKETS = 32
SIDES_PER_TASK = 500_000
CARRIED = (
    "transaction_hash", "block_number", "transaction_timestamp", "transaction_date", "value_wei", "value_eth", "gas_used",
    "gas_fee_eth",
)
PLACE = ("unit", "period", "buckets", "bucket")
ORDER = (*PLACE, "wallet_address", "transaction_timestamp")


def _bucket(wallet: Column) -> Column:
    return F.pmod(F.xxhash64(wallet), F.col("buckets")).cast("int")


def _sizes(fact: DataFrame, unit: str) -> list[tuple[dt.date | None, int]]:
    """Both sides of every transfer counted by period: one row a period; an unknown date is a period of its own."""
    sides = wallet_edges(fact, "transaction_date").groupBy(F.trunc("transaction_date", unit).alias("period"))
    return [(row.period, row.n) for row in sides.agg(F.count("*").alias("n")).collect()]


def _parts(sizes: list[tuple[dt.date | None, int]], rows: int, most: int | None = None) -> Column:
    """Into how many parts of some rows the `period` of a row is cut."""
    parts = F.lit(1)
    for period, n in sizes:
        number = min(-(-n // rows), most or n)
        if number > 1:
            parts = F.when(F.col("period").eqNullSafe(F.lit(period)), number).otherwise(parts)
    return parts


def _in_folders(sides: DataFrame, unit: str, buckets: Column, wallet: Column) -> DataFrame:
    dated = sides.withColumn("unit", F.lit(unit)).withColumn("period", F.trunc("transaction_date", unit))
    return dated.withColumn("buckets", buckets).withColumn("bucket", _bucket(wallet))


def _placed(fact: DataFrame, unit: str, rows_per_bucket: int) -> DataFrame:
    """Both sides of every transfer with their folder."""
    buckets = _parts(_sizes(fact, unit), rows_per_bucket, MOST_BUCKETS)
    return _in_folders(wallet_edges(fact, *CARRIED), unit, buckets, F.col("wallet_address"))


def _tasks(sizes: list[tuple[dt.date | None, int]]) -> tuple[Column, int]:
    """The task that writes a transfer, and the number of tasks: neighbouring periods of few rows share one, a period of
    many rows is dealt to as many as keep what one of them sorts bounded."""
    dealt, number, room = {}, 0, 0
    for period, n in sorted(sizes, key=lambda s: (s[0] is None, s[0])):
        parts = -(-n // SIDES_PER_TASK)
        if parts > 1 or n > room:
            dealt[period], number, room = (number, parts), number + parts, SIDES_PER_TASK - n if parts == 1 else 0
        else:
            dealt[period], room = (number - 1, 1), room - n

    def shares(first: int, parts: int) -> Column:
        return F.struct(F.lit(first).alias("first"), F.lit(parts).alias("parts"))

    # looked up, so that the period of a row is made once
    dates = [c for period, share in dealt.items() if period is not None for c in (F.lit(period), shares(*share))]
    none = shares(*dealt.get(None, (0, 1)))
    share = F.coalesce(F.try_element_at(F.create_map(*dates), F.col("period")), none) if dates else none
    key = F.xxhash64("transaction_hash", "from_address", "to_address")
    return share["first"] + F.pmod(key, share["parts"]).cast("int"), max(1, number)


def _slim(fact: DataFrame, unit: str, task: Column) -> DataFrame:
    """Transfers as they are shuffled: once for both sides, texts as bytes, without the amount that follows from another."""
    in_ether = F.col("value_eth").eqNullSafe(L.wei_to_ether(F.col("value_wei")))
    return fact.withColumn("period", F.trunc("transaction_date", unit)).select(
        task.cast("int").alias("_task"),
        in_ether.alias("_in_ether"),
        F.when(~in_ether, F.col("value_eth")).alias("value_eth"),
        *[L.pack_text(F.col(c)).alias(c) for c in ("from_address", "to_address", "transaction_hash")],
        *[c for c in CARRIED if c not in ("value_eth", "transaction_hash")],
    )


def _write(fact: DataFrame, unit: str, rows_per_bucket: int, path: str) -> None:
    """Both sides are made after the shuffle, sorted as bytes and written as text."""
    sizes = _sizes(fact, unit)
    buckets = _parts(sizes, rows_per_bucket, MOST_BUCKETS)
    task, tasks = _tasks(sizes)
    # a fixed number: adaptive execution would join tasks by the bytes shuffled, which the sides take many times
    dealt = _slim(fact, unit, task).repartitionById(tasks, "_task")
    sides = _in_folders(wallet_edges(dealt, "_in_ether", *CARRIED), unit, buckets, L.unpack_text(F.col("wallet_address")))
    ether = F.when(F.col("_in_ether"), L.wei_to_ether(F.col("value_wei"))).otherwise(F.col("value_eth"))
    texts = {c: L.unpack_text(F.col(c)) for c in ("wallet_address", "counterparty", "transaction_hash")}
    (
        sides.sortWithinPartitions(*ORDER)
        .withColumns({**texts, "value_eth": ether})
        .drop("_in_ether")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("compression", "zstd")
        .partitionBy(*PLACE)
        .parquet(path)
    )


def build_store(fact: DataFrame, path: str, *, unit: str = "month", rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Store all transfers of a fact table, replacing what the path held. Reads the fact twice (sizes, rows)."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    spark = fact.sparkSession
    upserts.drop(spark, f"{path}_next")
    # the schema beside the table also serves an empty one, and spares readers the search for it
    empty = fact.limit(0)
    _in_folders(wallet_edges(empty, *CARRIED), unit, F.lit(1), F.col("wallet_address")).coalesce(1).write.mode("overwrite").parquet(f"{path}_schema")
    _write(fact, unit, rows_per_bucket, path)
    upserts.make_folder(spark, f"{path}/unit={unit}")


def refresh_store(
    fact: DataFrame, path: str, days: Sequence[dt.date | None], *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> None:
    """Make the periods of the changed days again from the fact; other periods are neither read nor written.

    The new content is complete in `<path>_next` before a period is replaced. A refresh that was cut off is completed by
    the next one or by `finish_refresh`; until then a period can be missing, but none is there twice.
    """
    spark = fact.sparkSession
    finish_refresh(spark, path)
    unit = next(u for u in UNITS if upserts.exists(spark, f"{path}/unit={u}"))
    if not days:
        return
    dates = spark.createDataFrame([(day,) for day in days], "day date")
    periods = [row[0] for row in dates.select(F.trunc("day", unit)).distinct().collect()]
    changed = fact.filter(upserts.is_one_of(F.trunc("transaction_date", unit), periods))
    _write(changed, unit, rows_per_bucket, f"{path}_next/rows")
    plan = [(unit, p, upserts.exists(spark, _folder(f"{path}_next/rows", unit, p))) for p in periods]
    listed = spark.createDataFrame(plan, "unit string, period date, filled boolean")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}_next/plan")
    finish_refresh(spark, path)


def _folder(path: str, unit: str, period: dt.date | None) -> str:
    return upserts.folder_of(f"{path}/unit={unit}", "period", period)


def finish_refresh(spark: SparkSession, path: str) -> None:
    """Move periods that are complete into the store; every step may be repeated. An incomplete refresh is dropped."""
    if not upserts.exists(spark, f"{path}_next/plan/_SUCCESS"):
        upserts.drop(spark, f"{path}_next")
        return
    for unit, period, filled in spark.read.parquet(f"{path}_next/plan").collect():
        ready, stored = _folder(f"{path}_next/rows", unit, period), _folder(path, unit, period)
        # a filled period without its folder has been moved by the run that was cut off
        if not filled:
            upserts.drop(spark, stored)
        elif upserts.exists(spark, ready):
            upserts.drop(spark, stored)
            upserts.move(spark, ready, stored)
    upserts.drop(spark, f"{path}_next/plan")
    upserts.drop(spark, f"{path}_next")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store as a table; its folders are listed here, once for all lookups made with it."""
    return spark.read.schema(spark.read.parquet(f"{path}_schema").schema).parquet(path)


def wallet_transfers(store: DataFrame, address: str, *, since: Column | None = None) -> DataFrame:
    """Transfers of one wallet in the shape of the fact, for the queries of `operators.wallets`.

    Reads the wallet's bucket of each period, with `since` (a date) only of the periods from there on. A transfer to
    itself is one row. Those queries take "now" from these rows, that is from the wallet's own last transfer, unless
    they are given `as_of`.
    """
    wanted = F.lit(address.lower().strip())
    rows = store.filter((F.col("bucket") == _bucket(wanted)) & (F.col("wallet_address") == wanted))
    if since is not None:
        rows = rows.filter(F.col("transaction_date") >= since)
        for unit in UNITS:
            # conditions on folder names only
            rows = rows.filter((F.col("unit") != unit) | (F.col("period") >= F.trunc(since, unit)))
    out = F.col("direction") == "out"
    to_itself = F.coalesce(F.col("counterparty") == F.col("wallet_address"), F.lit(False))
    return rows.filter(out | ~to_itself).select(
        F.when(out, F.col("wallet_address")).otherwise(F.col("counterparty")).alias("from_address"),
        F.when(out, F.col("counterparty")).otherwise(F.col("wallet_address")).alias("to_address"),
        *CARRIED,
    )


def wallet_sides(store: DataFrame) -> DataFrame:
    """Transfers, amount and times of every wallet and direction."""
    return store.groupBy("wallet_address", "direction").agg(
        F.count("*").alias("transfers"),
        L.wei_sum(F.col("value_wei")).alias("total_wei"),
        F.min("transaction_timestamp").alias("first_time"),
        F.max("transaction_timestamp").alias("last_time"),
        F.count("counterparty").alias("known_counterparties"),
    )
