"""Transfers stored by wallet: what a lookup reads, refreshed periods, and refreshes that are cut off."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dashboard, upserts, wallets
from ledgerlens.plans import daily as job
from ledgerlens.session import new_path
from ledgerlens.sources import wallet_store as store
from ledgerlens.sources.tables import write_table

FACT = (
    "transaction_hash string, block_number bigint, transaction_timestamp timestamp_ntz, transaction_date date, "
    "from_address string, to_address string, value_wei decimal(38,0), value_eth double, gas_used bigint, gas_fee_eth double"
)


def transfers(spark, body):
    """Rows (number, day or None, sender, receiver)."""
    rows = []
    for number, day, sender, receiver in body:
        time = None if day is None else dt.datetime.fromisoformat(day) + dt.timedelta(seconds=number)
        rows.append((f"h{number}", number, time, time and time.date(), sender, receiver, Decimal(number * 10**18), float(number), 1, 0.5))
    return spark.createDataFrame(rows, FACT)


def ledger(spark, extra=()):
    body = [(i, f"2020-{1 + i % 8:02}-{1 + i % 28:02}", "hot" if i % 3 == 0 else f"w{i % 11}", f"w{i % 7}") for i in range(300)]
    body += [(301, None, "w1", "w2"), (302, "2020-03-03", "w1", None), (303, "2020-03-03", "w5", "w5")]
    return transfers(spark, [*body, *extra])


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def touching(fact, wallet):
    return fact.filter((F.col("from_address") == wallet) | (F.col("to_address") == wallet))


@pytest.fixture
def path(spark):
    return new_path(spark, "wallets")


@pytest.mark.parametrize("unit", store.UNITS)
def test_lookup_equals_a_filter_of_the_fact(spark, path, unit):
    fact = ledger(spark)
    store.build_store(fact, path, unit=unit, rows_per_bucket=10)
    opened = store.open_store(spark, path)
    assert opened.count() == 2 * 303 - 1
    for wallet in ("hot", "w1", "w5", "nobody"):
        found = store.wallet_transfers(opened, f" {wallet.upper()} ")
        assert rows(found) == rows(touching(fact, wallet).select(*found.columns))
        assert rows(wallets.wallet_stats(found, wallet)) == rows(wallets.wallet_stats(fact, wallet))
    since = F.lit("2020-04-15").cast("date")
    found = store.wallet_transfers(opened, "hot", since=since)
    assert rows(found) == rows(touching(fact, "hot").filter(F.col("transaction_date") >= since).select(*found.columns))


def test_lookup_reads_one_bucket_of_each_period(spark, path):
    store.build_store(ledger(spark), path, rows_per_bucket=10)
    opened = store.open_store(spark, path)
    found = store.wallet_transfers(opened, "hot", since=F.lit("2020-05-01").cast("date"))
    plan = found._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    scan = plan.collectLeaves().head()
    filters = scan.partitionFilters().mkString(" ")
    assert all(name in filters for name in ("bucket", "buckets", "period"))
    # May to August, one bucket each
    assert scan.metrics().apply("numPartitions").value() == 4
    assert scan.metrics().apply("numFiles").value() < len(opened.inputFiles()) / 4


def test_empty_ledger_and_its_first_rows(spark, path):
    nothing = transfers(spark, [])
    store.build_store(nothing, path)
    assert store.wallet_transfers(store.open_store(spark, path), "hot").count() == 0
    fact = ledger(spark)
    days = [row[0] for row in fact.select("transaction_date").distinct().collect()]
    store.refresh_store(fact, path, days, rows_per_bucket=10)
    assert store.open_store(spark, path).count() == 2 * 303 - 1


def changed(spark):
    """A ledger that lost all of May and its undated row, and won rows in March and in a new month."""
    late = [(400, "2020-03-09", "hot", "w3"), (401, "2021-01-01", "w9", "hot")]
    fact = ledger(spark, late).filter("month(transaction_date) <> 5")
    days = [dt.date(2020, 5, d) for d in range(1, 29)] + [dt.date(2020, 3, 9), dt.date(2021, 1, 1), None]
    return fact, days


def sides_of(spark, path):
    return rows(store.wallet_sides(store.open_store(spark, path)))


def test_refresh_equals_a_new_store(spark, path):
    store.build_store(ledger(spark), path, rows_per_bucket=10)
    before = {f for f in store.open_store(spark, path).inputFiles()}
    fact, days = changed(spark)
    store.refresh_store(fact, path, days, rows_per_bucket=10)
    store.build_store(fact, f"{path}-new", rows_per_bucket=10)
    assert sides_of(spark, path) == sides_of(spark, f"{path}-new")
    after = {f for f in store.open_store(spark, path).inputFiles()}
    kept = {f for f in before if any(f"period=2020-0{m}-" in f for m in (1, 2, 4, 6, 7, 8))}
    assert kept and kept <= after
    store.refresh_store(fact, path, [], rows_per_bucket=10)
    assert sides_of(spark, path) == sides_of(spark, f"{path}-new")


@pytest.mark.parametrize("stop_at, calls", [("move", 0), ("move", 1), ("drop", 1), ("drop", 3), ("drop", 4)])
def test_a_refresh_that_is_cut_off_is_completed(spark, path, monkeypatch, stop_at, calls):
    store.build_store(ledger(spark), path, rows_per_bucket=10)
    fact, days = changed(spark)
    real, seen = getattr(upserts, stop_at), []

    def breaks(*args):
        if len(seen) == calls:
            raise RuntimeError("cut off")
        seen.append(args)
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(upserts, stop_at, breaks)
        with pytest.raises(RuntimeError):
            store.refresh_store(fact, path, days, rows_per_bucket=10)
    hashes = store.open_store(spark, path).groupBy("wallet_address", "direction", "transaction_hash").count()
    assert hashes.filter("count > 1").count() == 0
    store.refresh_store(fact, path, [], rows_per_bucket=10)
    store.build_store(fact, f"{path}-new", rows_per_bucket=10)
    assert sides_of(spark, path) == sides_of(spark, f"{path}-new")


def test_incremental_job_keeps_the_store(spark, views):
    """A load of one quarter, the store, then the next days and later versions of old rows."""
    raw = views.raw_transactions.filter("transaction_timestamp < '1995-05-01'")
    first = raw.filter("transaction_timestamp < '1995-04-20'")
    paths = job.Paths(new_path(spark, "warehouse"))
    now = F.lit("2002-01-01").cast("timestamp_ntz")
    job.run_daily(spark, first, paths, now=now, key_buckets=4)
    job.build_wallet_store(spark, paths, rows_per_bucket=20)
    moved = first.limit(3).withColumn("transaction_timestamp", F.expr("transaction_timestamp + INTERVAL '20' DAY"))
    later = raw.filter("transaction_timestamp >= '1995-04-20'").unionByName(
        moved.withColumn("ingested_at", F.expr("ingested_at + INTERVAL '10' YEAR"))
    )
    job.run_incremental(spark, later, paths, now=F.lit("2002-01-02").cast("timestamp_ntz"), rows_per_bucket=20)
    fact = spark.read.parquet(paths.table("fact_transactions"))
    store.build_store(fact, paths.table("wallet_transfers_again"), rows_per_bucket=20)
    assert sides_of(spark, paths.table("wallet_transfers")) == sides_of(spark, paths.table("wallet_transfers_again"))
    assert not upserts.exists(spark, paths.table("changed_days"))


def test_fact_by_month_prunes_and_equals_the_fact_by_date(spark, path):
    fact = ledger(spark)
    write_table(fact, path, "stg_transactions_by_month", by_month=True)
    stored = spark.read.parquet(path)
    assert rows(stored.drop("transaction_month")) == rows(fact)
    for query in (dashboard.dash_daily_volume, dashboard.dash_hourly_volume, dashboard.dash_weekly_volume):
        found = query(stored, as_of="2020-08-28 12:00:00")
        assert rows(found) == rows(query(fact, as_of="2020-08-28 12:00:00"))
        plan = found._jdf.queryExecution().toString()
        assert "transaction_month" in plan.split("PartitionFilters")[1].split("]")[0]


def test_folders_of_a_period_are_bounded(spark, path, monkeypatch):
    monkeypatch.setattr(store, "MOST_BUCKETS", 2)
    fact = ledger(spark)
    store.build_store(fact, path, rows_per_bucket=1)
    opened = store.open_store(spark, path)
    assert opened.select("unit", "period", "buckets", "bucket").distinct().groupBy("period").count().agg(F.max("count")).first()[0] == 2
    for wallet in ("hot", "w5"):
        found = store.wallet_transfers(opened, wallet)
        assert rows(found) == rows(touching(fact, wallet).select(*found.columns))


def test_a_folder_of_many_rows_is_dealt_to_many_tasks(spark, path):
    """One wallet, one month: by rows alone, and made only once (no sampling of ranges)."""
    fact = ledger(spark).filter("from_address = 'hot'")
    placed = store._placed(fact, "month", 4)
    plan = placed.hint("rebalance", *[F.col(c) for c in store.PLACE])._jdf.queryExecution().sparkPlan().toString()
    assert "REBALANCE" in plan and "rangepartitioning" not in plan
    seen = []
    original = type(fact).repartitionByRange
    try:
        type(fact).repartitionByRange = lambda self, *a: seen.append(a) or original(self, *a)
        store.build_store(fact, path, rows_per_bucket=4)
    finally:
        type(fact).repartitionByRange = original
    assert not seen and store.open_store(spark, path).count() == 2 * fact.count()
