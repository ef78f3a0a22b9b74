"""The incremental daily job against a full load, merges that are cut off, and what a merge reads."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import daily, upserts
from ledgerlens.plans import daily as job
from ledgerlens.plans.daily import Paths
from ledgerlens.session import new_path


def rows(df):
    return sorted(map(repr, df.collect()))


def keyed(spark, body):
    return spark.createDataFrame(body, "k string, day string, v int").withColumn("day", F.to_date("day"))


@pytest.fixture
def table(spark):
    path = new_path(spark, "merge")
    start = keyed(spark, [(f"k{i}", f"2020-01-{1 + i % 5:02}", 0) for i in range(40)] + [("alone", "2020-02-01", 0)])
    start.write.partitionBy("day").parquet(path)
    upserts.write_key_index(spark.read.parquet(path), f"{path}_keys", ["k"], "day", buckets=16)
    return path


def content(spark, path):
    return {r.k: (str(r.day), r.v) for r in spark.read.parquet(path).collect()}


def merge(path, source, **options):
    upserts.merge_into_partitions(path, source, ["k"], "day", index=f"{path}_keys", **options)


def test_merge_moves_rows_and_keeps_the_index(spark, table):
    before = content(spark, table)
    merge(table, keyed(spark, [("alone", "2020-01-02", 1), ("k7", "2020-03-01", 1), ("new", "2020-01-01", 1), ("k0", "2020-01-01", 1)]))
    changed = {"alone": ("2020-01-02", 1), "k7": ("2020-03-01", 1), "new": ("2020-01-01", 1), "k0": ("2020-01-01", 1)}
    assert content(spark, table) == before | changed
    assert spark.read.parquet(table).count() == 42
    index = spark.read.parquet(f"{table}_keys")
    assert rows(index.select("k", "day")) == rows(spark.read.parquet(table).select("k", "day"))
    assert index.select("k").distinct().count() == index.count()
    merge(table, keyed(spark, []))
    assert content(spark, table) == before | changed


def test_merge_looks_only_into_the_buckets_of_its_keys(spark, table):
    source = keyed(spark, [("k7", "2020-03-01", 1)])
    read = upserts.stored_keys(spark.read.parquet(f"{table}_keys"), source, ["k"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1]
    assert {r.bucket for r in read.select("bucket").distinct().collect()} == {
        r[0] for r in source.select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()
    }
    assert len(read.inputFiles()) >= 1 and read.count() < 41


@pytest.mark.parametrize("stop_at", ["_overwrite_partitions", "drop"])
def test_a_merge_that_is_cut_off_leaves_one_version_and_is_completed(spark, table, monkeypatch, stop_at):
    before = content(spark, table)
    moved = keyed(spark, [("alone", "2020-01-02", 1), ("k7", "2020-01-04", 1)])
    real, calls = getattr(upserts, stop_at), []

    def stopping(*args):
        calls.append(args)
        if stop_at == "_overwrite_partitions" or "day=" in args[1]:
            raise RuntimeError("cut off")
        return real(*args)

    with monkeypatch.context() as patch:
        patch.setattr(upserts, stop_at, stopping)
        with pytest.raises(RuntimeError, match="cut off"):
            merge(table, moved)
    stored = spark.read.parquet(table)
    assert stored.count() == stored.select("k").distinct().count()
    upserts.finish_merge(spark, table)
    expected = before | {"alone": ("2020-01-02", 1), "k7": ("2020-01-04", 1)}
    assert content(spark, table) == expected
    assert rows(spark.read.parquet(f"{table}_keys").select("k", "day")) == rows(spark.read.parquet(table).select("k", "day"))
    upserts.finish_merge(spark, table)
    assert content(spark, table) == expected


def test_a_journal_without_its_plan_is_dropped(spark, table):
    before = content(spark, table)
    keyed(spark, [("lost", "2020-01-01", 9)]).write.parquet(f"{table}_journal/rows")
    upserts.finish_merge(spark, table)
    assert content(spark, table) == before and not upserts.exists(spark, f"{table}_journal")


def test_rows_without_a_partition_value_merge(spark, table):
    merge(table, keyed(spark, [("k1", None, 1), ("none", None, 1)]))
    merge(table, keyed(spark, [("none", "2020-01-01", 2), ("k1", "2020-01-01", 2)]))
    assert content(spark, table)["none"] == ("2020-01-01", 2)
    assert spark.read.parquet(table).filter("day IS NULL").count() == 0


def transfers(spark, body):
    frame = spark.createDataFrame(body, "day string, sender string, receiver string")
    return frame.select(F.to_date("day").alias("transaction_date"), F.col("sender").alias("from_address"), F.col("receiver").alias("to_address"))


def test_first_seen_after_days_changed(spark):
    old = transfers(spark, [("2020-01-01", "a", "b"), ("2020-01-02", "b", "c"), ("2020-01-03", "a", None), ("2020-01-05", "d", "e")])
    # b's first transfer goes, d's only day empties, e turns up earlier, f is new; a stays on its day
    new = transfers(spark, [("2020-01-01", "a", "e"), ("2020-01-02", "b", "c"), ("2020-01-03", "a", None), ("2020-01-04", "f", "b")])
    days = [r[0] for r in spark.sql("SELECT explode(array(date'2020-01-01', date'2020-01-04', date'2020-01-05'))").collect()]
    found = daily.refresh_first_seen(daily.first_seen(old), new, days)
    assert rows(found) == rows(daily.first_seen(new))


def test_incremental_job_equals_a_full_load(spark, views):
    """Late rows on old days, rows that move to another day, days that empty, and a run cut off after the facts."""
    moment, later, last = (F.lit(f"2001-01-0{i}").cast("timestamp_ntz") for i in (1, 2, 3))
    raw = views.raw_transactions.filter("transaction_timestamp BETWEEN '1997-12-15' AND '1998-01-20'")
    late = (F.col("block_number") % 5 == 0) | (F.col("transaction_timestamp") >= "1998-01-10")
    shift = F.expr("transaction_timestamp + INTERVAL '3' DAY")
    moved = raw.filter((F.col("block_number") % 11 == 0) | (F.to_date("transaction_timestamp") == "1997-12-28")).withColumn(
        "transaction_timestamp", shift
    ).withColumn("ingested_at", F.expr("ingested_at + INTERVAL '400' DAY"))
    paths, whole = Paths(new_path(spark, "job")), Paths(new_path(spark, "full"))
    job.run_daily(spark, raw.filter(~late), paths, now=moment)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(job, "refresh_metrics", lambda *a, **k: None)
        job.run_incremental(spark, raw.filter(late), paths, now=later)
    job.run_incremental(spark, moved, paths, now=last)
    job.run_daily(spark, raw.unionByName(moved), whole, now=last)
    for name in ("agg_daily_metrics", "wallet_first_seen"):
        mine, full = (spark.read.parquet(p.table(name)).drop("loaded_at") for p in (paths, whole))
        exact = [c for c, kind in full.dtypes if kind != "double"]
        assert rows(mine.select(*exact)) == rows(full.select(*exact))
        if name == "agg_daily_metrics":
            pairs = mine.alias("m").join(full.alias("f"), "metric_date")
            for c in (c for c, kind in full.dtypes if kind == "double"):
                a, b = F.col(f"m.{c}"), F.col(f"f.{c}")
                close = a.eqNullSafe(b) | (F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)))
                assert pairs.filter(~F.coalesce(close, F.lit(False))).count() == 0, c
    assert not upserts.exists(spark, paths.table("changed_days"))
    facts, keys = (spark.read.parquet(paths.table(n)) for n in ("fact_transactions", "fact_transactions_keys"))
    assert rows(keys.select("transaction_key", "transaction_date")) == rows(facts.select("transaction_key", "transaction_date"))


def wallet_states(spark, body):
    """Raw rows (wallet, day of the state, balance in wei, transfers out)."""
    rows = spark.createDataFrame(body, "wallet_address string, day int, wei bigint, sent bigint")
    day = F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(day)")
    return rows.select(
        "wallet_address", day.alias("first_seen_timestamp"), day.alias("last_seen_timestamp"),
        F.lit(1).cast("bigint").alias("total_transactions_in"), F.col("sent").alias("total_transactions_out"),
        F.col("wei").cast("decimal(38,0)").alias("total_value_in_wei"),
        F.lit(0).cast("decimal(38,0)").alias("total_value_out_wei"), F.lit(1).cast("bigint").alias("unique_counterparties"),
        F.col("wei").cast("decimal(38,0)").alias("balance_wei"), (F.col("wei") / 1e18).alias("balance_eth"),
        F.lit(False).alias("is_contract"), F.lit("test").alias("source"), day.alias("ingested_at"),
    )


def versions(spark, paths):
    dim = spark.read.parquet(paths.table("dim_wallet"))
    return sorted(
        (r.wallet_address, r.total_sent, r.is_current, r.valid_from.day, r.valid_to.day if r.valid_to else None)
        for r in dim.select("wallet_address", "total_sent", "is_current", "valid_from", "valid_to").collect()
    )


def at(day):
    return F.lit(f"2020-02-0{day}").cast("timestamp_ntz")


@pytest.mark.parametrize("stop_at", [None, "before the dimension", "staged table moved"])
def test_wallet_updates_keep_versions_also_when_cut_off(spark, monkeypatch, stop_at):
    paths = Paths(new_path(spark, "warehouse"))
    # without a dimension the update is a first load
    job.update_wallets(spark, wallet_states(spark, [("0xa", 1, 5, 1), ("0xb", 1, 5, 1)]), paths, now=at(1))
    second = wallet_states(spark, [("0xa", 2, 5, 2), ("0xa", 3, 5, 3), ("0xc", 2, 5, 1), ("0xb", 2, 5, 1)])
    if stop_at is None:
        job.update_wallets(spark, second, paths, now=at(2))
    else:
        broken = {"before the dimension": "scd2_expire", "staged table moved": "move"}[stop_at]
        with monkeypatch.context() as m:
            m.setattr(upserts, broken, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("cut off")))
            with pytest.raises(RuntimeError):
                job.update_wallets(spark, second, paths, now=at(2))
    # nothing new: only what was left undone is made up for, at the time of this update
    job.update_wallets(spark, second.limit(0), paths, now=at(3))
    day = 2 if stop_at is None else 3
    assert versions(spark, paths) == [
        ("0xa", 1, False, 1, day), ("0xa", 3, True, day, None), ("0xb", 1, True, 1, None), ("0xc", 1, True, day, None),
    ]
    job.update_wallets(spark, wallet_states(spark, [("0xa", 4, 6, 3)]), paths, now=at(4))
    assert ("0xa", 3, False, day, 4) in versions(spark, paths) and len(versions(spark, paths)) == 5


def test_the_full_load_moves_rows_to_their_days_once(spark, views, monkeypatch):
    """Facts are written as the staged files lie: ranges of days are found for staged transfers only."""
    seen = []
    original = job.write_table.__globals__["in_ranges"]
    monkeypatch.setitem(job.write_table.__globals__, "in_ranges", lambda df, *by: seen.append(by) or original(df, *by))
    paths = Paths(new_path(spark, "warehouse"))
    month = views.raw_transactions.filter("ingested_at BETWEEN '1997-12-01' AND '1997-12-20'")
    job.run_daily(spark, month, paths, now=F.lit("2001-01-01").cast("timestamp_ntz"), key_buckets=4)
    assert seen == [("transaction_date", "from_address", "to_address")]
    staged, fact = (spark.read.parquet(paths.table(t)) for t in ("stg_transactions", "fact_transactions"))
    keys = [df.groupBy("transaction_date").count() for df in (staged.filter("data_quality_score >= 0.5"), fact)]
    assert rows(keys[0]) == rows(keys[1]) and fact.count() > 0
    assert all(".zstd." in name for name in spark.read.parquet(paths.table("fact_transactions_keys")).inputFiles())
