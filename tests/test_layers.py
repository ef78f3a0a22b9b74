"""Properties of staging, upserts, features and the jobs that chain them."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.catalog import Views
from ledgerlens.catalog import views as views_module
from ledgerlens.catalog.ingest import pages
from ledgerlens.operators import daily, features, marts, staging, upserts
from ledgerlens.plans.daily import Paths, run_daily, run_incremental, run_wallets
from ledgerlens.plans.scoring import run_scoring
from ledgerlens.session import new_path
from ledgerlens.sources import landing
from ledgerlens.sources.tables import file_sizes


def rows(df):
    return sorted(map(repr, df.collect()))


def test_staging_twice_gives_the_same_rows(views):
    raw = views.raw_transactions
    twice = staging.stage_transactions(raw.unionByName(raw), staged_at=F.col("ingested_at"))
    once = staging.stage_transactions(raw, staged_at=F.col("ingested_at"))
    assert twice.count() == once.count() == once.select("transaction_id").distinct().count()
    assert once.exceptAll(twice.select(*once.columns)).count() == 0


def test_tiers_partition_all_facts(views):
    tiers = views.fact.groupBy("value_tier").count().collect()
    assert sum(r["count"] for r in tiers) == views.fact.count()


def test_upserts_are_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, staged_at int")
    source = spark.createDataFrame([(2, "c", 2), (3, "d", 0)], "k int, v string, staged_at int")
    for rule in (upserts.upsert_if_newer, upserts.upsert_replace, upserts.insert_missing):
        once = rule(target, source, ["k"])
        assert rows(rule(once, source, ["k"]).select(*once.columns)) == rows(once)
    older = spark.createDataFrame([(2, "old", 0)], "k int, v string, staged_at int")
    assert rows(upserts.upsert_if_newer(target, older, ["k"])) == rows(target)


def test_scd2_null_handling(spark):
    dim = spark.createDataFrame(
        [("w", None, 1, "x", True, None, None)],
        "wallet_address string, current_balance_eth double, total_transactions int, wallet_type string, "
        "is_current boolean, valid_to string, updated_at string",
    )
    staged = spark.createDataFrame(
        [("w", 5.0, 1, "x")], "wallet_address string, balance_eth double, total_transactions int, wallet_type string"
    )
    assert upserts.scd2_expire(dim, staged, now=F.lit("t")).first().is_current is True
    assert upserts.scd2_expire(dim, staged, now=F.lit("t"), null_safe=True).first().is_current is False


def test_incremental_metrics_equal_full_metrics(views):
    full = daily.agg_daily_metrics(views.fact, loaded_at=F.lit(0))
    existing = views.fact.filter("transaction_date < '1998-01-01'").select(F.col("transaction_date").alias("metric_date"))
    part = daily.incremental_daily_metrics(views.fact, existing, loaded_at=F.lit(0))
    averages = ["metric_date", "total_transactions", "unique_wallets"]
    first = part.agg(F.min("metric_date")).first()[0]
    assert rows(part.select(*averages)) == rows(full.filter(F.col("metric_date") >= first).select(*averages))


def test_feature_columns(views):
    assert len(features.feature_columns()) == 35 == len(set(features.feature_columns()))
    table = features.combined_features(views.staged)
    assert set(features.feature_columns()) <= set(table.columns)
    bad = table.filter("tx_count <> tx_count_in + tx_count_out OR weekend_tx_ratio > 1 OR night_tx_ratio > 1")
    assert bad.count() == 0


def test_flows_balance_when_both_sides_are_known(views):
    known = views.staged.filter("to_address IS NOT NULL")
    total = marts.dim_wallet_summary(known).agg(F.sum("total_sent").alias("s"), F.sum("total_received").alias("r")).first()
    assert total.s == pytest.approx(total.r, rel=1e-12)


def test_daily_job_then_incremental(spark, views):
    paths = Paths(new_path(spark, "warehouse"))
    cutoff = "ingested_at < timestamp_ntz'1998-01-01'"
    moment = F.lit("2001-01-01").cast("timestamp_ntz")
    later = F.lit("2001-01-02").cast("timestamp_ntz")
    # a few weeks around the cutoff, because every day becomes a folder
    monthly = views.raw_transactions.filter("ingested_at BETWEEN '1997-12-01' AND '1998-02-01'")
    report = run_daily(spark, monthly.filter(cutoff), paths, now=moment).collect()
    assert {r.check_name for r in report} == {"null_transaction_hash", "future_timestamp", "duplicate_transaction_id"}
    assert all(r.passed for r in report)
    run_incremental(spark, monthly.filter(f"NOT {cutoff}"), paths, now=later)
    expected = staging.stage_transactions(monthly, staged_at=moment)
    stored = spark.read.parquet(paths.table("stg_transactions"))
    assert stored.count() == expected.count()
    facts = spark.read.parquet(paths.table("fact_transactions"))
    assert facts.count() == expected.count()
    assert stored.select("transaction_id").distinct().count() == stored.count()
    metrics = spark.read.parquet(paths.table("agg_daily_metrics"))
    assert metrics.agg(F.sum("total_transactions")).first()[0] == facts.count()
    run_wallets(spark, views.raw_wallets, paths, now=moment)
    assert spark.read.parquet(paths.table("dim_wallet")).count() == views.raw_wallets.count()
    assert file_sizes(spark, {"dim_wallet": paths.table("dim_wallet")}).first().size_mb > 0


def test_scoring_job_modes(spark, views):
    paths = Paths(new_path(spark, "scoring"))
    stored = run_scoring(spark, views.staged, paths, mode="features", now=views.now)
    assert stored.count() == features.basic_features(views.staged).count()
    metadata = run_scoring(spark, None, paths, mode="train", model_type="isolation_forest").first()
    assert metadata.feature_count == 35 and metadata.test_samples > 0
    first = run_scoring(spark, None, paths, mode="score").select("wallet_address", "fraud_score")
    once = rows(first)
    assert first.filter("fraud_score < 0 OR fraud_score > 1").count() == 0
    assert rows(run_scoring(spark, None, paths, mode="score").select("wallet_address", "fraud_score")) == once
    with pytest.raises(ValueError):
        run_scoring(spark, None, paths, mode="unknown")


def test_amounts_over_38_digits_are_flagged_and_stay_null(spark, views):
    """All-ones 256-bit, 39 decimal digits and the largest amount that fits, beside a missing and a broken amount."""
    amounts = {"a": "0x" + "f" * 64, "b": "1" + "0" * 38, "c": "9" * 38, "d": "", "e": "0xzz", "f": " 0X" + "F" * 40, "g": None, "h": "7"}
    page = pages(views).drop("value", "hash").limit(1)
    landed = page.crossJoin(spark.createDataFrame(list(amounts.items()), "hash string, value string"))
    raw = landing.normalize_raw_transactions(landed, "x", ingested_at=F.col("ingested_at"))
    assert {r["transaction_hash"]: r["value_text"] for r in raw.collect()} == amounts
    staged = staging.stage_transactions(raw, staged_at=F.col("ingested_at"))
    issues = {r["transaction_hash"]: list(r["data_quality_issues"]) for r in staged.collect()}
    over = ["value_overflow"]
    assert issues == {"a": over, "b": over, "c": [], "d": [], "e": ["missing_value"], "f": over, "g": [], "h": []}
    fact = {r["transaction_hash"]: r for r in marts.fact_transactions(staged).collect()}
    value = {k: r["value_wei"] for k, r in fact.items()}
    assert value == {"a": None, "b": None, "c": int("9" * 38), "d": 0, "e": 0, "f": None, "g": 0, "h": 7}
    assert all((r["value_eth"] is None) == (k in "abf") for k, r in fact.items())
    assert all(r["is_value_transfer"] == r["is_high_value"] == (k in "abcf") or k == "h" for k, r in fact.items())
    assert {k for k, r in fact.items() if r["value_tier"] == "whale"} == set("abcf") and not fact["a"]["is_micro_transaction"]


def test_columns_that_follow_from_a_row_are_made_after_the_newest_copy_is_picked(views):
    """The shuffle of staged transfers carries no identifier, fee or type, and no input data that nobody reads."""
    spark = views.spark
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = views.staged.drop("input_data")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    above, below = plan.split("Window [row_number", 1)
    assert "AS transaction_id" in above and "AS gas_fee_eth" in above and "AS transaction_type" in above
    assert not any(f"AS {name}#" in below for name in ("transaction_id", "gas_fee_eth", "gas_fee_wei", "transaction_type"))
    assert "left(input_data" not in below and ", 1000)" not in below


def test_the_served_fact_is_made_once(spark, views, monkeypatch):
    """No range sampling, which would run the join and the choice of newest copies a second time."""
    fresh, seen = Views(spark, views.sf_dir), []
    monkeypatch.setattr("ledgerlens.sources.tables.in_ranges", lambda df, *by: seen.append(by) or df)
    monkeypatch.setattr(views_module, "_SERVED", {})
    assert rows(fresh.served_transfers) == rows(fresh.fact.select(*fresh.served_transfers.columns))
    assert not fresh._is_served("fact_transactions")
    assert fresh.served_fact.count() == fresh.fact.count() and not seen
    assert Views(spark, views.sf_dir).served_transfers.columns == fresh.served_fact.columns


def test_dashboards_store_only_the_columns_they_read(spark, views, monkeypatch):
    """Not the whole fact; its rows are made once, and lie in folders by month."""
    fresh, seen = Views(spark, views.sf_dir), []
    monkeypatch.setattr(views_module, "_SERVED", {})
    monkeypatch.setattr("ledgerlens.sources.tables.in_ranges", lambda df, *by: seen.append(by) or df)
    stored = fresh.served_dashboard
    assert stored.columns == [*views_module.DASHBOARD_COLUMNS, "transaction_month"]
    assert rows(stored.drop("transaction_month")) == rows(fresh.fact.select(*views_module.DASHBOARD_COLUMNS))
    assert not fresh._is_served("fact_transactions") and not seen
    assert fresh.served_fact.count() and Views(spark, views.sf_dir).served_dashboard.columns == fresh.served_fact.columns


def test_the_last_moment_is_found_by_order_before_the_join(spark, tmp_path):
    """Lines without an order do not count, and order lines meet the orders already grouped, not one by one."""
    line = "l_orderkey long, l_partkey long, l_quantity double, l_shipdate timestamp_ntz"
    day = "2001-02-03 00:00:00"
    lines = [(1, 5, 7.0, day), (1, None, 7.0, "2009-01-01 00:00:00"), (2, 1, 1.0, day), (2, 5, 9.0, day)]
    lines += [(3, 23, 50.0, "2008-01-01 00:00:00"), (None, 23, 50.0, "2008-01-01 00:00:00")]
    given = spark.createDataFrame(lines, line.replace("timestamp_ntz", "string"))
    given.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (2,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = Views(spark, str(tmp_path)).moment
    assert [str(r.as_of) for r in found.collect()] == ["2001-02-03 05:09:00"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Aggregate [l_orderkey" in plan.split("Join")[1] and "Repartition" not in plan
