"""Registered queries against their SQL. LEDGERLENS_ALL=1 runs every one; the default set covers each section."""

import os

import pytest
from oracle import compare

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# these depend on data that only larger scales hold, or are covered by tests of their own
CORE = """
normalize_raw_transactions normalize_internal_transactions normalize_raw_wallets token_transfers_landing
address_list_filter new_rows_only ingestion_stats get_checkpoint resume_start_block label_lookup stage_transactions
stage_wallets stage_wallets_dag extract_wallets_top quality_issues_tx upsert_if_newer upsert_columns upsert_partitions
scd2_insert incremental_lookback fact_transactions dim_time dim_wallet dim_wallet_with_max dim_wallet_summary
agg_daily_metrics incremental_daily_metrics dash_totals dash_weekly_volume risk_distribution dashboard_summary
metric_with_change risk_wallet_page_filtered connected_to_suspicious score_percentiles wallet_stats
wallet_counterparties wallet_week_sparkline all_features impute_median scale_robust remove_outliers_iqr
describe_numeric knn_join lof dbscan cluster_quality score_distribution high_risk_comparison top_wallets eda_summary
log_value_histogram quality_report quality_report_faults check_relationship stream_daily_metrics
wallet_store_refresh
""".split()
CHOSEN = sorted(ORACLES) if os.environ.get("LEDGERLENS_ALL") else CORE


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, sf_dir, name):
    verdict, _ = compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name])
    assert verdict == "ok"


def test_entry_has_rows_and_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema
    assert first.limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
