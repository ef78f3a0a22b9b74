"""All column tests in one scan per table against a frame of violations for each."""

import pytest

from ledgerlens.catalog import profiles
from ledgerlens.operators import quality


def report(df):
    return {row.check_name: (row.violations, row.passed) for row in df.collect()}


@pytest.fixture(scope="module")
def small(spark):
    """Tables of the tested columns only, with NULLs, repeats, values outside the lists and an orphan."""
    columns: dict[str, set[str]] = {}
    for test in quality.COLUMN_TESTS:
        columns.setdefault(test.table, set()).add(test.column)
    tables = {}
    for table, names in columns.items():
        fields = sorted(names)
        body = [tuple(f"{name}{i % 4}" for name in fields) for i in range(6)] + [tuple(None for _ in fields)] * 2
        tables[table] = spark.createDataFrame(body, ", ".join(f"{name} string" for name in fields))
    return tables


def test_equals_a_frame_for_each_check(small):
    names = {"stg_transactions": "staged", "stg_wallets": "staged_wallets", "fact_transactions": "fact"}
    checks = quality.table_checks(**{names.get(name, name): df for name, df in small.items()})
    found = report(quality.column_tests(small))
    assert len(found) == 33
    assert found == report(quality.quality_report(checks))
    assert found["dim_time.time_key.unique"] == (2, False)
    assert found["raw_wallets.wallet_address.not_null"] == (2, False)
    assert found["dim_wallet.balance_tier.accepted_values"] == (4, False)


def test_orphans_listed_values_and_empty_tables(spark, small):
    days = spark.createDataFrame([("time_key0",), ("time_key0",), (None,)], "time_key string").selectExpr("*", "time_key AS full_date")
    found = report(quality.column_tests({**small, "dim_time": days}))
    assert found["fact_transactions.time_key.relationship"] == (3, False)
    empty = report(quality.column_tests({name: df.limit(0) for name, df in small.items()}))
    assert len(empty) == 33 and set(empty.values()) == {(0, True)}
    fine = {"dim_wallet": spark.createDataFrame([("a", "a", "whale"), ("b", "b", None)], "wallet_key string, wallet_address string, balance_tier string")}
    tests = [t for t in quality.COLUMN_TESTS if t.table == "dim_wallet"]
    assert set(report(quality.column_tests(fine, tests)).values()) == {(0, True)}


def test_one_scan_per_table(spark, tmp_path, small):
    stored = {}
    for name, df in small.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    plan = quality.column_tests(stored)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == len(stored) == 7


def test_faults_reach_every_kind(views):
    found = report(profiles._faulty(views))
    for kind in ("not_null", "unique", "accepted_values", "relationship"):
        assert any(not passed for name, (_, passed) in found.items() if name.endswith(kind))
